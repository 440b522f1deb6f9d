"""Queries over the test tables, each with the SQL that gives the same rows."""

from . import cleaning, encoding, joining, linking, profiling, recipes, storage
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "encoding", "joining", "linking", "profiling", "recipes", "storage"]
