"""Names of new columns and tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .types import InvalidValueError


def case_matters() -> bool:
    """Whether the session takes names that differ by case only for different ones."""
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.caseSensitive") == "true"


def clashing_names(existing: Iterable[str], names: Iterable[str]) -> list[str]:
    """Those of ``names`` that the session takes for existing ones."""
    fold = str if case_matters() else str.lower
    taken = {fold(name) for name in existing}
    return sorted(name for name in set(names) if fold(name) in taken)


def unique_name(existing: Iterable[str], name: str) -> str:
    """``name`` if neither it nor a numbered variant exists, else the next numbered variant.

    Names are compared by the session's case rule.
    """
    pattern = re.compile(re.escape(name) + r"(?:_(\d+))?", 0 if case_matters() else re.IGNORECASE)
    taken = [match for match in map(pattern.fullmatch, existing) if match]
    if not taken:
        return name
    return f"{name}_{max(int(match.group(1) or 0) for match in taken) + 1}"


def free_table_name(existing: Iterable[str], name: str) -> str:
    """First of ``name``, ``name_1``, ``name_2`` ... that is not in use."""
    used = set(existing)
    number, candidate = 0, name
    while candidate in used:
        number += 1
        candidate = f"{name}_{number}"
    return candidate


def check_table_name(name: str) -> str:
    """Table names consist of letters, digits and underscores."""
    if not name.replace("_", "a").isalnum():
        raise InvalidValueError(f"table name {name!r} is not alphanumeric")
    return name
