"""Operators for preparing training text: scoring, mixing, searching, deduplicating and packing."""
