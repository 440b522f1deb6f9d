"""Translation of POSIX regular expressions and of readable date formats into Spark's dialects."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..types import InvalidValueError

# POSIX class names and their Java counterparts.
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit",
    "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space",
    "upper": "Upper", "xdigit": "XDigit",
}

# Word-boundary and end escapes that Java spells differently.
POSIX_ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "Z": r"\z"}

# Parts of readable date formats and their datetime pattern letters.
DATE_PARTS = {"YYYY": "yyyy", "DD": "d", "MM": "M", "HH24": "H", "HH12": "h", "MI": "m", "SS": "s", "AM/PM": "a"}

# The formats offered for each target type.
DATE_FORMATS = {
    "DATE": ["DD/MM/YYYY", "DD-MM-YYYY", "MM/DD/YYYY", "MM-DD-YYYY", "YYYY/MM/DD", "YYYY-MM-DD"],
    "TIME": ["HH24:MI:SS", "HH12:MI:SS AM/PM", "HH12:MI AM/PM", "HH12 AM/PM"],
    "TIMESTAMP": ["DD/MM/YYYY TIME", "DD-MM-YYYY TIME", "MM/DD/YYYY TIME", "MM-DD-YYYY TIME",
                  "YYYY/MM/DD TIME", "YYYY-MM-DD TIME"],
}


def java_regex(spark: SparkSession, regex: str, case_sensitive: bool) -> str:
    """The pattern for ``rlike``; a malformed one raises here and not in a running job."""
    pattern = re.sub(r"\[:(\w+):\]", lambda m: r"\p{" + POSIX_CLASSES.get(m[1], m[1]) + "}", regex)
    pattern = re.sub(r"\\(.)", lambda m: POSIX_ESCAPES.get(m[1], m[0]), pattern, flags=re.DOTALL)
    if not case_sensitive:
        pattern = "(?iu)" + pattern
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:
        raise InvalidValueError(f"invalid regular expression {regex!r}") from error
    return pattern


def datetime_pattern(readable: str) -> str:
    """Spark datetime pattern of a readable format such as ``DD/MM/YYYY`` or ``HH12:MI AM/PM``."""
    pattern = readable.replace(" TIME", "[ H:m:s]")
    for part, letters in DATE_PARTS.items():
        pattern = pattern.replace(part, letters)
    return pattern
