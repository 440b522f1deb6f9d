"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column, keep_point: bool = False, plain_below: float = 1e15) -> Column:
    """Shortest decimal text of a double, without exponent for sizes from 0.0001 up to ``plain_below``.

    Spark writes an exponent from 10^7 on; the digits are the same, only their layout changes.
    """
    size = F.abs(value)
    short = value.cast("string")
    # Seventeen digits after up to four zeros, or before the point and a few after it.
    plain = F.when(size < 1, short.cast("decimal(38,22)").cast("string")).otherwise(
        short.cast("decimal(38,18)").cast("string"))
    spelled = F.regexp_replace(plain, r"(\.\d*?)0+$", "$1")
    spelled = F.regexp_replace(spelled, r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.lpad(F.replace(power, F.lit("-"), F.lit("")), 2, "0")
    text = (F.when(~short.contains("E"), short)
            .when((size >= 1e-4) & (size < plain_below), spelled)
            .otherwise(F.concat(mantissa, F.lit("e"), sign, digits)))
    return text if keep_point else F.regexp_replace(text, r"\.0$", "")
