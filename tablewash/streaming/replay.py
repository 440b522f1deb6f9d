"""Cleaning a stream by a recipe that was fitted to a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..plans.recipe import FIT, ROW_WISE, Step, replay
from ..types import InvalidValueError


def replay_on_stream(stream: DataFrame, plan: Iterable[Step]) -> DataFrame:
    """Apply fitted row-wise steps to a streaming DataFrame; they need no state and no watermark."""
    plan = list(plan)
    for step in plan:
        if step.code not in ROW_WISE or step.params.get("validate"):
            raise InvalidValueError(f"step {step.code} needs the whole table")
        learned = {"edges", "value", "mean", "categories"} & set(step.params)
        if step.code in FIT and not learned:
            raise InvalidValueError(f"step {step.code} has to be fitted first")
    return replay(stream, plan)
