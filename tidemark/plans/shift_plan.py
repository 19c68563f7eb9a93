"""Where time moves to: one plan for everything, or one plan per group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.affine import Affine, scale_exactly, scaled_by
from tidemark.functions.timeexpr import (
    parse_time_expression,
    time_expression_micros,
)


@dataclass(frozen=True)
class TimeSettings:
    """User options; every text is a time expression."""

    delta_factor: float = 1.0
    base_time: str = "auto"
    target_time: str = "now"
    prevent_future: bool = True
    ceiling_time: str | None = "now"

    def problems(self) -> list[str]:
        found = []
        if not self.delta_factor > 0:
            found.append("delta_factor must be positive")
        for name in ("base_time", "target_time", "ceiling_time"):
            text = getattr(self, name)
            if text is None or (name == "base_time" and text == "auto"):
                continue
            try:
                parse_time_expression(text)
            except ValueError as problem:
                found.append(f"{name}: {problem}")
        return found


@dataclass(frozen=True)
class ShiftPlan:
    """Four numbers that fix the move of every instant (microseconds)."""

    base: int
    new_base: int
    factor: float = 1.0
    ceiling: int | None = None

    def affine(self) -> Affine:
        ceiling = None if self.ceiling is None else F.lit(self.ceiling).cast("bigint")
        return Affine(
            F.lit(self.base).cast("bigint"), F.lit(self.new_base).cast("bigint"), self.factor, ceiling
        )


def plan_shift(settings: TimeSettings, earliest: int, latest: int, run_time: int) -> ShiftPlan:
    """Fix base, new base and ceiling from the time range of the events."""
    problems = settings.problems()
    if problems:
        raise ValueError("; ".join(problems))

    def resolve(text: str) -> int:
        return parse_time_expression(text).resolve(run_time, earliest, latest)

    base = earliest if settings.base_time == "auto" else resolve(settings.base_time)
    target = resolve(settings.target_time)
    ceiling = None
    if settings.prevent_future and settings.ceiling_time:
        ceiling = resolve(settings.ceiling_time)
    reach = scale_exactly(max(0, latest - base), settings.delta_factor)
    if ceiling is not None and target + reach > ceiling:
        target = ceiling - reach
    return ShiftPlan(base, target, settings.delta_factor, ceiling)


# Columns of a per-group plan.
PLAN_FIELDS = ("base_us", "new_base_us", "factor", "ceiling_us")


def plan_columns(bounds: DataFrame, run_time: int) -> DataFrame:
    """Per-group plans from rows that hold a time range and the settings of the group.

    ``bounds`` has ``earliest_us``, ``latest_us``, ``delta_factor``, ``base_time``,
    ``target_time``, ``prevent_future`` and ``ceiling_time`` next to its key columns.
    """
    now, lo, hi = F.lit(run_time).cast("bigint"), F.col("earliest_us"), F.col("latest_us")

    def resolve(name: str) -> Column:
        return time_expression_micros(F.col(name), now, lo, hi)

    base = F.when(F.lower("base_time") == "auto", lo).otherwise(resolve("base_time"))
    ceiling = F.when(F.col("prevent_future"), resolve("ceiling_time"))
    keys = [c for c in bounds.columns if c not in SETTING_FIELDS]
    staged = bounds.select(
        *keys,
        base.alias("base_us"),
        resolve("target_time").alias("_target_us"),
        F.col("delta_factor").cast("double").alias("factor"),
        ceiling.alias("ceiling_us"),
    ).withColumn(
        "_reach_us", scaled_by(F.greatest(F.lit(0), hi - F.col("base_us")), F.col("factor"))
    )
    over = F.col("_target_us") + F.col("_reach_us") > F.col("ceiling_us")
    new_base = F.when(over, F.col("ceiling_us") - F.col("_reach_us")).otherwise(F.col("_target_us"))
    return staged.withColumn("new_base_us", new_base).drop("_target_us", "_reach_us")


SETTING_FIELDS = ("delta_factor", "base_time", "target_time", "prevent_future", "ceiling_time")


def affine_of_plan_columns() -> Affine:
    return Affine(F.col("base_us"), F.col("new_base_us"), F.col("factor"), F.col("ceiling_us"))
