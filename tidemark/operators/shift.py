"""Moving instants: by one plan, by a plan per group, by given deltas, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.affine import Affine
from tidemark.operators.bounds import earliest_of, latest_of, range_by
from tidemark.plans.shift_plan import (
    PLAN_FIELDS,
    SETTING_FIELDS,
    TimeSettings,
    affine_of_plan_columns,
    plan_columns,
)
from tidemark.session import cut_lineage

def shift_columns(df: DataFrame, plan: Affine, columns: dict[str, str]) -> DataFrame:
    """Add a moved copy of each timestamp column: ``{source: new name}``."""
    return df.withColumns(
        {new: plan.timestamp(F.col(old).cast("timestamp")) for old, new in columns.items()}
    )


def shift_map(timestamps: Column, plan: Affine) -> Column:
    """Move every instant of a ``map<string, timestamp>``."""
    return F.transform_values(timestamps, lambda _, ts: plan.timestamp(ts))


def shift_by_deltas(timestamps: Column, delta_us: dict[str, int]) -> Column:
    """Add a fixed delta (microseconds) per field; other fields stay."""
    if not delta_us:
        return timestamps
    deltas = F.create_map(*[F.lit(x) for k, v in delta_us.items() for x in (k, v)])

    def move(field: Column, ts: Column) -> Column:
        moved = F.unix_micros(ts) + F.coalesce(F.try_element_at(deltas, field), F.lit(0))
        return F.timestamp_micros(moved.cast("bigint"))

    return F.transform_values(timestamps, move)


def shift_by_lookup(df: DataFrame, ts: str, lookup: DataFrame, new: str) -> DataFrame:
    """Move ``ts`` by the delta stored for exactly that instant; a miss leaves it alone.

    ``lookup`` holds ``original`` (timestamp, unique) and ``delta_us``. Both sides may be large:
    the join strategy is left to the adaptive planner, which also splits skewed instants.
    """
    found = lookup.select(F.col("original").alias("_original"), F.col("delta_us").alias("_delta"))
    joined = df.join(found, F.col(ts).cast("timestamp") == F.col("_original"), "left")
    moved = F.unix_micros(F.col(ts).cast("timestamp")) + F.coalesce(F.col("_delta"), F.lit(0))
    return joined.withColumn(new, F.timestamp_micros(moved)).drop("_original", "_delta")


def distinct_shifts(df: DataFrame, instants: list[Column], plan: Affine) -> DataFrame:
    """The lookup of :func:`shift_by_lookup` for a plan: one row per distinct instant."""
    each = df.select(F.explode(F.array_compact(F.array(*instants))).alias("original")).distinct()
    us = F.unix_micros("original")
    return each.select("original", (plan.uncapped(us) - us).alias("delta_us"))


def shift_counters(us: list[Column], plan: Affine, run_time: int) -> dict[str, Column]:
    """Per-row counts: instants past the run time after the move, and instants held at the ceiling."""
    moved = F.array(*[plan(u) for u in us])
    free = F.array(*[plan.uncapped(u) for u in us])
    ceiling = plan.ceiling if plan.ceiling is not None else F.lit(None).cast("bigint")
    return {
        "instants_in_future": F.size(F.filter(moved, lambda x: x > F.lit(run_time))),
        "instants_at_ceiling": F.size(F.filter(free, lambda x: x > ceiling)),
    }


def attach_plans(df: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """Put the plan of its group next to every row.

    ``plans`` (one row per key) is the result of an aggregation over the data; it is written once.
    The planner broadcasts it if its bytes allow, else joins by key, and the adaptive join splits a
    group with a large share of all rows. Every row is kept, the NULL key is a group like any other,
    and a row without a plan gets NULLs.
    """
    plans = cut_lineage(plans.select(F.col(key).alias("_plan_key"), *PLAN_FIELDS))
    return df.join(plans, F.col(key).eqNullSafe(F.col("_plan_key")), "left").drop("_plan_key")


def plan_by_group(
    df: DataFrame, instants: list[Column], key: str, settings: DataFrame, run_time: int
) -> DataFrame:
    """A plan per group from its own time range and its row of ``settings``.

    ``settings`` has the key and the columns of ``SETTING_FIELDS``, as
    :func:`tidemark.operators.lookups.effective_settings` gives them; a group without a row there is
    replayed by the defaults of :class:`TimeSettings`. The NULL key is a group too. A group without a
    readable instant has no plan.
    """
    ranges = range_by(df, instants, [F.col(key)]).filter(F.col("earliest").isNotNull())
    ends = ranges.select(
        key, F.unix_micros(F.col("earliest").cast("timestamp")).alias("earliest_us"),
        F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"),
    )
    own = settings.select(F.col(key).alias("_settings_key"), *SETTING_FIELDS, F.lit(True).alias("_set"))
    joined = ends.join(own, F.col(key).eqNullSafe(F.col("_settings_key")), "left")
    defaults = TimeSettings()
    filled = joined.withColumns({
        f: F.when(F.col("_set"), F.col(f)).otherwise(F.lit(getattr(defaults, f))) for f in SETTING_FIELDS
    })
    return plan_columns(filled.drop("_settings_key", "_set"), run_time).select(key, *PLAN_FIELDS)


def group_results(
    df: DataFrame, instants: list[Column], plans: DataFrame, key: str
) -> DataFrame:
    """Per group: events, events modified, range before and after; ``error`` where there is no plan.

    The new range is the moved old one, so nothing but the range is computed from the rows.
    """
    ranges = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count(earliest_of(instants)).alias("events_modified"),
        F.min(earliest_of(instants)).alias("original_earliest"),
        F.max(latest_of(instants)).alias("original_latest"),
    )
    plan = affine_of_plan_columns()
    plans = plans.withColumnRenamed(key, "_plan_key")
    joined = ranges.join(plans, F.col(key).eqNullSafe(F.col("_plan_key")), "left").drop("_plan_key")
    return joined.select(
        *ranges.columns,
        plan.timestamp(F.col("original_earliest").cast("timestamp")).alias("new_earliest"),
        plan.timestamp(F.col("original_latest").cast("timestamp")).alias("new_latest"),
        F.when(F.col("base_us").isNull(), F.lit("no readable timestamp")).alias("error"),
    )


def shift_by_group(
    df: DataFrame, plans: DataFrame, key: str, columns: dict[str, str]
) -> DataFrame:
    """Move columns with the plan of each row's group."""
    shifted = shift_columns(attach_plans(df, plans, key), affine_of_plan_columns(), columns)
    return shifted.drop(*PLAN_FIELDS)
