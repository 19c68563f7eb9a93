"""Numbers about a replay: run statistics, histograms, breakdowns and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.affine import Affine
from tidemark.functions.instants import SECOND, epoch_micros
from tidemark.operators.bounds import earliest_of, latest_of, range_by, span_hours
from tidemark.operators.shift import shift_counters


def run_statistics(
    df: DataFrame, us: list[Column], plan: Affine, run_time: int, error: Column | None = None
) -> DataFrame:
    """One row of counters and ranges for a whole replay.

    ``us`` are the instants of a record in microseconds, NULL where it has none.
    """
    counters = shift_counters(us, plan, run_time)
    moved = [plan(u) for u in us]
    failed = F.lit(False) if error is None else error.isNotNull()
    staged = df.select(
        failed.alias("_failed"),
        earliest_of(us).alias("_old_lo"), latest_of(us).alias("_old_hi"),
        earliest_of(moved).alias("_new_lo"), latest_of(moved).alias("_new_hi"),
        *[c.alias(n) for n, c in counters.items()],
    )
    ok = ~F.col("_failed")
    future = F.col("instants_in_future")
    tolerant = F.lit(run_time + SECOND)
    return staged.agg(
        F.count_if(ok).alias("events"),
        F.count_if(ok & F.col("_new_lo").isNotNull()).alias("events_modified"),
        F.count_if(F.col("_failed")).alias("errors"),
        F.timestamp_micros(F.min("_old_lo")).alias("original_earliest"),
        F.timestamp_micros(F.max("_old_hi")).alias("original_latest"),
        F.timestamp_micros(F.min("_new_lo")).alias("new_earliest"),
        F.timestamp_micros(F.max("_new_hi")).alias("new_latest"),
        F.sum(future).alias("instants_in_future"),
        F.sum("instants_at_ceiling").alias("instants_at_ceiling"),
        F.count_if(F.col("_new_hi") > tolerant).alias("events_in_future"),
    ).withColumns({
        "original_base": F.timestamp_micros(plan.base),
        "new_base": F.timestamp_micros(plan.new_base),
        "delta_factor": plan.factor if isinstance(plan.factor, Column) else F.lit(plan.factor),
    })


def replayed_statistics(plan: Affine, run_time: int) -> dict[str, Column]:
    """The same numbers as aggregates over replayed records (``timestamps``, ``new_timestamps``).

    Usable in ``agg`` and in ``observe``, which collects them while the records are written.
    """
    old, new = F.map_values("timestamps"), F.map_values("new_timestamps")
    ceiling = plan.ceiling if plan.ceiling is not None else F.lit(None).cast("bigint")
    cut = F.size(F.filter(old, lambda t: plan.uncapped(F.unix_micros(t)) > ceiling))
    future = F.size(F.filter(new, lambda t: F.unix_micros(t) > F.lit(run_time)))
    return {
        "events": F.count(F.lit(1)),
        "events_modified": F.count_if(F.size("new_timestamps") > 0),
        "original_earliest": F.min(F.array_min(old)),
        "original_latest": F.max(F.array_max(old)),
        "new_earliest": F.min(F.array_min(new)),
        "new_latest": F.max(F.array_max(new)),
        "instants_in_future": F.coalesce(F.sum(future), F.lit(0)).cast("bigint"),
        "instants_at_ceiling": F.coalesce(F.sum(cut), F.lit(0)).cast("bigint"),
    }


def transformation_summary(stats: DataFrame, run_time: int, prevent_future: bool) -> DataFrame:
    """Spans before and after, and whether the ceiling was reached (within two seconds)."""
    gap = F.unix_micros("new_latest") - F.lit(run_time)
    hit = F.lit(prevent_future) & (F.abs(gap) < F.lit(2 * SECOND))
    return stats.select(
        span_hours(F.col("original_earliest"), F.col("original_latest")).alias("original_hours"),
        span_hours(F.col("new_earliest"), F.col("new_latest")).alias("new_hours"),
        F.coalesce(hit, F.lit(False)).alias("ceiling_hit"),
        F.col("events").alias("events_written"),
    )


def file_breakdown(df: DataFrame, instants: list[Column], plan: Affine, file: Column) -> DataFrame:
    """Events, original range and new range per file.

    The map is monotonic, so the new range is the moved original range: the instants are read and
    aggregated once.
    """
    ranges = range_by(df, instants, [file.alias("file")])
    return ranges.select(
        "file", "events",
        F.col("earliest").alias("original_start"), F.col("latest").alias("original_end"),
        plan.timestamp(F.col("earliest").cast("timestamp")).alias("new_start"),
        plan.timestamp(F.col("latest").cast("timestamp")).alias("new_end"),
    )


def histogram(
    df: DataFrame, us: list[Column], buckets: int = 10, bounds: tuple[int, int] | None = None
) -> DataFrame:
    """Equal buckets over the whole range, the last one closed, empty ones kept.

    ``bounds``, the earliest and latest instant, are those a plan was made from; without them a pass
    over the data finds them.

    ``us`` are instants in microseconds; every instant of a record counts. When all instants are
    equal there is one bucket and it counts records.
    """
    records = df.select(F.array_compact(F.array(*us)).alias("_us"))
    spark = df.sparkSession
    low, high = bounds or (None, None)
    if low is None or low == high:
        row = records.filter(F.size("_us") > 0).agg(
            F.min(F.array_min("_us")).alias("lo"),
            F.max(F.array_max("_us")).alias("hi"),
            F.count(F.lit(1)).alias("records"),
        ).first()
        low, high = row.lo, row.hi
    if low is None:
        return spark.range(0).select(
            F.lit(0).alias("bucket"), F.lit(None).cast("timestamp").alias("bucket_start"),
            F.lit(0).cast("bigint").alias("n"),
        )
    if low == high:
        return spark.range(1).select(
            F.lit(0).alias("bucket"), F.timestamp_micros(F.lit(low)).alias("bucket_start"),
            F.lit(row.records).cast("bigint").alias("n"),
        )
    width = ((high - low) / 1e6) / buckets
    offset = (F.col("us") - F.lit(low)).cast("double") / F.lit(1e6)
    index = F.least(F.floor(offset / F.lit(width)).cast("int"), F.lit(buckets - 1))
    counts = (
        records.select(F.explode("_us").alias("us"))
        .groupBy(index.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    start = F.lit(low) + epoch_micros(F.col("id").cast("double") * F.lit(width))
    grid = spark.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.timestamp_micros(start).alias("bucket_start")
    )
    # both sides hold at most one row per bucket
    return grid.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", "bucket_start", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def histogram_bars(counts: DataFrame, height: int = 8) -> DataFrame:
    """Scaled height and bar class of each bucket (one row per bucket in and out)."""
    top = F.max("n").over(W.partitionBy())
    scaled = F.floor(F.col("n") / top * F.lit(height)).cast("int")
    level = (
        F.when(F.col("n") == 0, "empty")
        .when(F.col("scaled") == 0, "trace")
        .when(F.col("scaled") < height // 3, "low")
        .when(F.col("scaled") < 2 * height // 3, "middle")
        .otherwise("high")
    )
    return counts.filter(F.col("n").isNotNull()).withColumn("scaled", scaled).withColumn("bar", level)


def histogram_labels(counts: DataFrame) -> DataFrame:
    """First, middle and last bucket in time order (none for fewer than three)."""
    order = F.row_number().over(W.orderBy("bucket_start")) - 1
    size = F.count(F.lit(1)).over(W.partitionBy())
    ranked = counts.withColumns({"_i": order, "_n": size}).filter(F.col("_n") >= 3)
    place = (
        F.when(F.col("_i") == 0, "first")
        .when(F.col("_i") == F.floor(F.col("_n") / 2), "middle")
        .when(F.col("_i") == F.col("_n") - 1, "last")
    )
    return (
        ranked.withColumn("place", place).filter(F.col("place").isNotNull()).drop("_i", "_n")
    )


def profile_totals(per_dataset: DataFrame) -> DataFrame:
    """Totals over datasets; one with an ``error`` is counted as failed and adds nothing."""
    ok = F.col("error").isNull()

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("bigint")

    return per_dataset.agg(
        F.count(F.lit(1)).alias("datasets"),
        total("events").alias("total_events"),
        total("events_modified").alias("total_modified"),
        F.count_if(~ok).alias("errors"),
    )
