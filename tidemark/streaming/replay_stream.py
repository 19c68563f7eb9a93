"""Stateless shift of a stream of records, and running numbers over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.affine import Affine
from tidemark.operators.extract import Found, instants, json_object, map_reader
from tidemark.operators.rawtext import shift_raw
from tidemark.operators.stats import replayed_statistics
from tidemark.operators.writeback import moved_instants, shift_found
from tidemark.plans.pattern_sets import Pattern


def stream_lines(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files below ``path`` as a stream of lines."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("value").alias("line"))


def shift_lines(lines: DataFrame, plan: Affine, sourcetype: str | None = None) -> DataFrame:
    """Move the instants inside text lines. The same function serves batch and stream."""
    return shift_raw(lines, "line", plan, sourcetype)


def shift_json_lines(
    lines: DataFrame, plan: Affine, patterns: Sequence[Pattern], sourcetype: str | None = None
) -> DataFrame:
    """Replay JSON lines: ``data``, ``timestamps``, ``new_timestamps`` and the new ``line``."""
    staged, found = _instants(lines, patterns)
    moved = shift_found(staged, found, plan, sourcetype=sourcetype)
    return moved.withColumn("line", F.to_json("data"))


def json_line_instants(lines: DataFrame, plan: Affine, patterns: Sequence[Pattern]) -> DataFrame:
    """The same instants without the rewritten records, for numbers about them: ``data`` as read, ``timestamps``, ``new_timestamps``."""
    return moved_instants(*_instants(lines, patterns), plan)


def _instants(lines: DataFrame, patterns: Sequence[Pattern]) -> tuple[DataFrame, list[Found]]:
    parsed = lines.withColumn("data", F.explode(F.array_compact(F.array(json_object(F.col("line"))))))
    return instants(parsed, map_reader(F.col("data")), patterns)


def running_statistics(
    shifted: DataFrame, old: Column, new: Column, plan: Affine | None = None, run_time: int | None = None
) -> DataFrame:
    """Counts and ranges so far, for a sink in complete or update mode.

    With a ``plan`` and a ``run_time`` (microseconds) also the instants past the run time and those held
    at the ceiling, and with them the columns of :func:`tidemark.operators.stats.replayed_statistics`.
    """
    counts = {
        "events": F.count(F.lit(1)),
        "events_modified": F.count(new),
        "original_earliest": F.min(old), "original_latest": F.max(old),
        "new_earliest": F.min(new), "new_latest": F.max(new),
    }
    if plan is not None and run_time is not None:
        ceiling = plan.ceiling if plan.ceiling is not None else F.lit(None).cast("bigint")
        counts["instants_in_future"] = F.count_if(F.unix_micros(new.cast("timestamp")) > F.lit(run_time))
        counts["instants_at_ceiling"] = F.count_if(plan.uncapped(F.unix_micros(old.cast("timestamp"))) > ceiling)
    return shifted.groupBy().agg(*[c.alias(n) for n, c in counts.items()])


def batch_statistics(shifted: DataFrame, plan: Affine, run_time: int, name: str = "replay") -> DataFrame:
    """``shifted`` (``timestamps``, ``new_timestamps``) with the numbers of each batch observed as it passes.

    They arrive at a :class:`BatchNumbers` listener under ``name``; the stream keeps no state for them.
    """
    return shifted.observe(name, *[c.alias(n) for n, c in replayed_statistics(plan, run_time).items()])


class BatchNumbers(StreamingQueryListener):
    """Collects the observed numbers of every batch, a small row each, in order."""

    def __init__(self, name: str = "replay"):
        self.name = name
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            self.batches.append({"batch": event.progress.batchId, **found.asDict()})


def event_rate(
    shifted: DataFrame, new: str, bucket: str, late: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Events per tumbling window of the new time; rows later than ``late`` are left out.

    Partial counts are merged per window before the exchange; state is one row per open window and
    key, and closed windows leave it.
    """
    return (
        shifted.withWatermark(new, late)
        .groupBy(F.window(new, bucket), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("bucket_start"), *keys, "events")
    )
