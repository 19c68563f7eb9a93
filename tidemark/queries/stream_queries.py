"""The replay as a stream over files written from the events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.timeexpr import micros
from tidemark.plans.pattern_sets import Pattern
from tidemark.plans.shift_plan import ShiftPlan
from tidemark.queries.registry import (
    BOUNDS_SQL, RUN_SQL, RUN_US, bounds, clock, events, move, moved_sql, query, scratch, second, spread,
)
from tidemark.streaming import replay_stream as R


def _text(rows):
    text = F.to_json(F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"),
        clock(F.col("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(clock(second(F.col("us")), "MM/dd/yyyy hh:mm:ss a"), F.lit(" x")).alias("_raw"),
    ))
    return rows.select("us", text.alias("value"))


def _lines(spark, sf_dir):
    folder = scratch(spark)
    _text(events(spark, sf_dir).repartition(4, "event_id")).select("value").write.text(folder)
    return R.stream_lines(spark, folder, files_per_batch=2)


def _run(spark, stream, mode="append"):
    """Run a stream over what is there and read its table."""
    out = scratch(spark)
    if mode == "append":
        job = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
        job.trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state")
    job.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _shifted(spark, sf_dir):
    return _moved(_lines(spark, sf_dir), move(spark, sf_dir))


def _moved(lines, plan):
    moved = R.shift_json_lines(lines, plan, [Pattern("timestamp")])
    field = F.col("data")
    return moved.select(
        F.try_variant_get(field["id"], "$", "bigint").alias("event_id"),
        F.try_variant_get(field["type"], "$", "string").alias("type"),
        F.try_variant_get(field["_raw"], "$", "string").alias("raw"),
        F.col("timestamps")["timestamp"].alias("ts"), F.col("new_timestamps")["timestamp"].alias("new_ts"),
    )


@query("stream_shift", f"""
WITH {BOUNDS_SQL}
SELECT event_id, make_timestamp({moved_sql('epoch_us(ts)')}) AS new_ts,
  strftime(make_timestamp({moved_sql('(epoch_us(ts) // 1000000 * 1000000)')}), '%m/%d/%Y %I:%M:%S %p') || ' x' AS raw FROM events, b""")
def stream_shift(spark, sf_dir):
    """The stateless shift of a stream gives the rows of the batch shift."""
    return _run(spark, _shifted(spark, sf_dir)).select("event_id", "new_ts", "raw")


@query("stream_statistics", f"""
WITH {BOUNDS_SQL}
SELECT count(*) AS events, count(*) AS events_modified, min(ts) AS original_earliest, max(ts) AS original_latest,
  make_timestamp(min({moved_sql('epoch_us(ts)')})) AS new_earliest, make_timestamp(max({moved_sql('epoch_us(ts)')})) AS new_latest
FROM events, b""")
def stream_statistics(spark, sf_dir):
    stream = R.running_statistics(_shifted(spark, sf_dir), F.col("ts"), F.col("new_ts"))
    return _run(spark, stream, "complete")


# a target so late that some instants pass the run time and the ceiling holds others
_LATE = micros(datetime(2025, 5, 10))
_LATE_SQL = moved_sql("epoch_us(ts)", "epoch_us(TIMESTAMP '2025-05-10 00:00:00')")
_CEILING_SQL = "epoch_us(TIMESTAMP '2025-05-30 12:00:00')"


@query("stream_statistics_ceiling", f"""
WITH {BOUNDS_SQL}, m AS (SELECT ts, {_LATE_SQL} AS free, least({_LATE_SQL}, {_CEILING_SQL}) AS us FROM events, b)
SELECT count(*) AS events, count(*) AS events_modified, min(ts) AS original_earliest, max(ts) AS original_latest,
  make_timestamp(min(us)) AS new_earliest, make_timestamp(max(us)) AS new_latest,
  count_if(us > {RUN_SQL} - 259200000000) AS instants_in_future, count_if(free > {_CEILING_SQL}) AS instants_at_ceiling
FROM m""")
def stream_statistics_ceiling(spark, sf_dir):
    """All numbers of a run over a stream, those past a run time and those held at the ceiling among them."""
    plan = ShiftPlan(bounds(spark, sf_dir)[0], _LATE, 1.0, RUN_US - 2 * 86_400_000_000).affine()
    stream = _moved(_lines(spark, sf_dir), plan)
    return _run(spark, R.running_statistics(stream, F.col("ts"), F.col("new_ts"), plan, RUN_US - 3 * 86_400_000_000), "complete")


@query("stream_event_rate", f"""
WITH {BOUNDS_SQL}, m AS (SELECT event_type AS type, make_timestamp({moved_sql('epoch_us(ts)')}) AS new_ts FROM events, b),
w AS (SELECT date_trunc('millisecond', max(new_ts)) - INTERVAL 12 HOUR AS late FROM m)
SELECT time_bucket(INTERVAL 6 HOUR, new_ts) AS bucket_start, type, count(*) AS events FROM m, w
WHERE time_bucket(INTERVAL 6 HOUR, new_ts) + INTERVAL 6 HOUR <= late GROUP BY ALL""")
def stream_event_rate(spark, sf_dir):
    """Events per window of the new time, as windows close.

    The stream stops and goes on with rows of the first day once more: they come after the watermark
    and are left out.
    """
    folder, out = scratch(spark), scratch(spark)
    rows = _text(spread(events(spark, sf_dir).select("event_id", "event_type", "us")))
    first = bounds(spark, sf_dir)[0] + 86_400_000_000
    for part in (rows, rows.filter(F.col("us") < first)):
        part.select("value").write.mode("append").text(folder)
        # a rate needs the new instants, not the rewritten records
        moved = R.json_line_instants(R.stream_lines(spark, folder), move(spark, sf_dir), [Pattern("timestamp")])
        moved = moved.select(
            F.try_variant_get(F.col("data")["type"], "$", "string").alias("type"), F.col("new_timestamps")["timestamp"].alias("new_ts"),
        )
        rate = R.event_rate(moved, "new_ts", "6 hours", "12 hours", ["type"])
        job = rate.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-state")
        job.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rate.schema).parquet(out)
