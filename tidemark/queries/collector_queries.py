"""Records for an event collector."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import collector as C
from tidemark.queries.registry import SECOND_SQL, clock, events, query, second


def _records(spark, sf_dir):
    """JSON records with planted gaps: no raw text, no host, not JSON at all."""
    i = F.col("event_id")
    raw = F.when(F.pmod(i, F.lit(3)) == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"_raw":"raw '), i, F.lit('"'))
    )
    host = F.when(F.pmod(i, F.lit(4)) == 0, F.lit(',"host":null')).otherwise(F.lit(',"host":"h1"'))
    seconds = (second(F.col("us")) / 1_000_000).cast("bigint")
    time = F.when(F.pmod(i, F.lit(2)) == 0, seconds.cast("string")).otherwise(
        clock(second(F.col("us")), "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'")
    )
    text = F.concat(F.lit('{"_time":'), time, raw, host, F.lit(',"source":""}'))
    return events(spark, sf_dir).select(
        i, F.when(F.pmod(i, F.lit(10)) == 7, F.concat(F.lit("plain "), i)).otherwise(text).alias("text"),
        "event_type",
    )


_TEXT_SQL = f"""
t AS (SELECT event_id, event_type, {SECOND_SQL} // 1000000 AS s,
  '{{"_time":' || CASE WHEN event_id % 2 = 0 THEN ({SECOND_SQL} // 1000000)::VARCHAR
     ELSE strftime(make_timestamp({SECOND_SQL}), '"%Y-%m-%dT%H:%M:%SZ"') END
  || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"_raw":"raw ' || event_id || '"' END
  || CASE WHEN event_id % 4 = 0 THEN ',"host":null' ELSE ',"host":"h1"' END || ',"source":""}}' AS text,
  strftime(make_timestamp({SECOND_SQL}), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events)
"""
# the keys of a whole object are printed in sorted order
_ENVELOPE_SQL = f"""
WITH {_TEXT_SQL}
SELECT event_id, CASE WHEN event_id % 10 = 7 THEN
   '{{"event":"plain ' || event_id || '","sourcetype":"' || event_type || '","index":"main"}}' ELSE
  '{{"event":' || CASE WHEN event_id % 3 = 0 THEN
      '{{"_time":' || CASE WHEN event_id % 2 = 0 THEN s::VARCHAR ELSE '"' || iso || '"' END
      || CASE WHEN event_id % 4 = 0 THEN ',"host":null' ELSE ',"host":"h1"' END || ',"source":""}}'
    ELSE '"raw ' || event_id || '"' END
  || ',"time":' || s || '.000000' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"host":"h1"' END
  || ',"sourcetype":"' || event_type || '","index":"main"}}' END AS envelope FROM t"""


@query("collector_envelopes", _ENVELOPE_SQL)
def collector_envelopes(spark, sf_dir):
    made = C.envelopes(
        _records(spark, sf_dir), "text", C.EnvelopeOptions(index="main"), "event_type"
    )
    return made.select("event_id", "envelope")


@query("collector_overrides", """
SELECT event_id, 'h9' AS host, 's9' AS source, 'st9' AS sourcetype FROM events""")
def collector_overrides(spark, sf_dir):
    """Fixed options win over fields of the record."""
    options = C.EnvelopeOptions(default_host="h9", source="s9", sourcetype="st9")
    made = C.envelopes(_records(spark, sf_dir), "text", options, "event_type")
    return made.select("event_id", F.json_tuple("envelope", "host", "source", "sourcetype").alias("host", "source", "sourcetype"))


@query("collector_raw_lines", f"""
WITH {_TEXT_SQL} SELECT event_id, CASE WHEN event_id % 10 = 7 THEN 'plain ' || event_id
  WHEN event_id % 3 = 0 THEN text ELSE 'raw ' || event_id END AS line FROM t""")
def collector_raw_lines(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("data", C.parsed_event(F.col("text")))
    return rows.select("event_id", C.raw_line(F.col("text"), F.col("data")).alias("line"))


@query("collector_batches", """
SELECT 'event ' || event_id AS line, true AS within_limits FROM events""")
def collector_batches(spark, sf_dir):
    """Every line is in one body, and bodies stay within both limits."""
    lines = events(spark, sf_dir).select(F.concat(F.lit("event "), "event_id").alias("line"))
    bodies = C.pack(lines, "line", max_events=100, max_bytes=1000)
    rows = F.split("body", "\n", -1)
    fits = (F.col("events") <= 100) & (F.col("bytes") <= 1000) & (F.size(rows) == F.col("events"))
    fits = fits & (F.octet_length("body") + 1 == F.col("bytes"))
    return bodies.select(F.explode(rows).alias("line"), fits.alias("within_limits"))


@query("collector_dry_run", "SELECT count(*) AS events, least(count(*), 5) AS shown, true AS filled FROM events")
def collector_dry_run(spark, sf_dir):
    """A few envelopes to look at, and the count of all."""
    made = C.envelopes(_records(spark, sf_dir), "text", C.EnvelopeOptions())
    sample, counted = C.dry_run(made)
    seen = sample.agg(F.count(F.lit(1)).alias("shown"), F.every(F.col("envelope").startswith('{"event":')).alias("filled"))
    return counted.crossJoin(seen)
