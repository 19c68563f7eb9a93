"""The plan, the shift and its numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timeexpr import time_expression_micros
from tidemark.operators import shift, stats
from tidemark.operators.bounds import (
    NoTimestampsError, range_by, range_with_files, require_range, span_hours,
)
from tidemark.operators.lookups import effective_settings
from tidemark.plans.shift_plan import TimeSettings, plan_shift
from tidemark.queries.registry import (
    BOUNDS_SQL, RUN_SQL, RUN_US, SETTINGS, TARGET, TARGET_SQL, bounds, events, move, moved_sql, plan,
    query, table,
)


def _shifted(spark, sf_dir, settings):
    rows = shift.shift_columns(events(spark, sf_dir), move(spark, sf_dir, settings), {"ts": "new_ts"})
    return rows.select("event_id", "event_type", "ts", "new_ts")


@query("shift_events", f"""
WITH {BOUNDS_SQL}
SELECT event_id, event_type, ts, make_timestamp({moved_sql('epoch_us(ts)')}) AS new_ts
FROM events, b""")
def shift_events(spark, sf_dir):
    """Every instant moved to the target, gaps kept."""
    return _shifted(spark, sf_dir, SETTINGS)


def _ratio_sql(num: int, den: int, delta: str) -> str:
    """delta * num / den, rounded half to even, in 128-bit integers."""
    n = f"(({delta})::HUGEINT * {num})"
    q, r = f"({n} // {den}::HUGEINT)", f"abs({n} % {den}::HUGEINT)"
    up = f"(2 * {r} > {den}::HUGEINT OR (2 * {r} = {den}::HUGEINT AND {q} % 2 <> 0))"
    return f"({q} + CASE WHEN {up} THEN sign({n}) ELSE 0 END)::BIGINT"


def _factor_sql(factor: float) -> str:
    delta = _ratio_sql(*factor.as_integer_ratio(), "epoch_us(ts) - b.lo")
    return f"""
WITH {BOUNDS_SQL}
SELECT event_id, event_type, ts, make_timestamp({TARGET_SQL} + {delta}) AS new_ts FROM events, b"""


@query("shift_events_half", _factor_sql(0.5))
def shift_events_half(spark, sf_dir):
    return _shifted(spark, sf_dir, TimeSettings(0.5, target_time=TARGET))


@query("shift_events_double", _factor_sql(2.0))
def shift_events_double(spark, sf_dir):
    return _shifted(spark, sf_dir, TimeSettings(2.0, target_time=TARGET))


@query("shift_events_tenth", _factor_sql(0.1))
def shift_events_tenth(spark, sf_dir):
    """A factor that no binary fraction holds exactly."""
    return _shifted(spark, sf_dir, TimeSettings(0.1, target_time=TARGET))


@query("shift_events_third", _factor_sql(1 / 3))
def shift_events_third(spark, sf_dir):
    return _shifted(spark, sf_dir, TimeSettings(1 / 3, target_time=TARGET))


@query("shift_events_base_latest", f"""
WITH {BOUNDS_SQL}
SELECT event_id, event_type, ts,
       make_timestamp({TARGET_SQL} + epoch_us(ts) - (b.hi - 1800000000)) AS new_ts FROM events, b""")
def shift_events_base_latest(spark, sf_dir):
    """Half an hour before the latest instant goes to the target."""
    return _shifted(spark, sf_dir, TimeSettings(base_time="latest-30m", target_time=TARGET))


@query("shift_events_pulled_back", f"""
WITH {BOUNDS_SQL}
SELECT event_id, event_type, ts,
       make_timestamp({RUN_SQL} - (b.hi - b.lo) + epoch_us(ts) - b.lo) AS new_ts FROM events, b""")
def shift_events_pulled_back(spark, sf_dir):
    """The target would pass the ceiling, so the whole replay ends at it."""
    return _shifted(spark, sf_dir, TimeSettings(target_time="now-1h"))


@query("shift_events_declared_range", f"""
WITH b AS (SELECT epoch_us(TIMESTAMP '2024-01-05') AS lo, epoch_us(TIMESTAMP '2024-01-20') AS hi)
SELECT event_id, event_type, ts,
       make_timestamp(least({RUN_SQL}, {RUN_SQL} - (b.hi - b.lo) + epoch_us(ts) - b.lo)) AS new_ts
FROM events, b""")
def shift_events_declared_range(spark, sf_dir):
    """A declared time range replaces the scan; what lies behind it is held at the ceiling."""
    lo, hi = 1_704_412_800_000_000, 1_705_708_800_000_000
    fixed = plan_shift(TimeSettings(target_time="now"), lo, hi, RUN_US).affine()
    rows = shift.shift_columns(events(spark, sf_dir), fixed, {"ts": "new_ts"})
    return rows.select("event_id", "event_type", "ts", "new_ts")


@query("shift_events_uncapped", f"""
WITH {BOUNDS_SQL}
SELECT event_id, event_type, ts,
       make_timestamp({RUN_SQL} + 86400000000 + epoch_us(ts) - b.lo) AS new_ts FROM events, b""")
def shift_events_uncapped(spark, sf_dir):
    """Instants in the future are allowed."""
    return _shifted(spark, sf_dir, TimeSettings(target_time="now+1d", prevent_future=False))


@query("passthrough", "SELECT event_id, event_type, ts, ts AS new_ts FROM events")
def passthrough(spark, sf_dir):
    """No shift: no range is needed and nothing changes."""
    return events(spark, sf_dir).select("event_id", "event_type", "ts", F.col("ts").alias("new_ts"))


@query("shift_several_fields", f"""
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
           FROM lineitem GROUP BY l_orderkey),
     o AS (SELECT o_orderkey, o_orderdate, first_ship, last_ship
           FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
     b AS (SELECT least(min(epoch_us(o_orderdate)), min(epoch_us(first_ship))) AS lo FROM o)
SELECT o_orderkey, make_timestamp({TARGET_SQL} + epoch_us(o_orderdate) - lo) AS new_order,
       make_timestamp({TARGET_SQL} + epoch_us(first_ship) - lo) AS new_first,
       make_timestamp({TARGET_SQL} + epoch_us(last_ship) - lo) AS new_last
FROM o, b""")
def shift_several_fields(spark, sf_dir):
    """One range over all timestamp fields of a record, one move for all of them."""

    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # the range of the tables is the range of the join: no join is needed to find it
    lo_ship, hi_ship = require_range(table(spark, sf_dir, "lineitem"), [F.col("l_shipdate")])
    lo, hi = require_range(orders, [F.col("o_orderdate")])
    settings = TimeSettings(target_time=TARGET, prevent_future=False)
    fixed = plan_shift(settings, min(lo, lo_ship), max(hi, hi_ship), RUN_US).affine()
    moved = shift.shift_columns(
        rows, fixed, {"o_orderdate": "new_order", "first_ship": "new_first", "last_ship": "new_last"}
    )
    return moved.select("o_orderkey", "new_order", "new_first", "new_last")


@query("shift_by_field_deltas", """
SELECT event_id, ts + INTERVAL 1 HOUR AS new_ts, ts AS new_other FROM events""")
def shift_by_field_deltas(spark, sf_dir):
    """A delta per field; a field without one stays."""
    stamps = F.create_map(F.lit("ts"), F.col("ts"), F.lit("other"), F.col("ts"))
    moved = shift.shift_by_deltas(stamps, {"ts": 3_600_000_000, "absent": 5})
    return events(spark, sf_dir).select("event_id", moved.alias("m")).select(
        "event_id", F.col("m.ts").alias("new_ts"), F.col("m.other").alias("new_other")
    )


@query("shift_by_lookup", f"""
WITH {BOUNDS_SQL}, purchases AS (SELECT DISTINCT ts AS original FROM events WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN original IS NULL THEN ts
                      ELSE make_timestamp({moved_sql('epoch_us(ts)')}) END AS new_ts
FROM events LEFT JOIN purchases ON ts = original, b""")
def shift_by_lookup(spark, sf_dir):
    """Deltas stored per original instant (here those of purchases); others stay."""
    rows = events(spark, sf_dir)
    bought = rows.filter(F.col("event_type") == "purchase")
    lookup = shift.distinct_shifts(bought, [F.col("ts")], move(spark, sf_dir))
    return shift.shift_by_lookup(rows, "ts", lookup, "new_ts").select("event_id", "new_ts")


# ---------------------------------------------------------------------------------------------
# one plan per group

_GROUP_SQL = f"""
WITH s(event_type, delta_factor, base_time, target_us) AS (
  SELECT event_type, CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 1.0 END,
         CASE event_type WHEN 'error' THEN 'latest' ELSE 'auto' END,
         CASE event_type WHEN 'signup' THEN {RUN_SQL} - 3600000000 ELSE {TARGET_SQL} END
  FROM events GROUP BY event_type),
g AS (SELECT event_type, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY event_type),
p AS (SELECT event_type, delta_factor, target_us, CASE base_time WHEN 'latest' THEN hi ELSE lo END AS base, hi
      FROM s JOIN g USING (event_type)),
q AS (SELECT *, round_even(greatest(0, hi - base) * delta_factor::DECIMAL(4,1), 0)::BIGINT AS reach FROM p),
r AS (SELECT *, CASE WHEN target_us + reach > {RUN_SQL} THEN {RUN_SQL} - reach ELSE target_us END AS new_base
      FROM q)
"""


def _group_plans(spark, sf_dir):
    kind = F.col("event_type")
    rows = events(spark, sf_dir)
    datasets = rows.select("event_type").distinct().select(
        "event_type",
        F.when(kind == "click", 0.5).when(kind == "view", 2.0).alias("delta_factor"),
        F.when(kind == "error", "latest").alias("base_time"),
        F.when(kind == "signup", "now-1h").alias("target_time"),
    )
    settings = effective_settings(
        datasets, {"target_time": TARGET}, {"ceiling_time": "now"},
        {"delta_factor": 1.0, "base_time": "auto", "prevent_future": True},
    )
    return shift.plan_by_group(rows, [F.col("ts")], "event_type", settings, RUN_US)


@query("plan_per_group", _GROUP_SQL + """
SELECT event_type, make_timestamp(base) AS base, make_timestamp(new_base) AS new_base,
       delta_factor::DOUBLE AS factor FROM r""")
def plan_per_group(spark, sf_dir):
    return _group_plans(spark, sf_dir).select(
        "event_type", F.timestamp_micros("base_us").alias("base"),
        F.timestamp_micros("new_base_us").alias("new_base"), "factor",
    )


@query("shift_per_group", _GROUP_SQL + f"""
SELECT event_id, e.event_type, make_timestamp(least({RUN_SQL}, new_base
       + round_even((epoch_us(ts) - base) * delta_factor::DECIMAL(4,1), 0)::BIGINT)) AS new_ts
FROM events e JOIN r USING (event_type)""")
def shift_per_group(spark, sf_dir):
    """Every group is replayed with its own range and settings."""
    moved = shift.shift_by_group(
        events(spark, sf_dir), _group_plans(spark, sf_dir), "event_type", {"ts": "new_ts"}
    )
    return moved.select("event_id", "event_type", "new_ts")


_NULL_GROUP_SQL = f"""
WITH e AS (SELECT event_id, ts, nullif(event_type, 'error') AS kind FROM events),
g AS (SELECT kind, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM e GROUP BY kind),
p AS (SELECT kind, lo, CASE WHEN kind = 'view' THEN {TARGET_SQL} ELSE {RUN_SQL} END AS target, hi - lo AS reach FROM g),
r AS (SELECT kind, lo, CASE WHEN target + reach > {RUN_SQL} THEN {RUN_SQL} - reach ELSE target END AS new_base FROM p)
"""


@query("shift_null_group", _NULL_GROUP_SQL + """
SELECT event_id, e.kind, make_timestamp(new_base + epoch_us(ts) - lo) AS new_ts FROM e JOIN r ON e.kind IS NOT DISTINCT FROM r.kind""")
def shift_null_group(spark, sf_dir):
    """Events without a group are one, and a group without settings is replayed by the defaults."""
    rows = events(spark, sf_dir).select("event_id", "ts", F.nullif("event_type", F.lit("error")).alias("kind"))
    own = effective_settings(
        spark.createDataFrame([("view",)], "kind string"), {"target_time": TARGET}, None,
        {"delta_factor": 1.0, "base_time": "auto", "prevent_future": True, "ceiling_time": "now"},
    )
    plans = shift.plan_by_group(rows, [F.col("ts")], "kind", own, RUN_US)
    return shift.shift_by_group(rows, plans, "kind", {"ts": "new_ts"}).select("event_id", "kind", "new_ts")


@query("profile_run", _GROUP_SQL + f"""
SELECT event_type, count(*) AS events, count(*) AS events_modified, min(ts) AS original_earliest,
  max(ts) AS original_latest,
  make_timestamp(least({RUN_SQL}, new_base + round_even((min(epoch_us(ts)) - base) * delta_factor::DECIMAL(4,1), 0)::BIGINT)) AS new_earliest,
  make_timestamp(least({RUN_SQL}, new_base + round_even((max(epoch_us(ts)) - base) * delta_factor::DECIMAL(4,1), 0)::BIGINT)) AS new_latest,
  NULL::VARCHAR AS error
FROM events JOIN r USING (event_type) GROUP BY event_type, new_base, base, delta_factor""")
def profile_run(spark, sf_dir):
    """The result of a profile: each dataset with its own plan."""
    rows = events(spark, sf_dir)
    return shift.group_results(rows, [F.col("ts")], _group_plans(spark, sf_dir), "event_type")


# ---------------------------------------------------------------------------------------------
# time expressions


def _expression(us_id):
    anchor = F.element_at(F.array(*map(F.lit, ("now", "Earliest", "LATEST"))), F.pmod(us_id, F.lit(3)).cast("int") + 1)
    unit = F.element_at(
        F.array(*map(F.lit, ("s", "m", "h", "d", "w", "mon", "y"))), F.pmod(us_id, F.lit(7)).cast("int") + 1
    )
    count = F.pmod(us_id, F.lit(5)).cast("string")
    relative = F.concat(anchor, F.lit("+"), count, unit, F.lit("-90m"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.pmod(us_id, F.lit(11)) == 0, iso).otherwise(relative)


@query("time_expressions", f"""
WITH {BOUNDS_SQL}
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN date_trunc('second', ts) ELSE make_timestamp(
  CASE event_id % 3 WHEN 0 THEN {RUN_SQL} WHEN 1 THEN b.lo ELSE b.hi END
  + (event_id % 5) * CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400
      WHEN 4 THEN 604800 WHEN 5 THEN 2592000 ELSE 31536000 END * 1000000
  - 5400000000) END AS resolved
FROM events, b""")
def time_expressions(spark, sf_dir):
    """An expression per row, resolved against the range of all events and the run time."""
    lo, hi = bounds(spark, sf_dir)
    us = time_expression_micros(
        _expression(F.col("event_id")), F.lit(RUN_US), F.lit(lo), F.lit(hi)
    )
    return events(spark, sf_dir).select("event_id", F.timestamp_micros(us).alias("resolved"))


# ---------------------------------------------------------------------------------------------
# numbers


@query("time_range", """
SELECT count(*) AS events, min(ts) AS earliest, max(ts) AS latest,
       arg_min(event_type, ts) AS earliest_file, arg_max(event_type, ts) AS latest_file FROM events""")
def time_range(spark, sf_dir):
    """The range of all events and the file (here: type) that holds each end."""
    return range_with_files(table(spark, sf_dir, "events"), [F.col("ts")], F.col("event_type"))


@query("no_timestamp_error", """
SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) = 0 AS refused
FROM documents GROUP BY lang""")
def no_timestamp_error(spark, sf_dir):
    """A plan is refused for records without a readable instant (here: texts, by language)."""
    docs = table(spark, sf_dir, "documents").select("lang", F.to_timestamp(F.when(F.col("text").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("text"))).alias("ts"))
    try:
        require_range(docs, [F.col("ts")])
        refused = False
    except NoTimestampsError:
        refused = True
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).withColumn("refused", F.lit(refused))


@query("time_range_several_fields", """
SELECT o_orderpriority AS priority, count(*) AS events,
       min(least(o_orderdate, coalesce(l_shipdate, o_orderdate))) AS earliest,
       max(greatest(o_orderdate, coalesce(l_shipdate, o_orderdate))) AS latest
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def time_range_several_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"),
        F.col("o_orderkey") == F.col("l_orderkey"), "left",
    )
    instants = [F.col("o_orderdate"), F.col("l_shipdate")]
    return range_by(rows, instants, [F.col("o_orderpriority").alias("priority")])


_STATS_SQL = f"""
WITH b AS (SELECT epoch_us(TIMESTAMP '2024-01-05') AS lo, epoch_us(TIMESTAMP '2024-01-20') AS hi),
m AS (SELECT ts, {RUN_SQL} - (b.hi - b.lo) + epoch_us(ts) - b.lo AS free FROM events, b),
s AS (SELECT count(*) AS events, count(*) AS events_modified, 0::BIGINT AS errors,
  min(ts) AS original_earliest, max(ts) AS original_latest,
  make_timestamp(min(least(free, {RUN_SQL}))) AS new_earliest,
  make_timestamp(max(least(free, {RUN_SQL}))) AS new_latest,
  0::BIGINT AS instants_in_future, count(*) FILTER (free > {RUN_SQL}) AS instants_at_ceiling,
  0::BIGINT AS events_in_future, TIMESTAMP '2024-01-05' AS original_base,
  make_timestamp({RUN_SQL} - (SELECT hi - lo FROM b)) AS new_base, 1.0::DOUBLE AS delta_factor FROM m)
"""


def _stats(spark, sf_dir):
    lo, hi = 1_704_412_800_000_000, 1_705_708_800_000_000
    fixed = plan_shift(TimeSettings(target_time="now"), lo, hi, RUN_US).affine()
    return stats.run_statistics(events(spark, sf_dir), [F.col("us")], fixed, RUN_US)


@query("run_statistics", _STATS_SQL + "SELECT * FROM s")
def run_statistics(spark, sf_dir):
    """All counters of a run that is partly held at the ceiling."""
    return _stats(spark, sf_dir)


@query("run_statistics_future", f"""
WITH {BOUNDS_SQL},
m AS (SELECT ts, {RUN_SQL} - 86400000000 + epoch_us(ts) - b.lo AS new FROM events, b)
SELECT count(*) AS events, count(*) AS events_modified,
       count(*) FILTER (new > {RUN_SQL}) AS instants_in_future, 0::BIGINT AS instants_at_ceiling,
       count(*) FILTER (new > {RUN_SQL} + 1000000) AS events_in_future FROM m""")
def run_statistics_future(spark, sf_dir):
    """Instants after the run time are counted without a ceiling too."""
    free = move(spark, sf_dir, TimeSettings(target_time="now-1d", prevent_future=False))
    row = stats.run_statistics(events(spark, sf_dir), [F.col("us")], free, RUN_US)
    return row.select(
        "events", "events_modified", "instants_in_future", "instants_at_ceiling", "events_in_future"
    )


@query("transformation_summary", _STATS_SQL + f"""
SELECT (epoch_us(original_latest) - epoch_us(original_earliest)) / 3.6e9 AS original_hours,
       (epoch_us(new_latest) - epoch_us(new_earliest)) / 3.6e9 AS new_hours,
       abs(epoch_us(new_latest) - {RUN_SQL}) < 2000000 AS ceiling_hit, events AS events_written FROM s""")
def transformation_summary(spark, sf_dir):
    return stats.transformation_summary(_stats(spark, sf_dir), RUN_US, True)


@query("time_span", """
SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM events GROUP BY event_type""")
def time_span(spark, sf_dir):
    ranges = range_by(table(spark, sf_dir, "events"), [F.col("ts")], [F.col("event_type")])
    return ranges.select("event_type", span_hours(F.col("earliest"), F.col("latest")).alias("hours"))


def _histogram_sql(n: int) -> str:
    return f"""
WITH {BOUNDS_SQL}, w AS (SELECT lo, ((hi - lo) / 1e6) / {n} AS width FROM b),
c AS (SELECT least(floor(((epoch_us(ts) - lo) / 1e6) / width)::INT, {n - 1}) AS bucket, count(*) AS n
      FROM events, w GROUP BY 1),
h AS (SELECT i::INT AS bucket,
  make_timestamp(lo + floor(i * width)::BIGINT * 1000000
                 + round_even((i * width - floor(i * width)) * 1e6, 0)::BIGINT) AS bucket_start,
  coalesce(n, 0) AS n FROM w, range({n}) t(i) LEFT JOIN c ON c.bucket = i)
"""


@query("histogram", _histogram_sql(24) + "SELECT * FROM h")
def histogram(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir), [F.col("us")], 24, bounds(spark, sf_dir))


@query("histogram_bars", _histogram_sql(10) + """
SELECT bucket, bucket_start, n, scaled, CASE WHEN n = 0 THEN 'empty' WHEN scaled = 0 THEN 'trace'
  WHEN scaled < 2 THEN 'low' WHEN scaled < 5 THEN 'middle' ELSE 'high' END AS bar
FROM (SELECT *, floor(n / max(n) OVER () * 8)::INT AS scaled FROM h)""")
def histogram_bars(spark, sf_dir):
    return stats.histogram_bars(stats.histogram(events(spark, sf_dir), [F.col("us")], 10), 8)


@query("histogram_labels", _histogram_sql(10) + """
SELECT bucket, bucket_start, n, CASE bucket WHEN 0 THEN 'first' WHEN 5 THEN 'middle' ELSE 'last' END AS place
FROM h WHERE bucket IN (0, 5, 9)""")
def histogram_labels(spark, sf_dir):
    return stats.histogram_labels(stats.histogram(events(spark, sf_dir), [F.col("us")], 10))


@query("file_breakdown", f"""
WITH {BOUNDS_SQL}
SELECT event_type AS file, count(*) AS events, min(ts) AS original_start, max(ts) AS original_end,
       make_timestamp(min({moved_sql('epoch_us(ts)')})) AS new_start,
       make_timestamp(max({moved_sql('epoch_us(ts)')})) AS new_end
FROM events, b GROUP BY event_type""")
def file_breakdown(spark, sf_dir):
    """Per file: events, range before and after."""
    rows = events(spark, sf_dir)
    return stats.file_breakdown(rows, [F.col("ts")], move(spark, sf_dir), F.col("event_type"))


@query("profile_totals", """
WITH d AS (SELECT user_id % 7 AS dataset, count(*) AS events,
                  count(*) FILTER (event_type <> 'error') AS modified FROM events GROUP BY 1)
SELECT count(*) AS datasets, coalesce(sum(events) FILTER (dataset <> 3), 0)::BIGINT AS total_events,
       coalesce(sum(modified) FILTER (dataset <> 3), 0)::BIGINT AS total_modified,
       count(*) FILTER (dataset = 3) AS errors FROM d""")
def profile_totals(spark, sf_dir):
    """Sums over datasets; a failed one is counted and adds nothing."""
    key = F.pmod("user_id", F.lit(7)).alias("dataset")
    per_dataset = events(spark, sf_dir).groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") != "error").alias("events_modified"),
    ).withColumn("error", F.when(F.col("dataset") == 3, "unreadable"))
    return stats.profile_totals(per_dataset)


@query("instant_counters", f"""
WITH {BOUNDS_SQL}
SELECT event_id, (CASE WHEN {RUN_SQL} - 86400000000 + epoch_us(ts) - b.lo > {RUN_SQL} THEN 1 ELSE 0 END)::INT
       AS instants_in_future, 0::INT AS instants_at_ceiling FROM events, b""")
def instant_counters(spark, sf_dir):
    free = move(spark, sf_dir, TimeSettings(target_time="now-1d", prevent_future=False))
    counters = shift.shift_counters([F.col("us")], free, RUN_US)
    return events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in counters.items()])


@query("plan_numbers", f"""
WITH {BOUNDS_SQL}
SELECT make_timestamp(lo) AS base, make_timestamp({RUN_SQL} - (hi - lo)) AS new_base,
       TIMESTAMP '2025-06-01 12:00:00' AS ceiling FROM b""")
def plan_numbers(spark, sf_dir):
    """Base, new base and ceiling of a plan, as a row."""
    p = plan(spark, sf_dir, TimeSettings(target_time="now-1h"))
    found = table(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp").alias("base"))
    return found.select(
        "base", F.timestamp_micros(F.lit(p.new_base)).alias("new_base"),
        F.timestamp_micros(F.lit(p.ceiling)).alias("ceiling"),
    )
