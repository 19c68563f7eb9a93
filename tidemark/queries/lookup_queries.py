"""Lookups, precedence and closures, over catalogs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dependencies as D
from tidemark.operators import lookups as L
from tidemark.queries.registry import events, query, table

_NAMES = ("Suricata", "osquery:results", "PAN:TRAFFIC", "stream:dns", "WinEventLog:New", "mysql:x", "nothing")


def _named(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    return events(spark, sf_dir).select(
        "event_id", F.get(names, F.pmod("event_id", F.lit(len(_NAMES))).cast("int")).alias("sourcetype")
    )


@query("sourcetype_of_file", """
SELECT event_id, event_type || '.jsonl' AS file_name,
       CASE WHEN event_type = 'view' THEN NULL ELSE 'web:' || upper(event_type) END AS sourcetype FROM events""")
def sourcetype_of_file(spark, sf_dir):
    """Files are looked up by name; one listed twice takes the later entry, one not listed nothing."""
    rows = events(spark, sf_dir).withColumn("file_name", F.concat("event_type", F.lit(".jsonl")))
    kinds = rows.groupBy("event_type").agg(F.min("event_id").alias("first"))
    kinds = kinds.filter(F.col("event_type") != "view")
    name = F.concat("event_type", F.lit(".jsonl")).alias("file_name")
    early = kinds.select(name, F.lit("old").alias("sourcetype"), F.lit(0).alias("position"))
    late = kinds.select(name, F.concat(F.lit("web:"), F.upper("event_type")).alias("sourcetype"), F.lit(1).alias("position"))
    return L.file_sourcetypes(rows, early.unionByName(late)).select("event_id", "file_name", "sourcetype")


@query("registered_patterns", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'timestamp,unixTime' WHEN 2 THEN 'generated_time'
  ELSE NULL END AS fields FROM events""")
def registered_patterns(spark, sf_dir):
    """Patterns of a sourcetype: exact name, then any letter case."""
    found = L.registered_patterns(_named(spark, sf_dir), "sourcetype")
    fields = F.array_join(F.transform("patterns", lambda p: p["field"]), ",")
    return found.select("event_id", fields.alias("fields"))


@query("sourcetype_families", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'iso8601,fortigate,syslog,us_date,epoch,datetime' WHEN 1 THEN 'ctime,epoch'
  WHEN 2 THEN 'iso8601,fortigate,syslog,us_date,epoch,datetime' WHEN 3 THEN 'iso8601' WHEN 4 THEN 'us_date'
  WHEN 5 THEN '' ELSE 'iso8601,fortigate,syslog,us_date,epoch,datetime' END AS families FROM events""")
def sourcetype_families(spark, sf_dir):
    """Notations of a sourcetype: exact name, name prefix, default."""
    found = L.sourcetype_families(_named(spark, sf_dir), "sourcetype")
    return found.select("event_id", F.array_join("families", ",").alias("families"))


@query("uncovered_references", """
SELECT o_orderkey AS reference, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'p' || (o_custkey % 40) END AS sourcetype
FROM orders WHERE o_orderkey % 9 = 0 OR o_custkey % 40 NOT IN (SELECT p_size FROM part WHERE p_size < 30)""")
def uncovered_references(spark, sf_dir):
    """References whose sourcetype no bundled file has; those without one are kept."""
    references = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("reference"),
        F.when(F.pmod("o_orderkey", F.lit(9)) != 0, F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(40)))).alias("sourcetype"),
    )
    bundled = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") < 30, F.concat(F.lit("p"), "p_size")).alias("sourcetype")
    )
    return L.uncovered_references(references, bundled).select("reference", "sourcetype")


@query("distinct_sourcetypes", """
SELECT DISTINCT p_brand || ':' || p_type AS sourcetype FROM part""")
def distinct_sourcetypes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("sourcetype")).distinct()


def _edges(spark, sf_dir):
    """Every part depends on the part of half its key; the first two depend on each other."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dataset"))
    return parts.select(
        "dataset",
        F.when(F.col("dataset") == 0, 1).otherwise(F.floor(F.col("dataset") / 2)).cast("bigint").alias("dependency"),
    )


_EDGES_SQL = """
e AS (SELECT p_partkey AS dataset, CASE WHEN p_partkey = 0 THEN 1 ELSE p_partkey // 2 END AS dependency FROM part)"""


@query("dependency_closure", f"""
WITH RECURSIVE {_EDGES_SQL},
c AS (SELECT p_partkey AS root, p_partkey AS dataset, 0 AS depth FROM part
      UNION ALL SELECT root, dependency, depth + 1 FROM c JOIN e USING (dataset) WHERE depth < 40)
SELECT root, dataset, min(depth)::INT AS depth FROM c GROUP BY root, dataset""")
def dependency_closure(spark, sf_dir):
    """All dependencies of all datasets with their depth; the cycle at the bottom ends the walk."""
    return D.dependency_closure(_edges(spark, sf_dir))


@query("merged_defaults", """
WITH RECURSIVE e AS (
  SELECT p_partkey AS dataset, p_partkey // 3 AS dependency, 0 AS position FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, p_partkey // 7, 1 FROM part WHERE p_partkey > 0 AND p_partkey % 2 = 0 AND p_partkey // 7 <> p_partkey // 3),
c AS (SELECT p_partkey AS root, p_partkey AS dataset, []::INT[] AS places FROM part
      UNION ALL SELECT root, dependency, list_append(places, position) FROM c JOIN e USING (dataset)),
s AS (SELECT root, 'replay.f' || (dataset % 4) AS path, p_brand AS value, list_append(places, 2147483647) AS priority, dataset
      FROM c JOIN part ON dataset = p_partkey)
SELECT root, path, arg_max(value, priority) AS value FROM s GROUP BY root, path""")
def merged_defaults(spark, sf_dir):
    """Defaults of a dataset and its dependencies, up to two each, merged by path.

    Dependencies count in order, the later over the earlier, each after its own; the dataset counts last.
    """
    parts = table(spark, sf_dir, "part").withColumn("dataset", F.col("p_partkey"))
    third, seventh = (F.floor(F.col("p_partkey") / n).cast("bigint") for n in (3, 7))
    one = parts.filter("p_partkey > 0").select("dataset", third.alias("dependency"), F.lit(0).alias("position"))
    two = parts.filter((F.col("p_partkey") > 0) & (F.pmod("p_partkey", F.lit(2)) == 0) & (third != seventh))
    edges = one.unionByName(two.select("dataset", seventh.alias("dependency"), F.lit(1).alias("position")))
    own = parts.select(
        "dataset", F.concat(F.lit("replay.f"), F.pmod("p_partkey", F.lit(4))).alias("path"), F.col("p_brand").alias("value"),
    )
    return D.merged_defaults(edges, own).withColumnRenamed("dataset", "root")


@query("dependency_closure_of_roots", f"""
WITH RECURSIVE {_EDGES_SQL},
c AS (SELECT p_partkey AS root, p_partkey AS dataset, 0 AS depth FROM part WHERE p_size > 40
      UNION ALL SELECT root, dependency, depth + 1 FROM c JOIN e USING (dataset) WHERE depth < 40)
SELECT root, dataset, min(depth)::INT AS depth FROM c GROUP BY root, dataset""")
def dependency_closure_of_roots(spark, sf_dir):
    """Dependencies of some datasets, level by level."""
    parts = table(spark, sf_dir, "part").filter("p_size > 40")
    return D.dependency_closure(_edges(spark, sf_dir), parts.select(F.col("p_partkey").alias("dataset")))


def _releases(spark, sf_dir):
    """Up to five releases of every part, and what each of them needs: ranges, a shared dependency, a cycle at 1 and 2."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dataset"))
    majors = F.explode(F.sequence(F.lit(1), (1 + F.pmod("dataset", F.lit(5))).cast("int"))).alias("major")
    every = parts.filter("dataset % 97 <> 13").select("dataset", majors)
    every = every.select("dataset", "major", F.concat("major", F.lit("."), F.pmod(F.col("dataset") + F.col("major"), F.lit(3)), F.lit(".0")).alias("version"))
    low = F.when(F.col("dataset") == 1, 2).otherwise(F.floor(F.col("dataset") / 2)).cast("bigint")
    first = every.filter("dataset > 0").select(
        "dataset", "version", low.alias("dependency"),
        F.when(F.pmod("dataset", F.lit(7)) == 0, F.concat(F.lit("<"), F.col("major") + 1, F.lit(".0.0")))
        .when(F.pmod("dataset", F.lit(3)) == 0, F.concat(F.lit(">="), F.floor((F.col("major") + 1) / 2), F.lit(".0.0")))
        .otherwise("*").alias("constraint"),
    )
    second = every.filter("dataset > 2 AND dataset % 2 = 1").select(
        "dataset", "version", F.floor(F.col("dataset") / 3).cast("bigint").alias("dependency"),
        F.when(F.pmod("dataset", F.lit(5)) == 0, F.concat("major", F.lit(".x"))).otherwise(F.lit("<=4.9.0")).alias("constraint"),
    )
    return every.select("dataset", "version"), first.unionByName(second), parts.withColumn("constraint", F.lit(None).cast("string"))


# the state of a round is the set of constraints met so far; each round adds the needs of the releases chosen by it
_VERSIONS_SQL = """
rel AS MATERIALIZED (
  SELECT dataset, major, (dataset + major) % 3 AS minor FROM (
    SELECT p_partkey AS dataset, unnest(range(1, (2 + p_partkey % 5)::BIGINT)) AS major FROM part WHERE p_partkey % 97 <> 13)),
need AS MATERIALIZED (
  SELECT dataset, major, CASE WHEN dataset = 1 THEN 2 ELSE dataset // 2 END AS dependency,
         CASE WHEN dataset % 7 = 0 THEN '<' || (major + 1) || '.0.0' WHEN dataset % 3 = 0 THEN '>=' || ((major + 1) // 2) || '.0.0' ELSE '*' END AS con
  FROM rel WHERE dataset > 0
  UNION SELECT dataset, major, dataset // 3, CASE WHEN dataset % 5 = 0 THEN major || '.x' ELSE '<=4.9.0' END
  FROM rel WHERE dataset > 2 AND dataset % 2 = 1),
cons AS MATERIALIZED (SELECT DISTINCT dependency AS dataset, con FROM need UNION SELECT p_partkey, '*' FROM part),
allowed AS MATERIALIZED (
  SELECT dataset, con, major, minor FROM cons JOIN rel USING (dataset)
  WHERE con = '*' OR (con = '<=4.9.0' AND (major, minor) <= (4, 9)) OR (con LIKE '%.x' AND major = string_split(con, '.')[1]::BIGINT)
     OR (con LIKE '>=%' AND major >= string_split(con[3:], '.')[1]::BIGINT)
     OR (con LIKE '<%' AND con NOT LIKE '<=%' AND major < string_split(con[2:], '.')[1]::BIGINT)),
met AS (
  SELECT 0 AS level, p_partkey AS root, p_partkey AS dataset, '*' AS con FROM part
  UNION ALL
  SELECT DISTINCT level + 1, root, dataset, con FROM (
    SELECT level, root, dataset, con FROM met
    UNION ALL
    SELECT p.level, p.root, n.dependency, n.con FROM (
      SELECT level, root, dataset, max(major) AS major FROM (
        SELECT m.level, m.root, m.dataset, a.major, count(*) AS satisfied, any_value(m.total) AS total
        FROM (SELECT *, count(*) OVER (PARTITION BY root, dataset) AS total FROM met) m
        JOIN allowed a ON a.dataset = m.dataset AND a.con = m.con GROUP BY m.level, m.root, m.dataset, a.major)
      WHERE satisfied = total GROUP BY level, root, dataset) p
    JOIN need n ON n.dataset = p.dataset AND n.major = p.major)
  WHERE level < 24),
last AS (SELECT root, dataset, con, count(*) OVER (PARTITION BY root, dataset) AS total FROM met WHERE level = 24),
fits AS (
  SELECT root, dataset, major, minor FROM (
    SELECT l.root, l.dataset, a.major, a.minor, count(*) AS satisfied, any_value(total) AS total
    FROM last l JOIN allowed a ON a.dataset = l.dataset AND a.con = l.con GROUP BY ALL)
  WHERE satisfied = total),
best AS (SELECT root, dataset, max(major) AS major, arg_max(minor, major) AS minor FROM fits GROUP BY root, dataset),
resolved AS (
  SELECT l.root, l.dataset, CASE WHEN b.major IS NOT NULL THEN b.major || '.' || b.minor || '.0' END AS version, l.total AS constraints,
         CASE WHEN l.dataset % 97 = 13 THEN 'missing' WHEN b.major IS NULL THEN 'conflict' END AS problem
  FROM (SELECT DISTINCT root, dataset, total FROM last) l LEFT JOIN best b USING (root, dataset))
"""


@query("dependency_versions", f"""
WITH RECURSIVE {_VERSIONS_SQL}
SELECT root, dataset, version, constraints, problem FROM resolved""")
def dependency_versions(spark, sf_dir):
    """The releases below every dataset that satisfy all constraints met on the way."""
    return D.resolve_versions(*_releases(spark, sf_dir)).datasets


@query("dependency_conflicts", f"""
WITH RECURSIVE {_VERSIONS_SQL}
SELECT root, dataset, con AS "constraint", problem FROM last JOIN resolved USING (root, dataset) WHERE problem IS NOT NULL""")
def dependency_conflicts(spark, sf_dir):
    """Datasets without a fitting release, a row per constraint that was met."""
    return D.resolve_versions(*_releases(spark, sf_dir)).conflicts()


@query("replay_settings", """
SELECT event_type, 3.0::DOUBLE AS delta_factor,
       CASE WHEN event_type IN ('click', 'view') THEN 'latest' ELSE 'earliest' END AS base_time,
       'now-1d' AS target_time, true AS prevent_future FROM events GROUP BY event_type""")
def replay_settings(spark, sf_dir):
    """Override, dataset, profile, default: the first that is set, field by field."""
    kinds = events(spark, sf_dir).select("event_type").distinct()
    datasets = kinds.withColumn("base_time", F.when(F.col("event_type").isin("click", "view"), "latest"))
    chosen = L.effective_settings(
        datasets, {"delta_factor": 2.0, "base_time": "earliest", "target_time": "now-1d"},
        {"delta_factor": 3.0}, {"delta_factor": 1.0, "base_time": "auto", "prevent_future": True},
        ["delta_factor", "base_time", "target_time", "prevent_future"],
    )
    return chosen


@query("profile_fan_out", """
WITH d AS (SELECT s_nationkey, s_name FROM supplier WHERE s_nationkey % 5 <> 2
           QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 3)
SELECT c_custkey AS dataset, c_nationkey AS profile, s_name AS destination
FROM customer LEFT JOIN d ON c_nationkey = s_nationkey""")
def profile_fan_out(spark, sf_dir):
    """Every dataset once per destination of its profile (here: nation); some profiles have none."""
    datasets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset"), F.col("c_nationkey").alias("profile")
    )
    suppliers = table(spark, sf_dir, "supplier").filter(F.pmod("s_nationkey", F.lit(5)) != 2)
    destinations = L.first_per_key(suppliers, "s_nationkey", [F.col("s_suppkey")], 3).select(
        F.col("s_nationkey").alias("profile"), F.col("s_name").alias("destination")
    )
    return L.fan_out(datasets, destinations).select("dataset", "profile", "destination")


@query("conversation_preview", """
SELECT conv_id, turn, left(text, 200) AS line FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 3""")
def conversation_preview(spark, sf_dir):
    """The first lines of every source, cut to a width."""
    rows = table(spark, sf_dir, "conversations")
    first = L.first_per_key(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], 3)
    return first.select("conv_id", "turn", F.left("text", F.lit(200)).alias("line"))
