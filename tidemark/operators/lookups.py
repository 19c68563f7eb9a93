"""Dimension lookups and precedence rules, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.pattern_sets import REGISTRY
from tidemark.plans.shift_plan import SETTING_FIELDS
from tidemark.plans.text_families import DEFAULT_FAMILIES, PREFIX_FAMILIES, SOURCETYPE_FAMILIES


def file_sourcetypes(df: DataFrame, files: DataFrame) -> DataFrame:
    """Add the sourcetype of each row's file (NULL when unlisted).

    ``files`` has ``file_name``, ``sourcetype`` and ``position``; of a name listed twice the last
    one counts.
    """
    named = files.filter(F.col("sourcetype").isNotNull())
    one = named.groupBy("file_name").agg(F.max_by("sourcetype", "position").alias("sourcetype"))
    return df.join(one, "file_name", "left")


def registry_table(spark: SparkSession) -> DataFrame:
    """The registered patterns as a table (a constant of the library, under a hundred rows)."""
    rows = [
        (name, i, p.field, p.format, p.is_base, p.regex)
        for name, patterns in REGISTRY.items()
        for i, p in enumerate(patterns)
    ]
    return spark.createDataFrame(
        rows, "sourcetype string, position int, field string, format string, is_base boolean, regex string"
    )


def registered_patterns(df: DataFrame, sourcetype: str) -> DataFrame:
    """One row per pattern registered for a row's sourcetype: exact name first, then any case."""
    registry = registry_table(df.sparkSession)
    grouped = registry.groupBy("sourcetype").agg(
        F.array_sort(F.collect_list(F.struct("position", "field", "format", "is_base", "regex")))
        .alias("patterns")
    )
    exact = grouped.select(F.col("sourcetype").alias("_exact"), F.col("patterns").alias("_p1"))
    folded = grouped.groupBy(F.lower("sourcetype").alias("_folded")).agg(
        F.max_by("patterns", "sourcetype").alias("_p2")
    )
    joined = df.join(F.broadcast(exact), F.col(sourcetype) == F.col("_exact"), "left").join(
        F.broadcast(folded), F.lower(F.col(sourcetype)) == F.col("_folded"), "left"
    )
    return joined.withColumn("patterns", F.coalesce("_p1", "_p2")).drop(
        "_exact", "_p1", "_folded", "_p2"
    )


def sourcetype_families(df: DataFrame, sourcetype: str) -> DataFrame:
    """Add ``families`` by joins: exact name, else name prefix, else the default list."""
    spark = df.sparkSession
    exact = spark.createDataFrame(
        [(k, list(v)) for k, v in SOURCETYPE_FAMILIES.items()], "_name string, _f1 array<string>"
    )
    prefixed = F.lit(None).cast("array<string>")
    for prefix, families in PREFIX_FAMILIES.items():
        names = F.array(*[F.lit(f) for f in families]).cast("array<string>")
        prefixed = F.coalesce(prefixed, F.when(F.col(sourcetype).startswith(prefix), names))
    default = F.array(*[F.lit(f) for f in DEFAULT_FAMILIES])
    joined = df.join(F.broadcast(exact), F.col(sourcetype) == F.col("_name"), "left")
    return joined.withColumn("families", F.coalesce("_f1", prefixed, default)).drop("_name", "_f1")


def uncovered_references(references: DataFrame, bundled: DataFrame) -> DataFrame:
    """References whose sourcetype no bundled file covers (one without a sourcetype is kept)."""
    covered = bundled.select("sourcetype").filter(F.col("sourcetype").isNotNull()).distinct()
    return references.join(covered, "sourcetype", "left_anti")


def merged_settings(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deep merge of flattened settings: per path the value of the highest ``priority``.

    ``entries`` has the key columns, ``path`` (dotted), ``value`` and ``priority``. Where one entry
    sets a whole branch and another a place inside it, the one of higher priority stays.
    """
    keys = list(keys)
    best = entries.groupBy(*keys, "path").agg(
        F.max_by("value", "priority").alias("value"), F.max("priority").alias("priority")
    )
    steps = F.split("path", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."),
    )
    inner = (
        best.filter(F.size(steps) > 1)
        .select(*keys, F.explode(prefixes).alias("_branch"), F.col("path").alias("_inner"),
                F.col("priority").alias("_inner_priority"))
    )
    clash = inner.join(
        best.select(*keys, F.col("path").alias("_branch"), F.col("priority").alias("_outer_priority")),
        [*keys, "_branch"],
    )
    loser = F.when(F.col("_outer_priority") > F.col("_inner_priority"), F.col("_inner")).otherwise(
        F.col("_branch")
    )
    lost = clash.select(*keys, loser.alias("path")).distinct()
    return best.join(lost, [*keys, "path"], "left_anti").select(*keys, "path", "value")


def effective_settings(
    datasets: DataFrame,
    profile: dict[str, object] | None = None,
    overrides: dict[str, object] | None = None,
    defaults: dict[str, object] | None = None,
    fields: Sequence[str] = SETTING_FIELDS,
) -> DataFrame:
    """Replay settings per dataset: run-time override, then the dataset, the profile, the default."""
    profile, overrides, defaults = profile or {}, overrides or {}, defaults or {}

    def chosen(name: str) -> Column:
        layers = [F.lit(overrides[name])] if overrides.get(name) is not None else []
        layers += [F.col(name)] if name in datasets.columns else []
        layers += [F.lit(layer[name]) for layer in (profile, defaults) if layer.get(name) is not None]
        return F.coalesce(*layers) if layers else F.lit(None).cast("string")

    return datasets.withColumns({name: chosen(name) for name in fields})


def fan_out(df: DataFrame, destinations: DataFrame) -> DataFrame:
    """Every dataset row once per destination of its profile (``profile`` is the join key).

    A dataset whose profile has no destination stays, with NULLs for it.
    """
    return df.join(destinations, "profile", "left")


def first_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. The limit is applied before the exchange as well."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
