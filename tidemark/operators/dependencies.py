"""Datasets that depend on datasets: closure, versions that fit together, and merged defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.bind import computed_once
from tidemark.functions.versions import bound_text, meets, number_text, numbers
from tidemark.operators.lookups import merged_settings
from tidemark.operators.rounds import rows_of
from tidemark.session import cut_lineage, shared_path

LAST = 2**31 - 1
# roots that are resolved together: at most, and at least if there are as many
BLOCK, LEAST = 8192, 256


class _Levels:
    """A table in the shared folder that grows by a folder per level and is read in one scan."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType):
        self.spark, self.path, self.schema, self.count = spark, shared_path(spark, name), schema, 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write the next level; it comes back as a table of its own."""
        path = f"{self.path}/level={self.count}"
        df.select(*self.schema.fieldNames()).write.parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def whole(self) -> DataFrame:
        """All levels so far, with ``level``."""
        schema = T.StructType([*self.schema.fields, T.StructField("level", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)


def _schema(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


def dependency_closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``root, dataset, depth``: everything a dataset depends on, with its smallest depth, itself at 0.

    ``edges`` has ``dataset`` and ``dependency``; rows with a null in either are no edges. Without
    ``roots`` (column ``dataset``) all datasets that have dependencies are roots. Cycles are fine.

    For all roots ways are doubled: what lies within twice the distance is found from what lies at that
    distance, so the rounds grow with the logarithm of the depth, and a pair of datasets is made again only
    for another way of the same length. For given roots the walk goes level by level; levels are appended
    to one table, and a pair that was met before is not followed.
    """
    edges = edges.select("dataset", "dependency").filter("dataset IS NOT NULL AND dependency IS NOT NULL")
    edges = cut_lineage(edges.filter("dataset <> dependency").distinct())
    if roots is not None:
        return _walk(edges, roots.select(F.col("dataset").alias("root"), "dataset").filter("dataset IS NOT NULL").distinct())
    start = edges.select(F.col("dataset").alias("root"), "dataset", F.lit(0).alias("depth")).distinct()
    first = edges.select(F.col("dataset").alias("root"), F.col("dependency").alias("dataset"), F.lit(1).alias("depth"))
    known, reach = cut_lineage(start.unionByName(first)), 1
    while True:
        far = known.filter(F.col("depth") == reach).select("root", F.col("dataset").alias("through"))
        onward = known.filter("depth > 0").select(F.col("root").alias("through"), "dataset", (F.col("depth") + reach).alias("depth"))
        both = known.unionByName(far.join(onward, "through").select("root", "dataset", "depth"))
        known = cut_lineage(both.groupBy("root", "dataset").agg(F.min("depth").alias("depth")))
        reach *= 2
        if known.filter(F.col("depth") == reach).isEmpty():
            return known


def _walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    met = _Levels(edges.sparkSession, "tidemark-closure", _schema(start, "root", "dataset"))
    level = met.append(start)
    while not level.isEmpty():
        step = level.join(edges, "dataset").select("root", F.col("dependency").alias("dataset")).distinct()
        level = met.append(step.join(met.whole(), ["root", "dataset"], "left_anti"))
    return met.whole().select("root", "dataset", F.col("level").alias("depth"))


# --- versions ---


class Resolution:
    """What a resolution settles on; each part is worked out when it is asked for."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @property
    def datasets(self) -> DataFrame:
        """``root, dataset, version, constraints, problem``"""
        return self._part("datasets", "version string, constraints long, problem string")

    @property
    def constraints(self) -> DataFrame:
        """``root, dataset, constraint, level``: a row per constraint that was met, and the round that met it."""
        return self._part("constraints", "constraint string, level int")

    def conflicts(self) -> DataFrame:
        """``root, dataset, constraint, problem``: a row per constraint of a dataset that has no fitting release."""
        return self._part("conflicts", "constraint string, problem string")

    def _part(self, part: str, columns: str) -> DataFrame:
        key = self.blocks.schema["dataset"].dataType
        schema = T.StructType([T.StructField("root", key), T.StructField("dataset", key), *T._parse_datatype_string(columns).fields])
        return self.blocks.groupBy("block").applyInArrow(rows_of(part, schema.fieldNames()), schema)


def _block_size(spark: SparkSession, roots: int) -> int:
    """Roots of a block: few enough that every core has some blocks, if they are not too small then."""
    return min(BLOCK, max(LEAST, -(-roots // (4 * spark.sparkContext.defaultParallelism))))


def _blocks(edges: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """``block, dataset``: the ``roots`` in blocks of up to ``size`` that have much of their dependencies in common.

    Each dataset points to the dependency that has the fewest dependents; roots are sorted by where 16, 8,
    4, 2 and 1 of these steps lead, and cut into blocks. It is the work that depends on the order, not the result.
    """
    uses = edges.groupBy("dependency").agg(F.count(F.lit(1)).alias("uses"))
    rarest = F.min(F.struct("uses", "dependency"))["dependency"].alias("up1")
    ways, steps = cut_lineage(edges.join(uses, "dependency").groupBy("dataset").agg(rarest)), 1
    while steps < 16:
        last, further = f"up{steps}", f"up{2 * steps}"
        onward = ways.select(F.col("dataset").alias(last), F.col(last).alias("onward"))
        ways = ways.join(onward, last, "left").withColumn(further, F.coalesce("onward", last)).drop("onward")
        ways, steps = cut_lineage(ways), 2 * steps
    placed = roots.join(ways, "dataset", "left").orderBy("up16", "up8", "up4", "up2", "up1", "dataset")
    # numbers of a partition begin at a multiple of 2 ** 33, far from those of the one before
    return placed.select(F.monotonically_increasing_id().alias("number"), "dataset").select(F.expr(f"number div {size}").alias("block"), "dataset")


def resolve_versions(releases: DataFrame, dependencies: DataFrame, roots: DataFrame) -> Resolution:
    """The releases that fit together below each root, found by passing constraints on until nothing changes.

    ``releases`` has ``dataset, version``; ``dependencies`` has ``dataset, version, dependency, constraint``,
    the needs of a release; ``roots`` has ``dataset, constraint``. A null constraint is ``*``. A dataset takes
    its highest release that satisfies all constraints met on the way from the root. When a constraint takes
    a release away, the next one's needs are added; what was met stays met, so the choice only goes down and
    a cycle ends. Of versions with equal numbers the greatest text counts.

    ``problem`` is null, ``missing`` (a dataset without releases) or ``conflict`` (none satisfies all
    constraints, or one cannot be read); then ``version`` is null. Rows of ``constraints`` tell when each was met.

    Whether a release satisfies a constraint is decided once per dataset: as constraints compare numbers, each
    allows the releases from one rank to another. Roots are put into blocks, everything that a block can meet is
    brought together once (over all releases of its datasets), and a task takes its roots through all rounds.
    """
    spark = releases.sparkSession
    star = F.coalesce("constraint", F.lit("*")).alias("constraint")
    releases = releases.select("dataset", "version").filter("dataset IS NOT NULL AND version IS NOT NULL").repartition("dataset").distinct()
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy("number", "version")).alias("rank")
    releases = computed_once(releases, {"number": number_text(F.col("version"))}).withColumn("number", numbers(F.col("number")))
    releases = cut_lineage(releases.select("dataset", "version", "number", rank))
    needs = dependencies.filter("dataset IS NOT NULL AND version IS NOT NULL AND dependency IS NOT NULL")
    needs = cut_lineage(needs.select("dataset", "version", "dependency", star))
    start = cut_lineage(roots.filter("dataset IS NOT NULL").select("dataset", star).groupBy("dataset").agg(F.collect_set("constraint").alias("asked")))

    asks = needs.select(F.col("dependency").alias("dataset"), "constraint").unionByName(start.select("dataset", F.explode("asked").alias("constraint")))
    asks = computed_once(asks.repartition("dataset").distinct(), {"bound": bound_text(F.col("constraint"))}).withColumn("bound", numbers(F.col("bound")))
    asks = asks.join(releases.drop("version"), "dataset", "left")
    asks = asks.select("dataset", "constraint", F.when(meets(F.col("number"), F.col("constraint"), F.col("bound")), F.col("rank")).alias("allowed"))
    asks = asks.groupBy("dataset", "constraint").agg(F.min("allowed").alias("low"), F.max("allowed").alias("high"), F.count("allowed").alias("n"))
    whole = F.assert_true((F.col("n") == 0) | (F.col("high") - F.col("low") + 1 == F.col("n")), "releases between two that satisfy a constraint do not")
    asks = asks.filter(whole.isNull())
    ask = F.struct("constraint", F.coalesce("low", F.lit(1)).alias("low"), F.coalesce("high", F.lit(0)).alias("high"))
    asks = asks.groupBy("dataset").agg(F.collect_list(ask).alias("asks"))
    versions = releases.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("rank", "version")))["version"].alias("versions"))
    needs = needs.join(releases, ["dataset", "version"])
    needs = needs.groupBy("dataset").agg(F.collect_set(F.struct("rank", "dependency", "constraint")).alias("needs"))
    cards = cut_lineage(asks.join(versions, "dataset", "left").join(needs, "dataset", "left"))

    edges = cards.select("dataset", F.explode(F.array_distinct("needs.dependency")).alias("dependency"))
    edges = cut_lineage(edges.filter("dataset <> dependency"))
    many = start.count()
    size = _block_size(spark, many)
    placed = _blocks(edges, start.select("dataset"), size) if many > size else start.select(F.lit(0).cast("long").alias("block"), "dataset")
    placed = cut_lineage(placed)
    met = _walk(edges, placed.withColumnRenamed("block", "root")).select(F.col("root").alias("block"), "dataset")
    home = start.join(placed.withColumnRenamed("block", "home"), "dataset")
    cards = met.join(cards.join(home, "dataset", "left"), "dataset")
    asked = F.when(F.col("block") == F.col("home"), F.col("asked")).alias("asked")
    cards = cards.select("block", "dataset", "versions", "needs", "asks", asked)
    return Resolution(cards.repartition(max(1, -(-many // size)), "block"))


# --- defaults ---


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled: a table that grows with the datasets is not sent through the driver.

    Each would be small enough for a broadcast for a while, but there are several in every level.
    """
    return df.hint("merge")


def merge_heights(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``dataset, height`` of datasets with dependencies, and the ``edges`` that count.

    A dataset stands one above the highest of its dependencies; without any it stands at 0 and has no row.
    Where datasets depend on each other in a cycle, edges within it to a dataset of the same or a greater
    name do not count.
    """
    columns = ["dataset", "dependency", "position"]
    edges = edges.select(*columns).filter("dataset IS NOT NULL AND dependency IS NOT NULL")
    edges = cut_lineage(edges.filter("dataset <> dependency"))
    left, heights = edges, _Levels(edges.sparkSession, "tidemark-heights", _schema(edges, "dataset"))
    while not left.isEmpty():
        above = left.select(F.col("dataset").alias("dependency")).distinct()
        waiting = left.join(_dealt(above), "dependency", "left_semi").select("dataset").distinct()
        ready = left.select("dataset").distinct().join(_dealt(waiting), "dataset", "left_anti")
        ready = cut_lineage(ready)
        if not ready.isEmpty():
            heights.append(ready)
            left = cut_lineage(left.join(_dealt(ready), "dataset", "left_anti"))
            continue
        back = dependency_closure(left).filter("depth > 0").select(F.col("root").alias("dependency"), "dataset")
        closing = left.join(_dealt(back), ["dataset", "dependency"], "left_semi").filter("dependency >= dataset").select("dataset", "dependency").distinct()
        left = cut_lineage(left.join(_dealt(closing), ["dataset", "dependency"], "left_anti"))
        edges = cut_lineage(edges.join(_dealt(closing), ["dataset", "dependency"], "left_anti"))
    if not heights.count:
        heights.append(edges.select("dataset").limit(0))
    return heights.whole().select("dataset", (F.col("level") + 1).alias("height")), edges


def merged_defaults(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``dataset, path, value``: defaults of each dataset, its dependencies' merged below its own.

    ``edges`` has ``dataset, dependency, position``, ``entries`` the flattened own defaults ``dataset, path,
    value``. Dependencies count in the order of their positions, a later one over an earlier one, the
    dataset's own defaults last. A branch replaces a value and a value a branch.

    Datasets are merged from the bottom, level by level, each from the merged maps of its dependencies, so a
    map is made once however many ways lead to it.
    """
    heights, edges = merge_heights(edges)
    heights = cut_lineage(heights)
    own = cut_lineage(entries.select("dataset", "path", "value", F.lit(LAST).alias("priority")))
    merged = _Levels(entries.sparkSession, "tidemark-defaults", _schema(own, "dataset", "path", "value"))
    lowest = own.join(_dealt(heights.select("dataset")), "dataset", "left_anti")
    merged.append(merged_settings(lowest, ["dataset"]))
    top = heights.agg(F.max("height")).first()[0] or 0
    placed = edges.join(_dealt(heights), "dataset")
    for height in range(1, top + 1):
        here = placed.filter(F.col("height") == height).select("dataset", "dependency", F.col("position").cast("int").alias("priority"))
        below = merged.whole().select(F.col("dataset").alias("dependency"), "path", "value")
        inherited = here.join(_dealt(below), "dependency").select("dataset", "path", "value", "priority")
        mine = own.join(_dealt(heights.filter(F.col("height") == height)), "dataset", "left_semi")
        merged.append(merged_settings(inherited.unionByName(mine), ["dataset"]))
    return merged.whole().select("dataset", "path", "value")
