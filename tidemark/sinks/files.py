"""File sinks: text lines below a path per template variable, on any Hadoop file system."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import output_path, template_columns, template_parts
from tidemark.operators.writeback import as_json, as_line
from tidemark.session import cut_lineage
from tidemark.sources.blocks import drop_file, move_file
from tidemark.sources.listing import hadoop_uri

COMPRESSION = {"gzip": "gzip", "bzip2": "bzip2", "none": "none", None: "none"}


def serialised(data: Column, fmt: str, raw: Column | None = None) -> Column:
    """One line of text per record: ``jsonl`` or ``text``."""
    if fmt in ("json", "jsonl"):
        return as_json(data)
    if fmt == "text":
        return as_line(data, raw)
    raise ValueError(f"unknown output format {fmt!r}")


def write_lines(
    df: DataFrame,
    line: Column,
    path: str,
    template: str,
    run_time: datetime,
    filename: Column,
    sourcetype: Column,
    compression: str | None = None,
    mode: str = "append",
    files_per_path: int | None = None,
) -> None:
    """Write lines below ``path``, where the template says.

    A template of variables and slashes alone gives one directory level ``name=value`` per variable,
    which Spark reads back as columns. Any other text in it is kept: then files have the very path of
    :func:`tidemark.functions.paths.output_path`, a number added where a path has several files.

    The clock variables are those of ``run_time`` for the whole run. By default every task writes
    its own rows and nothing is shuffled. ``files_per_path`` bounds the number of files per
    directory; rows are then spread evenly over that many tasks, also when one path holds most.
    """
    if any(literal.strip("/") for literal, _ in template_parts(template)):
        place = output_path(template, filename, sourcetype, run_time, compression)
        _write_exact(df.select(place.alias("_path"), line.alias("value")), path, compression, mode, files_per_path)
        return
    columns = template_columns(template, filename, sourcetype, run_time)
    out = df.select(*[c.alias(n) for n, c in columns.items()], line.alias("value"))
    if files_per_path:
        spread = F.pmod(F.xxhash64("value"), F.lit(files_per_path))
        out = out.repartition(*columns, spread)
    writer = out.write.mode(mode).option("compression", COMPRESSION[compression])
    if columns:
        writer = writer.partitionBy(*columns)
    writer.text(hadoop_uri(path))


def _write_exact(
    lines: DataFrame, path: str, compression: str | None, mode: str, files_per_path: int | None
) -> None:
    """Write by tasks into a hidden folder beside the result, then have tasks move each file to its name.

    A table in the hidden folder says which file goes where, so a move that is done again changes nothing. If
    the moves fail for good, what they put in place is taken away again. The hidden folder goes in any case.
    """
    spark, root = lines.sparkSession, hadoop_uri(path).rstrip("/")
    if files_per_path:
        lines = lines.repartition("_path", F.pmod(F.xxhash64("value"), F.lit(files_per_path)))
    Path = spark._jvm.org.apache.hadoop.fs.Path
    system = Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(Path(root)).toString()
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    before = _existing(spark, root) if system.exists(Path(root)) else None
    try:
        lines.write.partitionBy("_path").option("compression", COMPRESSION[compression]).text(f"{staging}/files")
        moves = _planned_moves(spark, root, f"{staging}/files", before, mode)
        moves.write.parquet(f"{staging}/moves")
        moves = spark.read.schema(moves.schema).parquet(f"{staging}/moves")
        try:
            _each(moves.filter("source IS NULL"), lambda source, target: drop_file(target))
            _each(moves.filter("source IS NOT NULL"), move_file)
        except Exception:
            _each(moves.filter("source IS NOT NULL"), lambda source, target: drop_file(target))
            raise
    finally:
        system.delete(Path(staging), True)


def _existing(spark: SparkSession, root: str) -> DataFrame:
    """``target, number, path`` of the files below ``root``, a whole address: the path of a template, and the number added to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    inner = F.substring("path", len(root) + 2, 1 << 20)
    numbered = r"^((?:.*/)?[^/.]*)-(\d{5})(\.[^/]*)?$"
    plain = F.when(inner.rlike(numbered), F.regexp_replace(inner, numbered, "$1$3")).otherwise(inner)
    number = F.when(inner.rlike(numbered), F.regexp_extract(inner, numbered, 2).cast("int")).otherwise(F.lit(0))
    return cut_lineage(files.select(plain.alias("target"), number.alias("number"), "path"))


def _planned_moves(spark: SparkSession, root: str, staged: str, before: DataFrame | None, mode: str) -> DataFrame:
    """``source, target``: where each written file goes; without a source, a file that makes way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(staged).select("path")
    target = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"/_path=([^/]*)/[^/]*$", 1), r"\+", "%2B"))
    files = files.select("path", target.alias("target"))
    order = Window.partitionBy("target").orderBy("path")
    files = files.withColumn("number", F.row_number().over(order) - 1)
    old = spark.createDataFrame([], "target string, number int, path string") if before is None else before
    if mode == "overwrite":
        gone = old.join(files.select("target").distinct(), "target", "left_semi").select(F.lit(None).cast("string").alias("source"), F.col("path").alias("target"))
        taken = None
    else:
        gone, taken = None, old.groupBy("target").agg((F.max("number") + 1).alias("first"))
        files = files.join(taken, "target", "left").withColumn("number", F.col("number") + F.coalesce("first", F.lit(0)))
    folder, name = F.regexp_extract("target", "^(.*/)?([^/]*)$", 1), F.regexp_extract("target", "^(.*/)?([^/]*)$", 2)
    stem, rest = F.regexp_extract(name, r"^([^.]*)(.*)$", 1), F.regexp_extract(name, r"^([^.]*)(.*)$", 2)
    number = F.when(F.col("number") == 0, "").otherwise(F.format_string("-%05d", "number"))
    placed = files.select(F.col("path").alias("source"), F.concat(F.lit(f"{root}/"), folder, stem, number, rest).alias("target"))
    return placed if gone is None else placed.unionByName(gone)


def _each(moves: DataFrame, act: Callable[[str | None, str], None]) -> None:
    """Run ``act`` on every ``source, target``, in tasks."""

    def run(rows) -> None:
        for row in rows:
            act(row.source, row.target)

    moves.repartition("target").foreachPartition(run)


def print_lines(df: DataFrame, line: Column, limit: int | None = None, out: TextIO | None = None) -> int:
    """Print lines in order, one partition at a time."""
    out = out or sys.stdout
    rows = df.select(line.alias("value"))
    rows = rows if limit is None else rows.limit(limit)
    count = 0
    for row in rows.toLocalIterator():
        print(row.value, file=out)
        count += 1
    return count


def run_dry(df: DataFrame) -> None:
    """Do all the work of a write and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
