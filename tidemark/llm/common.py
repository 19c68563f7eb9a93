"""Small helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import require_checkpoint_dir

# white space as the corpus contracts define it
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every executor and the driver can see it."""
    require_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet files in the shared folder: computed once, safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def most_frequent(counted: DataFrame, at_most: int, uses: str) -> DataFrame:
    """The rows with the highest counts, ``at_most`` in all, without sorting the others.

    Counts fall into classes of an eighth of an octave; a sum per class (a few hundred rows) tells which
    classes fit as a whole. Rows of the first class that does not fit are left out, so the choice does
    not depend on the order of ties.
    """
    level = F.floor(F.log2(uses) * 8).cast("long")
    sizes = counted.filter(F.col(uses) > 0).groupBy(level.alias("level")).count().collect()
    lowest, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["count"]
        if total > at_most:
            break
        lowest = row["level"]
    return counted.filter((F.col(uses) > 0) & (level >= lowest)) if lowest is not None else counted.limit(0)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, with the memory that its task no longer needs given back at the end.

    Workers are kept for later tasks; without this each holds on to the most it ever used.
    """

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return whole
