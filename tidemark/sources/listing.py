"""File listings as tables: names, sizes, checksums, and object-store addresses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.blocks import digest_file


# Address scheme -> (kind, scheme of the Hadoop file system).
OBJECT_STORES = {
    "s3": ("s3", "s3a"),
    "gs": ("gcs", "gs"),
    "gcs": ("gcs", "gs"),
    "azure": ("azure", "abfss"),
    "wasb": ("azure", "abfss"),
}
GZIP_RATIO = 10  # assumed growth of a gzip file when it is unpacked


def split_uri(uri: Column) -> Column:
    """Struct ``kind, bucket, prefix, hadoop_uri`` of an address; a plain path is ``local``."""
    scheme = F.regexp_extract(uri, r"^([a-z0-9]+)://", 1)
    rest = F.regexp_extract(uri, r"^[a-z0-9]+://(.*)\z", 1)
    known = scheme.isin(list(OBJECT_STORES))
    kind, target = F.lit("local"), F.lit("")
    for name, (store, hadoop) in OBJECT_STORES.items():
        kind = F.when(scheme == name, store).otherwise(kind)
        target = F.when(scheme == name, hadoop).otherwise(target)
    return F.struct(
        kind.alias("kind"),
        F.when(known, F.substring_index(rest, "/", 1)).alias("bucket"),
        F.when(known, F.regexp_extract(rest, r"^[^/]*/(.*)\z", 1)).otherwise(uri).alias("prefix"),
        F.when(known, F.concat(target, F.lit("://"), rest)).otherwise(uri).alias("hadoop_uri"),
    )


def hadoop_uri(uri: str) -> str:
    """The same rewrite for an address known when the query is built."""
    scheme, found, rest = uri.partition("://")
    if found and scheme in OBJECT_STORES:
        return f"{OBJECT_STORES[scheme][1]}://{rest}"
    return uri


def list_files(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """``path, file_name, size, modified`` of the files below ``paths``.

    ``pattern`` is a glob on the file name. ``allow`` (column ``path``) keeps exact paths only.
    The content is not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    targets = [paths] if isinstance(paths, str) else list(paths)
    files = reader.load([hadoop_uri(p) for p in targets]).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
    if allow is not None:
        files = files.join(allow.select("path"), "path", "left_semi")
    return files


def estimated_size(files: DataFrame) -> Column:
    """Size when unpacked: by ratio for gzip, as it is otherwise."""
    return F.when(files["file_name"].endswith(".gz"), files["size"] * GZIP_RATIO).otherwise(
        files["size"]
    )


def within_size(files: DataFrame, max_bytes: int) -> DataFrame:
    return files.filter(estimated_size(files) <= max_bytes)


def largest_file(files: DataFrame) -> DataFrame:
    """The file with the largest estimated size (by path among equals)."""
    sized = files.withColumn("estimated_size", estimated_size(files))
    return sized.orderBy(F.desc("estimated_size"), "path").limit(1)


def digest(content: Column, algorithm: Column) -> Column:
    return (
        F.when(algorithm == "sha256", F.sha2(content, 256))
        .when(algorithm == "sha512", F.sha2(content, 512))
        .when(algorithm == "md5", F.md5(content))
    )


def checksum_matches(content: Column, declared: Column) -> Column:
    """Whether ``algorithm:value`` holds for ``content``; true when nothing is declared."""
    algorithm = F.substring_index(declared, ":", 1)
    value = F.lower(F.regexp_extract(declared, r"^[^:]*:(.*)\z", 1))
    return F.when(declared.isNull(), F.lit(True)).otherwise(
        F.coalesce(digest(content, algorithm) == value, F.lit(False))
    )


# The algorithms a manifest may declare.
ALGORITHMS = ("sha256", "sha512", "md5")
# the largest binary value Spark holds
MAX_HELD_BYTES = 2**31 - 64


def _streamed(declared: DataFrame) -> DataFrame:
    """``path, checksum, ok, error``: each file read in blocks by the task that has its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, checksum in zip(batch.column("path").to_pylist(), batch.column("checksum").to_pylist()):
                algorithm, _, value = checksum.partition(":")
                ok, error = False, None
                if algorithm in ALGORITHMS:
                    try:
                        ok = digest_file(path, algorithm) == value.lower()
                    except (OSError, ValueError) as failure:
                        error = str(failure)
                rows.append((path, checksum, ok, error))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "checksum", "ok", "error"])

    return declared.mapInArrow(run, "path string, checksum string, ok boolean, error string")


def verify_checksums(
    spark: SparkSession, manifest: DataFrame, paths: list[str], max_bytes: int = MAX_HELD_BYTES
) -> DataFrame:
    """``path, checksum, ok, error`` for every manifest row (``path``, ``checksum``) found on disk.

    Each file is hashed by one task: up to ``max_bytes`` as one value, above that as a stream of blocks, so
    a file of any size is compared. Where nothing is declared a file is not read and passes. ``error`` tells
    why a file could not be read as a stream, such as a scheme that only Spark can open.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    declared = manifest.select("path", "checksum")
    none = F.lit(None).cast("string").alias("error")
    small = files.filter(F.col("length") <= max_bytes).join(declared, "path")
    hashed = small.select("path", "checksum", checksum_matches(F.col("content"), F.col("checksum")).alias("ok"), none)
    large = files.filter(F.col("length") > max_bytes).select("path").join(declared, "path")
    passed = large.filter("checksum IS NULL").select("path", "checksum", F.lit(True).alias("ok"), none)
    # a row per file: dealt out so that the long reads run side by side
    stream = _streamed(large.filter("checksum IS NOT NULL").repartition("path"))
    return hashed.unionByName(passed).unionByName(stream)


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (column ``path``) that are not in the listing."""
    return manifest.join(files.select("path"), "path", "left_anti")
