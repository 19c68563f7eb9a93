"""Exact copies by an extendible-hash index on shared files.

A text's key is the start of the SHA-256 of its normalised form. The directory maps the leading bits of
a key to a bucket; it starts with one bucket and doubles as long as a bucket holds more than its
capacity. Each owner task gets whole buckets, that is ranges of keys, walks them in key order, chains
the texts that share a key and compares their bytes. What it finds goes to the index, a table in the
shared folder, and every row looks its text up there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, SPACE, tidied, unused, written

BUCKET_BYTES = 32 << 20
MAX_DEPTH = 20
ROWS_AT_ONCE = 1024
_SPACE = SPACE.encode()


def normalised(text: str) -> bytes:
    return text.encode().translate(None, _SPACE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _prefix(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, chars, size, prefix, sha`` of every row; ``prefix`` has the 32 leading bits of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column("text").to_pylist()
                plain = [normalised(t) for t in texts]
                digests = [hashlib.sha256(p).digest() for p in plain]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([len(p) for p in plain], pa.int64()),
                        pa.array([_prefix(d) for d in digests], pa.int64()),
                        pa.array(digests, pa.binary()),
                    ],
                    ["doc_id", "chars", "size", "prefix", "sha"],
                )

    return _texts(docs).mapInArrow(tidied(run), "doc_id long, chars long, size long, prefix long, sha binary")


def directory(loads: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each of the 2^depth entries, given the load of each slot at the greatest depth.

    The directory doubles until no bucket exceeds ``capacity`` or the greatest depth is reached; only
    overfull buckets split, the others are shared by the entries that were doubled.
    """
    levels = [loads]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    levels.reverse()
    buckets = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1):
        # the load of a bucket that has not split for a while is spread over several entries
        held = np.bincount(buckets, weights=levels[depth])
        full = held > capacity
        if not full.any():
            break
        buckets = np.repeat(buckets, 2)
        split = full[buckets]
        split[::2] = False
        fresh = np.cumsum(split) + held.size - 1
        buckets = np.where(split, fresh, buckets)
    return buckets


def _directory_of(prints: DataFrame, capacity: int) -> np.ndarray:
    """The directory from the load of each slot.

    The depth allows for 16 slots per bucket that the whole load needs; the driver gets a sum per slot,
    so a few numbers per bucket and never more than 2^MAX_DEPTH.
    """
    texts = prints.groupBy("sha").agg(F.max("size").alias("size"), F.max("prefix").alias("prefix"))
    whole = texts.agg(F.sum("size")).first()[0] or 0
    depth = min(MAX_DEPTH, (16 * whole // capacity).bit_length())
    rows = texts.groupBy(F.shiftright("prefix", 32 - depth).alias("slot")).agg(F.sum("size").alias("load")).toPandas()
    loads = np.zeros(1 << depth)
    loads[rows["slot"].to_numpy(np.int64)] = rows["load"].to_numpy(np.float64)
    return directory(loads, capacity)


def build_index(docs: DataFrame, prints: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """``sha, keep_id, keep_chars, group_size``: an entry per distinct normalised text.

    Equal texts of one batch are merged before they are sent, so a group of copies reaches its owner as
    one row per batch and not one per copy.
    """
    spark = docs.sparkSession
    found = _directory_of(prints, capacity)
    depth = int(len(found)).bit_length() - 1
    shared = spark.sparkContext.broadcast(found.astype(np.int32))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = shared.value
        for batch in batches:
            best: dict[bytes, tuple] = {}
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    plain = normalised(text)
                    mine = (-len(text), doc_id is None, doc_id)
                    rank, count = best.get(plain, (mine, 0))
                    best[plain] = (min(rank, mine), count + 1)
            out = list(best.items())
            del best
            for at in range(0, len(out), ROWS_AT_ONCE):
                part = out[at : at + ROWS_AT_ONCE]
                digests = [hashlib.sha256(plain).digest() for plain, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(buckets[[_prefix(d) >> (32 - depth) for d in digests]], pa.int32()),
                        pa.array(digests, pa.binary()),
                        pa.array([plain for plain, _ in part], pa.binary()),
                        pa.array([-rank[0] for _, (rank, _) in part], pa.int64()),
                        pa.array([rank[2] for _, (rank, _) in part], pa.int64()),
                        pa.array([count for _, (_, count) in part], pa.int64()),
                    ],
                    ["bucket", "sha", "plain", "chars", "doc_id", "copies"],
                )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, done = None, [], []

        def entries() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([sha for sha, _, _ in done], pa.binary()),
                    pa.array([rank[2] for _, rank, _ in done], pa.int64()),
                    pa.array([-rank[0] for _, rank, _ in done], pa.int64()),
                    pa.array([copies for _, _, copies in done], pa.int64()),
                ],
                ["sha", "keep_id", "keep_chars", "group_size"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = [part.column(n).to_pylist() for n in ("sha", "plain", "chars", "doc_id", "copies")]
                for sha, plain, chars, doc_id, copies in zip(*columns):
                    if sha[:8] != key:
                        done += [link[1:] for link in chain]
                        key, chain = sha[:8], []
                    rank = (-chars, doc_id is None, doc_id)
                    for link in chain:
                        if link[0] == plain:
                            link[2] = min(link[2], rank)
                            link[3] += copies
                            break
                    else:
                        chain.append([plain, sha, rank, copies])
                yield entries()
                done = []
        done += [link[1:] for link in chain]
        yield entries()

    sent = _texts(docs).mapInArrow(tidied(route), "bucket int, sha binary, plain binary, chars long, doc_id long, copies long")
    owned = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "sha")
    return written(owned.mapInArrow(tidied(own), "sha binary, keep_id long, keep_chars long, group_size long"), "exact-index")


def exact_groups(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """The group of equal texts each row belongs to, and whether the row stays.

    Texts are equal when their bytes agree after white space (blank, tab, line feed, vertical tab, form
    feed, carriage return) is deleted; null counts as empty. The row with most code points stays, of
    several the one with the smallest ``doc_id``, null last. Result, a row per input row: ``doc_id,
    keep_id, group_size, kept, text_sha256``. Repeated rows are counted in the group and marked alike.
    Other columns are not read. An empty table gives no rows.
    """
    return _judged(docs, capacity).drop("chars")


def _judged(docs: DataFrame, capacity: int) -> DataFrame:
    """``exact_groups`` and the code points of each row, ``chars``."""
    prints = written(fingerprints(docs), "exact-prints")
    index = build_index(docs, prints, capacity)
    # rows of a large group meet one index entry: the adaptive join splits them
    return prints.join(index, "sha").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "chars",
    )


def drop_exact_copies(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without copies: one row for each distinct text, with all its columns.

    Rows are told apart by ``doc_id``, digest and length of the text; of rows that agree in these one stays.
    A null text counts as empty, a null ``doc_id`` as a value; columns may have any names; an empty table
    gives no rows.
    """
    id_, sha, chars, count = (unused(docs, n) for n in ("_kept", "_sha", "_chars", "_rows"))
    kept = _judged(docs, capacity).filter("kept")
    kept = kept.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), F.col("chars").alias(chars)).agg(F.count(F.lit(1)).alias(count))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.translate(text, SPACE, ""), 256)
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (digest == F.col(sha)) & (F.char_length(text) == F.col(chars)))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    once = rows.filter(F.col(count) == 1).select(*columns)
    # only repeated rows are sent once more
    again = rows.filter(F.col(count) > 1).dropDuplicates([sha]).select(*columns)
    return once.unionByName(again)
