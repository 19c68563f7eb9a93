"""Substring dedup by super-k-mer partitioning.

A window is a run of consecutive words; its minimiser is the smallest hash of the word triples in it.
Consecutive windows mostly share their minimiser, so they travel as one packed string (a super-k-mer)
to the bucket of that minimiser, and equal windows always meet there. In a bucket windows are sorted by
hash and equal ones compared byte for byte; the first in the order of documents stays.

Documents are packed into batches of a bounded size first, written once to the shared folder. A batch
sends each of its distinct super-k-mers once, so a passage that stands in a third of all documents
reaches its bucket once per batch; the answer goes back to the batch as one bit per window.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, tidied, written

WINDOW = 20
TRIPLE = 3
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LEVEL = 6
ROWS_AT_ONCE = 512
LAST = np.iinfo(np.int64).max
U = np.uint64


# --- packing: arrays in one compressed binary value ---


def pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for array in arrays:
        parts += [struct.pack("<Q", array.nbytes), array.tobytes()]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, arrays = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in types:
        (size,) = struct.unpack_from("<Q", raw, at)
        arrays.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return arrays


# --- words, hashes, super-k-mers ---


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 4096, np.uint64) | U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in words joined by single blanks."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(data == 0x20)
    return np.append(0, blanks + 1), np.append(blanks, len(data))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from sums over the bytes of many words at a time."""
    weights, out = _weights(), np.empty(len(starts), np.uint64)
    step = 1 << 17
    for lo in range(0, len(starts), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        piece = data[s[0] : e[-1]].astype(np.uint64)
        place = np.arange(len(piece)) - np.repeat(s - s[0], np.append(np.diff(s), e[-1] - s[-1]))
        # a blank, which all words but the last have after them, counts for nothing
        values = np.where(piece == U(0x20), U(0), piece + U(1)) * weights[place & 4095]
        sums = np.add.reduceat(values, s - s[0])
        out[lo : lo + step] = _mixed(sums + (e - s).astype(np.uint64) * weights[7])
    return out


def _combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive hashes."""
    n, weights = len(hashes) - size + 1, _weights()
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * weights[64 + k]
    return _mixed(total)


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash of a triple in each window, by doubling the span of the minimum."""
    least = _combined(hashes, TRIPLE)
    wanted, span = window - TRIPLE + 1, 1
    while span < wanted:
        step = min(span, wanted - span)
        if len(least) <= step:
            return np.empty(0, np.uint64)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def super_kmers(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer.

    ``hashes`` are those of the words of several documents, ``counts`` the words of each; no window
    spans two documents.
    """
    least = minimisers(hashes, window)
    stops = np.cumsum(counts)
    left = np.repeat(stops, counts) - np.arange(len(hashes))
    valid = left[: len(least)] >= window
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    return first, np.flatnonzero(ends) + 1 - first, least[first]


class Batch:
    """The super-k-mers of a batch of documents, and which of them are the same."""

    def __init__(self, payload: bytes, window: int):
        self.ids, self.counts, self.data = unpack(payload, "<i8", "<i8", "u1")
        self.starts, self.ends = word_spans(self.data)
        hashes = word_hashes(self.data, self.starts, self.ends)
        self.first, self.windows, self.least = super_kmers(hashes, self.counts, window)
        self.window = window
        text = self.data.tobytes()
        at, to = self.starts[self.first], self.ends[self.first + self.windows + window - 2]
        seen: dict[bytes, int] = {}
        self.same = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(at.tolist(), to.tolist())], np.int64)
        self.strings = list(seen)
        self.heads = np.unique(self.same, return_index=True)[1]

    def blocks(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket: document, place in it, number and text of the distinct super-k-mers."""
        heads = self.heads
        if not len(heads):
            return
        doc = np.repeat(np.arange(len(self.counts)), self.counts)[self.first[heads]]
        place = self.first[heads] - (np.cumsum(self.counts) - self.counts)[doc]
        bucket = (_mixed(self.least[heads]) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            joined = np.frombuffer(b" ".join([self.strings[i] for i in members.tolist()]), np.uint8)
            sizes = self.windows[heads[members]]
            yield int(bucket[members[0]]), pack(self.ids[doc[members]], place[members], members.astype(np.int32), sizes.astype(np.int32), joined)

    def removed(self, verdicts: list[bytes]) -> np.ndarray:
        """The words covered by a window that starts earlier somewhere."""
        later = np.ones(len(self.first), bool)
        later[self.heads] = False
        repeat = np.repeat(later, self.windows)
        offsets = np.cumsum(self.windows) - self.windows
        for verdict in verdicts:
            numbers, bits = unpack(verdict, "<i4", "u1")
            heads = self.heads[numbers]
            sizes = self.windows[heads]
            firsts = np.unpackbits(bits, count=int(sizes.sum())).astype(bool)
            repeat[_ranges(offsets[heads], sizes)] = ~firsts
        marks = np.zeros(len(self.starts) + 1, np.int64)
        marks[_ranges(self.first, self.windows)[repeat]] = 1
        total = np.append(0, np.cumsum(marks))
        place = np.arange(len(self.starts))
        return total[place + 1] > total[np.maximum(place - self.window + 1, 0)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i] - 1`` for all i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


# --- the three steps ---


def _batches(docs: DataFrame) -> DataFrame:
    """``batch, payload``: documents in batches of about BATCH_BYTES of words, in order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            held.sort(key=lambda d: d[0])
            payload = pack(
                np.array([d[0] for d in held], "<i8"),
                np.array([d[1] for d in held], "<i8"),
                np.frombuffer(b" ".join([d[2] for d in held if d[1]]), np.uint8),
            )
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([payload], pa.binary())], ["batch", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = text.encode().split() if text else []
                    joined = b" ".join(words)
                    held.append((LAST if doc_id is None else doc_id, len(words), joined))
                    size += len(joined) + 16
                    if size >= BATCH_BYTES:
                        yield packed()
                        held, size, number = [], 0, number + 1
        if held:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(run), "batch long, payload binary")


def _verdict(rows: list[tuple[int, bytes]], window: int) -> Iterator[tuple[int, bytes]]:
    """Of one bucket: for each batch the super-k-mers with a window that is not the first of its kind."""
    parts = [unpack(payload, "<i8", "<i8", "<i4", "<i4", "u1") for _, payload in rows]
    batch = np.repeat([b for b, _ in rows], [len(p[0]) for p in parts])
    ids, place, numbers, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
    text = b" ".join([p[4].tobytes() for p in parts])
    del parts
    starts, ends = word_spans(np.frombuffer(text, np.uint8))
    hashes = _combined(word_hashes(np.frombuffer(text, np.uint8), starts, ends), window)
    words = sizes.astype(np.int64) + window - 1
    base = np.cumsum(words) - words
    # in the order of documents, so that of equal windows the first one met is the first there is
    order = np.lexsort((place, batch, ids))
    sizes, base = sizes[order].astype(np.int64), base[order]
    at = _ranges(base, sizes)
    hashes = hashes[at]
    by_hash = np.argsort(hashes, kind="stable")
    fresh = np.append(True, hashes[by_hash][1:] != hashes[by_hash][:-1])
    head = by_hash[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
    copies = np.flatnonzero(~fresh)
    mine, its = at[by_hash[copies]], at[head[copies]]
    last = window - 1
    spans = zip(starts[mine].tolist(), ends[mine + last].tolist(), starts[its].tolist(), ends[its + last].tolist())
    equal = np.array([text[a:b] == text[c:d] for a, b, c, d in spans], bool)
    first = np.ones(len(at), bool)
    first[by_hash[copies]] = False
    for run in np.unique(head[copies[~equal]]):
        # different windows with one hash: tell them apart by their text
        known = set()
        for i in by_hash[head == run].tolist():
            content = text[starts[at[i]] : ends[at[i] + last]]
            first[i] = content not in known
            known.add(content)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    told = np.flatnonzero(np.bincount(owner[~first], minlength=len(sizes)))
    told = told[np.argsort(batch[order][told], kind="stable")]
    offsets = np.cumsum(sizes) - sizes
    of = batch[order][told]
    for members in np.split(told, np.flatnonzero(np.diff(of)) + 1) if len(told) else ():
        bits = np.packbits(first[_ranges(offsets[members], sizes[members])])
        yield int(batch[order][members[0]]), pack(numbers[order][members].astype("<i4"), bits)


def _grouped(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key, from batches that are sorted by it."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(n) for n in (key, *names)]
        for row in range(batch.num_rows):
            found = columns[0][row].as_py()
            if found != current:
                if rows:
                    yield current, rows
                current, rows = found, []
            rows.append(tuple(c[row].as_py() for c in columns[1:]))
    if rows:
        yield current, rows


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each document without the passages that stand earlier.

    Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
    return. A word goes if it is covered by a window of ``window`` words that also starts earlier, in a
    document with a smaller ``doc_id`` or further up in the same one; windows are judged on the input.
    ``kept`` has the other words joined by single blanks. A null text has no words. A null ``doc_id``
    comes after all others and is returned as null. Rows that repeat a ``doc_id`` count as further
    documents, one after the other. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    stored = written(_batches(docs), "substring-batches")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word stands in about three super-k-mers
    buckets = max(3 * partitions(spark), 3 * size // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("batch").to_pylist(), batch.column("payload")):
                for bucket, block in Batch(payload.as_py(), window).blocks(buckets):
                    arrays = [pa.array([bucket], pa.int64()), pa.array([number], pa.int64()), pa.array([block], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "batch", "payload"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "bucket", ("batch", "payload")):
            found = list(_verdict(rows, window))
            arrays = [pa.array([b for b, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["batch", "payload"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "batch", ("kind", "payload")):
            batch = Batch(rows[0][1], window)
            gone = batch.removed([payload for _, payload in rows[1:]])
            yield from _results(batch, gone)

    sent = stored.mapInArrow(tidied(send), "bucket long, batch long, payload binary")
    owned = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    verdicts = owned.mapInArrow(tidied(judge), "batch long, payload binary")
    both = stored.select("batch", F.lit(0).alias("kind"), "payload").unionByName(verdicts.select("batch", F.lit(1).alias("kind"), "payload"))
    met = both.repartition(partitions(spark), "batch").sortWithinPartitions("batch", "kind")
    return met.mapInArrow(tidied(apply), "doc_id long, n_words long, n_removed long, kept string")


def _results(batch: Batch, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    counts = batch.counts
    stops = np.cumsum(counts)
    total = np.append(0, np.cumsum(gone))
    removed = total[stops] - total[stops - counts]
    # a word is kept with the blank after it; the last blank of a document is cut
    lengths = batch.ends - batch.starts + 1
    kept_lengths = np.append(0, np.cumsum(np.where(gone, 0, lengths)))
    data = np.append(batch.data, np.uint8(0x20))[np.repeat(~gone, lengths)] if len(lengths) else batch.data
    kept = data.tobytes()
    for at in range(0, len(counts), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        lo, hi = kept_lengths[(stops - counts)[part]].tolist(), kept_lengths[stops[part]].tolist()
        ids = batch.ids[part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=ids == LAST),
                pa.array(counts[part], pa.int64()),
                pa.array(removed[part], pa.int64()),
                pa.array([kept[a : max(a, b - 1)].decode() for a, b in zip(lo, hi)], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )
