"""Self-join on the Jaccard similarity of word shingles, size-aware and exact.

Small sets are light: each enumerates its subsets of the overlap that a partner needs, and linked sets
share one. Large sets are heavy: they enter inverted lists under the rarest part of their shingles
(a prefix that linked sets must share), and lists are scanned. The boundary is the size at which the
subsets of all smaller sets cost as much as scanning lists for them would.

Equal sets are merged first, by fingerprint. Then two rounds find the links:

1. Under a few minimum hashes every set meets the smallest document of the list, its hub. That links
   groups of near copies as stars, a row per document however large the group.
2. Components being known, only lists that hold two components matter. Batches send each key once per
   component, so a large group sends a row per batch; of open lists the members are compared across
   components, with bounds on size and on a parity sketch before any text is read.

Both rounds verify on the words themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import most_frequent, partitions, tidied, unused, written
from tidemark.llm.components import components
from tidemark.llm.substrings import U, _combined, _mixed, pack, unpack, word_hashes

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
ROUND_BYTES = 2 << 20
FIRSTS = 4
HEAVY_USES = 3
COUNTED_AT_ONCE = 1_000_000
HEAVY_TOKENS = 1 << 16
LIGHT_AT_MOST = 24
SCAN_WEIGHT = 4
SKETCH_WORDS = 8
FEWEST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 28
PAIRS_PER_TEXT = 500
BUCKET_BYTES = 12 << 20
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


# --- sets ---


def shingle_words(text: str | None) -> bytes:
    """The words of a text with A-Z in lower case, joined by single blanks."""
    return b" ".join(text.encode().lower().split()) if text else b""


def exact_shingles(words: bytes) -> set[bytes]:
    """The distinct shingles themselves; blanks cannot be part of a word."""
    parts = words.split()
    if len(parts) < SHINGLE:
        return {words} if parts else set()
    stops = np.cumsum([len(p) + 1 for p in parts])
    starts = (stops - [len(p) + 1 for p in parts]).tolist()
    ends = (stops - 1)[SHINGLE - 1 :].tolist()
    return {words[a:b] for a, b in zip(starts, ends)}


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of each text."""
    joined = b" ".join([t for t in texts if t])
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data == 0x20)
    starts = np.append(0, blanks + 1) if len(data) else np.empty(0, np.int64)
    ends = np.append(blanks, len(data)) if len(data) else np.empty(0, np.int64)
    hashes = word_hashes(data, starts, ends)
    runs = _combined(hashes, SHINGLE)
    sets, at = [], 0
    for text in texts:
        n = text.count(b" ") + 1 if text else 0
        if n >= SHINGLE:
            sets.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        elif n:
            sets.append(_mixed(_combined(hashes[at : at + n], n) + U(n)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def _rounds(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows with their sets, a bounded amount of text at a time."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*[part.column(n).to_pylist() for n in names]):
                words = shingle_words(row[-1])
                rows.append((*row[:-1], words))
                size += len(words) + 64
                if size >= ROUND_BYTES:
                    yield rows, shingle_sets([r[-1] for r in rows])
                    rows, size = [], 0
    if rows:
        yield rows, shingle_sets([r[-1] for r in rows])


def needed_overlap(a: int, b: int) -> int:
    """Shared shingles that sets of sizes ``a`` and ``b`` need for a link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The subset sizes a light set of ``n`` shingles enumerates, one per overlap it may need."""
    low, high = -(-NUMERATOR * n // DENOMINATOR), min(boundary, n * DENOMINATOR // NUMERATOR)
    return sorted({needed_overlap(n, m) for m in range(low, high + 1)})


def choose_boundary(sizes: dict[int, int]) -> int:
    """The largest size of light sets, by the cost of all keys: subsets below, list entries above.

    ``sizes`` has the number of sets of each size up to LIGHT_AT_MOST. Sets that a heavy partner can
    reach enter the lists as well.
    """

    def cost(boundary: int) -> float:
        light = sum(sizes.get(n, 0) * sum(math.comb(n, c) for c in subset_sizes(n, boundary)) for n in range(1, boundary + 1))
        reached = -(-NUMERATOR * (boundary + 1) // DENOMINATOR)
        return light + SCAN_WEIGHT * sum(sizes.get(n, 0) * prefix_length(n) for n in range(reached, LIGHT_AT_MOST + 1))

    return min(range(LIGHT_AT_MOST + 1), key=lambda b: (cost(b), b))


# --- the table of sets ---


def _describe(docs: DataFrame) -> DataFrame:
    """One row per document: size, fingerprint, sketches, minimum hashes; and one per frequent shingle.

    A shingle is reported with its uses when HEAVY_USES different sets have it among those that are
    counted together, about COUNTED_AT_ONCE shingles of a task. That only orders the keys of sets.
    """

    def documents(rows: list, sets: list[np.ndarray], prints: list[bytes]) -> pa.RecordBatch:
        narrow = np.zeros((len(sets), SKETCH_WORDS), np.uint64)
        for i, found in enumerate(sets):
            np.bitwise_xor.at(narrow[i], (found >> U(6)) % U(SKETCH_WORDS), U(1) << (found & U(63)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([True] * len(rows)),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array([wide_sketch(s) for s in sets], pa.binary()),
                *[pa.array(narrow[:, k].astype(np.int64)) for k in range(SKETCH_WORDS)],
                pa.array([s[:FIRSTS].astype(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
            ],
            names,
        )

    def frequent(counted: list[np.ndarray]) -> pa.RecordBatch:
        tokens, uses = np.unique(np.concatenate(counted), return_counts=True)
        tokens, uses = tokens[uses >= HEAVY_USES].astype(np.int64), uses[uses >= HEAVY_USES]
        n = len(tokens)
        none = [pa.nulls(n, pa.int64())] * SKETCH_WORDS
        columns = [pa.array([False] * n, pa.bool_()), pa.nulls(n, pa.int64()), pa.array(uses, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *none, pa.array([[t] for t in tokens.tolist()], pa.list_(pa.int64()))], names)

    names = ["is_doc", "doc_id", "n", "print", "wide", *SKETCH, "firsts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[bytes, np.ndarray] = {}
        held = 0
        for rows, sets in _rounds(batches, ("doc_id", "text")):
            prints = []
            for found in sets:
                mixed = _mixed(found ^ U(0xA5A5A5A5)).sum(dtype=np.uint64)
                print_ = np.array([np.bitwise_xor.reduce(_mixed(found)), mixed, len(found)], "<u8").tobytes()
                prints.append(print_)
                held += 0 if print_ in counted else len(found)
                counted[print_] = found
            yield documents(rows, sets, prints)
            if held >= COUNTED_AT_ONCE:
                yield frequent(list(counted.values()))
                counted, held = {}, 0
        if counted:
            yield frequent(list(counted.values()))

    schema = "is_doc boolean, doc_id long, n long, print binary, wide binary, " + ", ".join(f"{s} long" for s in SKETCH) + ", firsts array<long>"
    return written(_rows(docs).mapInArrow(tidied(run), schema), "jaccard-sets")


def wide_sketch(found: np.ndarray) -> bytes:
    """Parities of a set's hashes over a power of two of bits, no fewer than the set has shingles."""
    bits = max(512, 1 << (len(found) - 1).bit_length()) if len(found) else 512
    return np.packbits((np.bincount((found & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, size), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _may_link(n: Column, m: Column, left: list[Column], right: list[Column]) -> Column:
    """Bounds every link keeps: sizes within 4/5, and no more different shingles than it allows.

    Two sets differ in at least as many shingles as their parity sketches differ in bits.
    """
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)), F.lit(0))
    smaller, larger = F.least(n, m), F.greatest(n, m)
    close = F.lit(DENOMINATOR) * smaller >= F.lit(NUMERATOR) * larger
    return close & (F.lit(DENOMINATOR + NUMERATOR) * differ <= (n + m) * F.lit(DENOMINATOR - NUMERATOR))


# --- bounded filters ---


def _bits_for(count: int) -> int:
    """Bits of a filter over ``count`` things: about sixteen each, a power of two, bounded."""
    return min(MOST_FILTER_BITS, max(FEWEST_FILTER_BITS, 1 << (16 * count).bit_length()))


def _bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """``size`` bits with those in the column ``bit`` set, built in pieces of 4 KB by the executors.

    It may have false hits, never misses.
    """
    pieces = bits.groupBy(F.floor(F.col("bit") / 32768).alias("piece")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    found = np.zeros(size // 8, np.uint8)
    for piece, part in pieces.collect():
        found[piece * 4096 : piece * 4096 + len(part)] |= np.frombuffer(bytes(part), np.uint8)
    return found


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class _Members:
    """Ids of documents in a broadcast filter of bounded size, or beyond that size as a table."""

    def __init__(self, ids: DataFrame):
        self.ids, count = ids, ids.count()
        size = _bits_for(count)
        self.bits = None
        if 8 * count <= size:
            places = ids.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(size)).alias("bit"))
            self.bits, self.size = ids.sparkSession.sparkContext.broadcast(_bitmap(places, size)), size

    def rows(self, docs: DataFrame, inside: bool) -> DataFrame:
        """``doc_id, text`` of the documents that may be among the ids, or of all others."""
        if self.bits is None:
            return _rows(docs).join(self.ids.distinct(), "doc_id", "left_semi" if inside else "left_anti")
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = _has(bits.value, batch.column("place").to_numpy(zero_copy_only=False))
                yield batch.select(["doc_id", "text"]).filter(pa.array(hit if inside else ~hit))

        place = F.pmod(F.xxhash64("doc_id"), F.lit(self.size)).alias("place")
        return _rows(docs).select("doc_id", "text", place).mapInArrow(tidied(run), "doc_id long, text string")


# --- verification ---


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose wide sketches allow a link; they are as wide as the sets, so long texts count too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns = [part.column(n).to_pylist() for n in ("n_a", "n_b", "wide_a", "wide_b")]
                kept = [
                    (DENOMINATOR + NUMERATOR) * sketches_differ(x, y) <= (n + m) * (DENOMINATOR - NUMERATOR)
                    for n, m, x, y in zip(*columns)
                ]
                arrays = [part.column("a"), part.column("b")]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b"]).filter(pa.array(kept))

    first = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("wide_a"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b"))
    return pairs.join(first, "a").join(other, "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(tidied(run), "a long, b long")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of documents that link, decided on their words.

    ``sets`` has the size and the wide sketch of every document in ``pairs``. The text of ``b`` comes
    once for every PAIRS_PER_TEXT of its pairs, which are dealt out over as many tasks: a hub with a
    third of all documents is neither one task's work nor copied into every pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                links = []
                for b, salt, a, text in zip(*[part.column(n).to_pylist() for n in ("b", "salt", "a", "text")]):
                    if (b, salt) != current:
                        current, held = (b, salt), []
                    found = exact_shingles(shingle_words(text))
                    if a is None:
                        held.append(found)
                    elif any(_links(found, other) for other in held):
                        links.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    wanted = written(_plausible(pairs, sets), "jaccard-pairs")
    ids = wanted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(_Members(ids).rows(docs, True), "jaccard-texts")
    slots = wanted.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TEXT).cast("int").alias("slots"))
    salted = wanted.join(slots, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("salt"))
    ones = salted.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", "a", "text")
    hubs = slots.join(texts.withColumnRenamed("doc_id", "b"), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    met = hubs.unionByName(ones).repartition(partitions(docs.sparkSession), "b", "salt")
    return met.sortWithinPartitions("b", "salt", F.asc_nulls_first("a")).mapInArrow(tidied(run), "a long, b long")


def _links(one: set[bytes], other: set[bytes]) -> bool:
    shared = len(one & other)
    return shared > 0 and DENOMINATOR * shared >= NUMERATOR * (len(one) + len(other) - shared)


# --- the second round ---


class Keys:
    """The keys a set enters lists under; equal for all documents of a run."""

    def __init__(self, boundary: int, heavy: np.ndarray):
        # heavy: frequent shingles, the most frequent last
        self.boundary = boundary
        self.order = np.argsort(heavy)
        self.heavy = heavy[self.order]

    def of(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        parts = []
        if 0 < n <= self.boundary:
            for size in subset_sizes(n, self.boundary):
                subsets = np.array(list(itertools.combinations(range(n), size)))
                total = np.zeros(len(subsets), np.uint64)
                for column in subsets.T:
                    total += _mixed(found[column] ^ U(0x5BD1E995))
                parts.append(_mixed(total + U(size)))
        if n and DENOMINATOR * n >= NUMERATOR * (self.boundary + 1):
            ordered = found
            if len(self.heavy):
                at = np.minimum(np.searchsorted(self.heavy, found), len(self.heavy) - 1)
                late = np.where(self.heavy[at] == found, self.order[at] + 1, 0)
                ordered = found[np.argsort(late, kind="stable")]
            parts.append(ordered[: prefix_length(n)])
        return np.concatenate(parts) if parts else found[:0]


def _with_components(docs: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, component, text`` of the documents that stand for their set.

    A document that is alone in its set and component needs no join; a bounded filter tells which may
    not be, and only those are shuffled, once.
    """
    grouped = reps.filter("doc_id <> rep").select("doc_id").unionByName(known.select(F.col("node").alias("doc_id")))
    found = _Members(grouped)
    alone = found.rows(docs, False).select("doc_id", F.col("doc_id").alias("component"), "text")
    # of the rows in question, those that are the first of their set
    standing = reps.filter("doc_id = rep").join(known, F.col("doc_id") == F.col("node"), "left")
    standing = standing.select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = found.rows(docs, True).join(standing, "doc_id").select("doc_id", "component", "text")
    return alone.unionByName(written(rest, "jaccard-standing"))


def _open_keys(rows: DataFrame, keys, entries: int) -> DataFrame:
    """The keys whose lists hold more than one component."""
    spark = rows.sparkSession
    buckets = max(4 * partitions(spark), 16 * entries // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sets in _rounds(batches, ("component", "text")):
            lists = [keys.value.of(s) for s in sets]
            component = np.repeat(np.array([r[0] for r in held], np.int64), [len(x) for x in lists])
            listed = np.concatenate(lists) if lists else np.empty(0, np.uint64)
            order = np.lexsort((component, listed))
            listed, component = listed[order], component[order]
            fresh = np.ones(len(listed), bool)
            fresh[1:] = (listed[1:] != listed[:-1]) | (component[1:] != component[:-1])
            listed, component = listed[fresh], component[fresh]
            bucket = (_mixed(listed) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for members in np.split(order, cuts) if len(order) else ():
                names, place = np.unique(component[members], return_inverse=True)
                block = pack(listed[members], names, place.astype(np.int32))
                arrays = [pa.array([int(bucket[members[0]])], pa.int64()), pa.array([block], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "payload"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def batch_of(listed: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(listed.astype(np.int64))], ["key"])

        def found() -> pa.RecordBatch:
            parts = [unpack(p, "<u8", "<i8", "<i4") for p in held]
            listed = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
            component = np.concatenate([p[1][p[2]] for p in parts]) if parts else np.empty(0, np.int64)
            order = np.argsort(listed)
            listed, component = listed[order], component[order]
            if not len(listed):
                return batch_of(listed)
            at = np.flatnonzero(np.append(True, listed[1:] != listed[:-1]))
            several = listed[at][np.minimum.reduceat(component, at) != np.maximum.reduceat(component, at)]
            return batch_of(several)

        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if bucket != current:
                    if held:
                        yield found()
                    current, held = bucket, []
                held.append(payload.as_py())
        yield found()

    sent = rows.mapInArrow(tidied(send), "bucket long, payload binary")
    owned = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return written(owned.mapInArrow(tidied(scan), "key long"), "jaccard-keys")


def _members(rows: DataFrame, keys, open_keys: DataFrame) -> DataFrame:
    """``key, doc_id, component`` of the entries of open lists.

    A filter of bounded size leaves most other entries where they are; the join decides.
    """
    count = open_keys.count()
    size = _bits_for(count)
    bits = _bitmap(open_keys.select(F.pmod("key", F.lit(size)).alias("bit")), size) if 2 * count <= size else None
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sets in _rounds(batches, ("doc_id", "component", "text")):
            lists = [keys.value.of(s) for s in sets]
            listed = np.concatenate(lists)
            kept = np.ones(len(listed), bool) if shared.value is None else _has(shared.value, (listed & U(size - 1)).astype(np.int64))
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[kept]
            ids, groups = (np.array([r[k] for r in held], np.int64)[owner] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(listed[kept].astype(np.int64)), pa.array(ids), pa.array(groups)], ["key", "doc_id", "component"]
            )

    entries = rows.mapInArrow(tidied(run), "key long, doc_id long, component long")
    return entries.join(open_keys.select("key"), "key", "left_semi") if bits is None else entries


# --- the join ---


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A document's set has the distinct runs of five words, A-Z made lower case; with fewer words the whole
    sequence is one shingle; without words or text the set is empty and links with nothing. Two documents
    link when ``100 * shared >= 80 * united``. ``component_id`` is the smallest ``doc_id`` that links
    lead to, its own included. A null ``doc_id`` takes no part in links and has a null component. Rows
    that repeat a ``doc_id`` are one node. Other columns are not read; an empty table gives no rows.

    No pair is given up: set sizes, sketches and lists only rule out what cannot link.
    """
    spark = docs.sparkSession
    described = _describe(docs)
    rows = described.filter("is_doc").drop("is_doc")
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL")
    first = nodes.groupBy("print").agg(F.min("doc_id").alias("rep"))
    reps = written(nodes.join(first, "print").select("doc_id", "rep", "n", "wide", *SKETCH, "firsts"), "jaccard-reps")
    standing = reps.filter("doc_id = rep")

    # first round: each set against the smallest document under its minimum hashes
    whole = F.struct("doc_id", "n", *SKETCH)
    entries = standing.select(F.explode("firsts").alias("key"), whole.alias("doc"))
    hubs = entries.groupBy("key").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("uses")).filter("uses > 1").drop("uses")
    sketch = lambda name: [F.col(f"{name}.{s}") for s in SKETCH]
    met = entries.join(hubs, "key").filter("doc.doc_id <> hub.doc_id")
    near = met.filter(_may_link(F.col("doc.n"), F.col("hub.n"), sketch("doc"), sketch("hub")))
    pairs = near.select(F.col("doc.doc_id").alias("a"), F.col("hub.doc_id").alias("b")).distinct()
    stars = written(_verified(docs, standing, pairs), "jaccard-links")
    known = written(components(stars), "jaccard-components")

    # second round: keys whose lists hold several components
    heavy = described.filter("NOT is_doc").groupBy(F.col("firsts")[0].alias("token")).agg(F.sum("n").alias("uses"))
    heavy = sorted((uses, token) for token, uses in most_frequent(written(heavy, "jaccard-heavy"), HEAVY_TOKENS, "uses").collect())
    tokens = np.array([token for _, token in heavy], np.int64).astype(np.uint64)
    sizes = {n: c for n, c in standing.filter(F.col("n") <= LIGHT_AT_MOST).groupBy("n").count().collect()}
    keys = spark.sparkContext.broadcast(Keys(choose_boundary(sizes), tokens))
    entries_now = standing.agg(F.sum(F.floor(F.col("n") / DENOMINATOR) + 1)).first()[0] or 0
    owned = _with_components(docs.filter("doc_id IS NOT NULL"), reps, known)
    open_keys = _open_keys(owned, keys, entries_now)
    members = _members(owned, keys, open_keys)
    held = members.join(standing.select("doc_id", "n", *SKETCH), "doc_id")
    held = written(held.select("key", F.struct("doc_id", "component", "n", *SKETCH).alias("doc")), "jaccard-members")
    other = held.select("key", F.col("doc").alias("other"))
    across = F.col("doc.doc_id") > F.col("other.doc_id")
    across = across & (F.col("doc.component") != F.col("other.component"))
    across = across & _may_link(F.col("doc.n"), F.col("other.n"), sketch("doc"), sketch("other"))
    left = held.join(other, "key").filter(across)
    pairs = left.select(F.col("doc.doc_id").alias("a"), F.col("other.doc_id").alias("b")).distinct()
    links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verified(docs, standing, pairs))
    linked = components(links)

    found = reps.select("doc_id", "rep").distinct().join(linked, F.col("rep") == F.col("node"), "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    plain = rows.select("doc_id", F.col("n").alias("n_shingles"))
    return plain.join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest ``doc_id``.

    All columns stay; documents without words and rows with a null ``doc_id`` stay too. Rows that repeat
    a ``doc_id`` stay or go together; an empty table gives no rows.
    """
    name = unused(docs, "_dropped")
    dropped = near_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")
