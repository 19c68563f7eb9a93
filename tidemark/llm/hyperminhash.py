"""Near copies by HyperMinHash sketches of word-pair sets.

A set's shingles are dealt over BUCKETS by hash; a register keeps of the smallest hash in its bucket only the
count of leading zeros and MANTISSA bits after them, 16 bits in all. Registers of empty buckets borrow, for
banding alone, the register of the first filled bucket in an order of their own, so small sets fill all bands.
Documents that agree on a band of registers meet. The share of equal registers, corrected for registers that
agree by chance at the given set sizes, estimates the similarity, and pairs far below the threshold are left
out; every other one is decided on the whole sets of words.

Equal sets are merged first. Then no pair within a group of near copies is spelled out:

1. A document is compared with the likeliest of a few that are the smallest in most of its bands. If they
   link it joins that centre, at an exact distance.
2. In bands that still hold several groups, centres are compared. The Jaccard distance is a metric, so
   two centres further apart than the threshold and their radii have no links between their members.
3. Of the other pairs of centres that are still apart, members that lie far enough out are compared where the
   members of the larger one are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, tidied, written
from tidemark.llm.components import components
from tidemark.llm.substrings import U, _combined, _mixed, word_hashes, word_spans

SHINGLE = 2
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 40, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
# pairs whose estimate is this many standard deviations below the threshold are left out
DEVIATIONS = 5.0
ROUND_BYTES = 2 << 20
PAIRS_PER_TEXT = 500
# hubs a document is estimated against to find its centre; whom it misses there it meets among the centres
HUBS = 6
MEMBERS_PER_SLOT = 512
PASSING_PER_SLOT = 4096
SALTS = 16


# --- sets ---


def plain_words(text: str | None) -> bytes:
    """The words of a text with A-Z in lower case, joined by single blanks."""
    return b" ".join(text.encode().lower().split()) if text else b""


def word_pairs(words: bytes) -> set[bytes]:
    """The distinct shingles; the whole sequence if it is shorter than one."""
    parts = words.split(b" ") if words else []
    if len(parts) < SHINGLE:
        return {words} if parts else set()
    return {b" ".join(p) for p in zip(*[parts[k:] for k in range(SHINGLE)])}


def hashed_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of each text."""
    data = np.frombuffer(b" ".join([t for t in texts if t]), np.uint8)
    hashes = word_hashes(data, *word_spans(data))
    runs = _combined(hashes, SHINGLE)
    sets, at = [], 0
    for text in texts:
        n = text.count(b" ") + 1 if text else 0
        if n >= SHINGLE:
            sets.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        else:
            sets.append(_mixed(_combined(hashes[at : at + n], n) + U(n)) if n else np.empty(0, np.uint64))
        at += n
    return sets


# --- sketches ---


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one of 64-bit hashes, in 16 bits."""
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 53 - MANTISSA).astype(np.uint64)
    after = (least << (zeros + U(1))) >> U(64 - MANTISSA)
    return ((zeros << U(MANTISSA)) | after).astype(np.uint16)


def registers(found: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes; EMPTY where no hash falls into the bucket."""
    mixed = _mixed(found ^ U(0x243F6A8885A308D3))
    bucket = ((found >> U(32)) * U(BUCKETS)) >> U(32)
    least = np.full(BUCKETS, U(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, bucket.astype(np.int64), mixed)
    filled = np.zeros(BUCKETS, bool)
    filled[bucket.astype(np.int64)] = True
    return np.where(filled, compressed(least), np.uint16(EMPTY))


_ORDERS = np.argsort(np.random.default_rng(11).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.uint8)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key per band of a sketch; none if all buckets are empty."""
    filled = np.flatnonzero(sketch != EMPTY)
    if not len(filled):
        return np.empty(0, np.uint64)
    whole = sketch.astype(np.uint64)
    empty = np.flatnonzero(sketch == EMPTY)
    if len(empty):
        # which bucket is borrowed from is part of what must agree
        lender = filled[_ORDERS[np.ix_(empty, filled)].argmin(axis=1)]
        whole[empty] = whole[lender] | (lender.astype(np.uint64) + U(1)) << U(16)
    bands = whole.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = _mixed(total ^ _mixed(bands[:, k] + U(1)))
    return total


_LEVELS = np.arange(54 - MANTISSA, dtype=np.float64)


def chance_of_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of ``n`` and ``m`` hashes agree: the level is the same, and the mantissa."""

    def levels(size: np.ndarray) -> np.ndarray:
        share = np.maximum(size[:, None] / BUCKETS, 1.0)
        return np.exp(share * np.log1p(-(2.0 ** -(_LEVELS + 1)))) - np.exp(share * np.log1p(-np.minimum(2.0**-_LEVELS, 1 - 1e-15)))

    return (levels(n) * levels(m)).sum(axis=1) / (1 << MANTISSA)


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs of sketches (rows), and how far below the threshold that of a link may lie."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    chance = chance_of_equal(n.astype(np.float64), m.astype(np.float64))
    share = equal / np.maximum(used, 1)
    # a pair at the threshold: registers are drawn from its united set without putting back
    limit = NUMERATOR / DENOMINATOR
    united = np.maximum((n + m) / (1 + limit), 1.0)
    left = np.clip(1 - used / united, 1 / united, 1.0)
    deviation = np.sqrt(limit * (1 - limit) * left / np.maximum(used, 1))
    return (share - chance) / (1 - chance), DEVIATIONS * deviation + 1 / np.maximum(used, 1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n, print, sketch`` per row: size, fingerprint and sketch of its set."""
    names = ["doc_id", "n", "print", "sketch"]

    def described(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        sets = hashed_sets([words for _, words in rows])
        prints = []
        for found in sets:
            twice = _mixed(found ^ U(0xA5A5A5A5)).sum(dtype=np.uint64)
            prints.append(np.array([np.bitwise_xor.reduce(_mixed(found)), twice, len(found)], "<u8").tobytes())
        sketches = [registers(found).tobytes() if len(found) else None for found in sets]
        columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    rows.append((doc_id, plain_words(text)))
                    size += len(rows[-1][1]) + 64
                    if size >= ROUND_BYTES:
                        yield described(rows)
                        rows, size = [], 0
        if rows:
            yield described(rows)

    return _rows(docs).mapInArrow(tidied(run), "doc_id long, n long, print binary, sketch binary")


def _entries(sets: DataFrame) -> DataFrame:
    """``key, doc_id``: every band of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = [band_keys(np.frombuffer(s, np.uint16)) for s in part.column("sketch").to_pylist()]
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), ids], ["key", "doc_id"])

    return sets.select("doc_id", "sketch").mapInArrow(tidied(run), "key long, doc_id long")


# --- pairs ---


def _sizes_allow(n: Column, m: Column, slack: Column) -> Column:
    """Sets of these sizes, or members within ``slack`` in all around them, may have the similarity asked for."""
    least = F.lit(NUMERATOR / DENOMINATOR) * (1 - slack) * (1 - 1e-9)
    return (m >= n * least) & (n >= m * least)


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, slack`` with ``estimate`` and sizes ``n, m``, where the sketches allow a similarity within ``slack`` of the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("sketch_a"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
    met = pairs.join(one, "a").join(other, "b").filter(_sizes_allow(F.col("n"), F.col("m"), F.col("slack")))
    names = ["a", "b", "slack", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b")
                )
                n, m, slack = (part.column(c).to_numpy() for c in ("n", "m", "slack"))
                found, margin = estimates(x, y, n, m)
                kept = pa.array(found + margin >= NUMERATOR / DENOMINATOR - slack)
                columns = [*[part.column(c) for c in names], pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "estimate"]).filter(kept)

    return met.select(*names, "sketch_a", "sketch_b").mapInArrow(tidied(run), "a long, b long, slack double, n long, m long, estimate double")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, shared, united`` of pairs, counted on the whole sets of words.

    The text of ``b`` comes once for every PAIRS_PER_TEXT of its pairs, which are dealt out over as many
    tasks: a centre with a third of all documents is neither one task's work nor copied into every pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for b, salt, a, text in zip(*[part.column(n).to_pylist() for n in ("b", "salt", "a", "text")]):
                    if (b, salt) != current:
                        current, held = (b, salt), []
                    found = word_pairs(plain_words(text))
                    if a is None:
                        held.append(found)
                        continue
                    for other in held:
                        shared = len(found & other)
                        out.append((a, b, shared, len(found) + len(other) - shared))
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared", "united"])

    pairs = pairs.select("a", "b")
    slots = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TEXT).cast("int").alias("slots"))
    salted = pairs.join(slots, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("salt"))
    ones = salted.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", "a", "text")
    hubs = slots.join(texts.withColumnRenamed("doc_id", "b"), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    met = hubs.unionByName(ones).repartition(partitions(pairs.sparkSession), "b", "salt")
    return met.sortWithinPartitions("b", "salt", F.asc_nulls_first("a")).mapInArrow(tidied(run), "a long, b long, shared long, united long")


def _links() -> Column:
    return (F.col("shared") > 0) & (DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("united"))


def _likeness() -> Column:
    """The estimate; well above the threshold all are alike, so the smallest hub is taken and centres are few."""
    return F.least("estimate", F.lit(NUMERATOR / DENOMINATOR + 0.05)).alias("likeness")


def _distance() -> Column:
    return 1 - F.col("shared") / F.col("united")


def _near_centres(there: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, slack``: pairs of centres of one band and different components whose members may link.

    ``there`` has ``key, centre, component, radius, n``. The centres of a band are dealt into slots of
    MEMBERS_PER_SLOT, each of which meets all centres of the band; only likely pairs leave a task.
    """
    slots = there.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_SLOT).cast("int").alias("slots"))
    rows = there.join(slots, "key").join(sets.select(F.col("doc_id").alias("centre"), "sketch"), "centre")
    columns = ["centre", "component", "radius", "n", "sketch"]
    own = F.pmod(F.xxhash64("centre"), F.col("slots")).cast("int").alias("slot")
    held = rows.select("key", own, F.lit(False).alias("passes"), *columns)
    passing = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("passes"), *columns)
    limit = NUMERATOR / DENOMINATOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, table = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = []
                for key, slot, passes, *row in zip(*[c.to_pylist() for c in part.columns]):
                    if (key, slot) != current:
                        current, rows, table = (key, slot), [], None
                    if not passes:
                        rows.append(row)
                        continue
                    if not rows:
                        continue
                    if table is None:
                        ids, components_, radii, sizes = (np.array(c) for c in list(zip(*rows))[:4])
                        table = ids, components_, radii, sizes, np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, BUCKETS)
                    ids, components_, radii, sizes, sketches = table
                    centre, component, radius, n, sketch = row
                    least = limit * (1 - radii) * (1 - radius) * (1 - 1e-9)
                    near = np.flatnonzero((ids < centre) & (components_ != component) & (n >= sizes * least) & (sizes >= n * least))
                    if len(near):
                        slack = radii[near] + radius
                        mine = np.broadcast_to(np.frombuffer(sketch, np.uint16), (len(near), BUCKETS))
                        guess, margin = estimates(sketches[near], mine, sizes[near], np.full(len(near), n))
                        kept = guess + margin >= limit - slack
                        found += zip([centre] * int(kept.sum()), ids[near][kept].tolist(), slack[kept].tolist())
                columns = list(zip(*found)) or [[]] * 3
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "slack"])

    met = held.unionByName(passing).repartition(partitions(there.sparkSession), "key", "slot").sortWithinPartitions("key", "slot", "passes")
    return met.mapInArrow(tidied(run), "a long, b long, slack double").groupBy("a", "b").agg(F.max("slack").alias("slack"))


def _between(apart: DataFrame, members: DataFrame) -> DataFrame:
    """Links ``a, b`` between members of the centres ``a, b`` that are ``distance`` apart.

    ``members`` has ``centre, doc_id, far, text``. The members of the larger centre are dealt into slots of
    MEMBERS_PER_SLOT, which stay in memory while those of the smaller one pass; only members that together
    lie as far out as the gap between the centres are looked at, first by their sketches. No pair leaves a
    task but a link, decided on the words.
    """
    limit = 1 - NUMERATOR / DENOMINATOR + 1e-9
    sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius"))
    both = apart.join(sizes.select(F.col("centre").alias("a"), F.col("size").alias("size_a"), F.col("radius").alias("radius_a")), "a")
    both = both.join(sizes.select(F.col("centre").alias("b"), F.col("size").alias("size_b"), F.col("radius").alias("radius_b")), "b")
    swap = F.col("size_a") > F.col("size_b")
    one = lambda small, large: F.when(swap, F.col(large)).otherwise(F.col(small))
    gaps = both.select(
        one("a", "b").alias("small"), one("b", "a").alias("large"), one("radius_b", "radius_a").alias("radius"), F.col("distance") - limit,
        F.ceil(F.greatest("size_a", "size_b") / MEMBERS_PER_SLOT).cast("int").alias("slots"),
    ).toDF("small", "large", "radius", "gap", "slots")
    passing = gaps.join(members.withColumnRenamed("centre", "small"), "small").filter(F.col("far") + F.col("radius") >= F.col("gap"))
    passing = passing.select("large", "slots", "doc_id", F.col("text"), (F.col("gap") - F.col("far")).alias("least"))
    counted = passing.groupBy("large", "slots").agg(F.ceil(F.count(F.lit(1)) / PASSING_PER_SLOT).cast("int").alias("salts"))
    passing = passing.join(counted.select("large", "salts"), "large")
    passing = passing.select(
        "large", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"),
        F.lit(True).alias("passes"), "doc_id", F.col("least").alias("far"), "text",
    )
    held = counted.join(members.withColumnRenamed("centre", "large"), "large")
    held = held.select(
        "large", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("slots")).cast("int").alias("slot"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("passes"), "doc_id", "far", "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, slot = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for large, place, salt, passes, doc_id, far, text in zip(*[c.to_pylist() for c in part.columns]):
                    if (large, place, salt) != current:
                        current, rows, slot = (large, place, salt), [], None
                    words = plain_words(text)
                    if not passes:
                        rows.append((doc_id, far, words))
                        continue
                    if not rows:
                        continue
                    slot = slot or _Slot(rows)
                    out += [(doc_id, other) for other in slot.linked(words, far)]
                columns = list(zip(*out)) or [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    met = held.unionByName(passing).repartition(partitions(members.sparkSession), "large", "slot", "salt")
    met = met.sortWithinPartitions("large", "slot", "salt", "passes")
    return met.mapInArrow(tidied(run), "a long, b long")


class _Slot:
    """Members of a centre with their sketches and sets."""

    def __init__(self, rows: list[tuple[int, float, bytes]]):
        self.ids = [r[0] for r in rows]
        self.far = np.array([r[1] for r in rows])
        self.words = [r[2] for r in rows]
        self.sets = hashed_sets(self.words)
        self.sizes = np.array([len(s) for s in self.sets])
        self.sketches = np.array([registers(s) for s in self.sets])

    def linked(self, words: bytes, least: float) -> list[int]:
        """The members at ``least`` or further out that link to a document."""
        (found,) = hashed_sets([words])
        limit = NUMERATOR / DENOMINATOR
        near = np.flatnonzero((self.far >= least) & (np.minimum(self.sizes, len(found)) >= limit * np.maximum(self.sizes, len(found))))
        if not len(near):
            return []
        sketch = np.broadcast_to(registers(found), (len(near), BUCKETS))
        guess, margin = estimates(self.sketches[near], sketch, self.sizes[near], np.full(len(near), len(found)))
        linked, pairs = [], None
        for at in near[guess + margin >= limit].tolist():
            shared = len(np.intersect1d(found, self.sets[at], assume_unique=True))
            if DENOMINATOR * shared >= NUMERATOR * (len(found) + len(self.sets[at]) - shared):
                pairs = pairs or word_pairs(words)
                other = word_pairs(self.words[at])
                shared = len(pairs & other)
                if DENOMINATOR * shared >= NUMERATOR * (len(pairs) + len(other) - shared):
                    linked.append(self.ids[at])
        return linked


# --- groups ---


def _standing(nodes: DataFrame) -> DataFrame:
    """A row per set: the one with the smallest ``doc_id``."""
    first = nodes.groupBy("print").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("first"))
    return first.select("first.*")


def _same_set(nodes: DataFrame) -> DataFrame:
    """``doc_id, rep`` of every row with a set, ``rep`` the smallest document with the same one.

    Only sets of several documents are joined, and these under SALTS keys each, so the rows of one large
    group of copies are not one task's work.
    """
    several = nodes.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep <> last")
    dealt = several.select("print", "rep", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = nodes.select("doc_id", "print", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(dealt, ["print", "salt"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def _with_component(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``df`` with the component of the document in a column; one without links is its own."""
    named = known.select(F.col("node").alias(column), "component")
    return df.join(named, column, "left").withColumn("component", F.coalesce("component", column))


def _followed(pointers: DataFrame) -> DataFrame:
    """``node, component`` with the pointers of pointers followed; they lead to ever smaller ids."""
    for _ in range(2):
        further = pointers.select(F.col("node").alias("component"), F.col("component").alias("next"))
        pointers = pointers.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return pointers


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are not in one component."""
    one = known.select(F.col("node").alias("a"), F.col("component").alias("in_a"))
    other = known.select(F.col("node").alias("b"), F.col("component").alias("in_b"))
    met = pairs.join(one, "a", "left").join(other, "b", "left")
    return met.filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).drop("in_a", "in_b")


def linked_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` between documents of ``sets(doc_id, n, sketch)`` that connect all links between them."""
    entries = written(_entries(sets), "hyperminhash-entries")
    hubs = entries.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub <> last").drop("last")
    met = written(entries.join(hubs, "key"), "hyperminhash-met")
    involved = met.select("doc_id").distinct()
    sets = written(sets.join(involved, "doc_id", "left_semi"), "hyperminhash-sets")
    texts = written(_rows(docs).join(involved, "doc_id", "left_semi").distinct(), "hyperminhash-texts")

    # each document with the likeliest of the hubs of most of its bands
    pairs = met.filter("doc_id <> hub").repartition(partitions(docs.sparkSession), "doc_id").groupBy("doc_id", "hub").count()
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "hub")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS)
    pairs = _plausible(pairs.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"), F.lit(0.0).alias("slack")), sets)
    likely = pairs.groupBy("a").agg(F.max_by("b", F.struct(_likeness(), (-F.col("b")).alias("order"))).alias("b"))
    likely = written(likely, "hyperminhash-pairs")
    stars = written(_compared(likely, texts).filter(_links()), "hyperminhash-stars")
    edges = stars.select("a", "b")

    # a document belongs to its hub, or is a centre
    centred = stars.groupBy("a").agg(F.min(F.struct(_distance().alias("far"), F.col("b").alias("centre"))).alias("near"))
    placed = met.select("key", "doc_id").join(centred.select(F.col("a").alias("doc_id"), "near"), "doc_id", "left")
    placed = placed.select(
        "key", "doc_id", F.coalesce("near.centre", "doc_id").alias("centre"), F.coalesce("near.far", F.lit(0.0)).alias("far")
    )
    placed = _with_component(placed, "centre", _followed(centred.select(F.col("a").alias("node"), F.col("near.centre").alias("component"))))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    placed = written(placed.join(split.select("key"), "key"), "hyperminhash-placed")
    radii = placed.groupBy("centre").agg(F.max("far").alias("radius")).join(sets.select(F.col("doc_id").alias("centre"), "n"), "centre")
    there = placed.select("key", "centre", "component").distinct().join(radii, "centre")
    there = written(there.groupBy("key", "centre", "component").agg(F.max("radius").alias("radius"), F.max("n").alias("n")), "hyperminhash-centres")
    likely = written(_near_centres(there, sets), "hyperminhash-pairs")
    compared = written(_compared(likely, texts), "hyperminhash-compared")
    edges = edges.unionByName(compared.filter(_links()).select("a", "b"))

    # members of centres that may still hide a link
    limit = 1 - NUMERATOR / DENOMINATOR + 1e-9
    apart = compared.filter(~_links()).select("a", "b", _distance().alias("distance")).join(likely, ["a", "b"])
    apart = written(apart.filter((F.col("distance") <= limit + F.col("slack")) & (F.col("slack") > 0)), "hyperminhash-apart")
    if apart.isEmpty():
        return edges
    apart = written(_apart(apart.select("a", "b", "distance"), components(edges)), "hyperminhash-apart")
    members = placed.select("centre", "doc_id", "far").distinct().join(texts, "doc_id")
    return edges.unionByName(_between(apart, written(members, "hyperminhash-members")))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A document's set has the distinct pairs of neighbouring words, A-Z made lower case; a single word is one
    shingle; without words or text the set is empty and links with nothing. Two documents link when
    ``100 * shared >= 80 * united``, decided on the words of both. ``component_id`` is the smallest
    ``doc_id`` that links lead to, its own included; ``kept`` tells whether it is the document itself. A
    null ``doc_id`` takes no part in links, has a null component and is kept. Rows that repeat a ``doc_id``
    are one node. Other columns are not read; an empty table gives no rows.

    A pair at the threshold shares none of its bands with probability 1e-7, and is left out by its
    estimate with 3e-7; the more alike, the less.
    """
    described = written(_describe(docs), "hyperminhash-described")
    nodes = described.filter("n > 0 AND doc_id IS NOT NULL")
    edges = linked_sets(docs, written(_standing(nodes), "hyperminhash-standing"))
    same = written(_same_set(nodes), "hyperminhash-same")
    # a document whose rows have different sets ties these together
    torn = same.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    ties = same.join(torn, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    linked = components(edges.unionByName(ties))
    found = _with_component(same.withColumnRenamed("rep", "node"), "node", linked.select("node", "component"))
    found = found.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    plain = described.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return plain.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
