"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a reduced word and words one edit apart become reduced
words at most one edit apart. Of every reduced word the one-edit neighbourhood is generated: itself, every
symbol replaced, every symbol left out. What an insertion makes is met from the other side, where it is a
deletion; of two words that differ by a replacement the one with the smaller symbol generates the other. So
each pair meets under one key of a join between neighbourhoods and the reduced vocabulary, and is verified on
the words themselves. The number of symbols is chosen by cost: few make short neighbourhoods, many make few
words that only look alike.

Words of more than LONGEST code points have neighbourhoods as long as themselves. They meet under their first
and their last half instead, one of which an edit leaves alone, and are verified the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import tidied, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
DAMAGED = 199
LEAST_LENGTH = 6
LEAST_USES = 5
RATIO = 5
LONGEST = 40
SYMBOLS = range(3, 25)
COUNTED_AT_ONCE = 250_000
KEYS_AT_ONCE = 200_000
U = np.uint64

# kinds of keys: the reduced word, one symbol replaced, one left out, the first or last half of a long word
SAME, REPLACED, LEFT_OUT, FIRST_HALF, LAST_HALF = range(5)


# --- words ---


def damaged_words(doc_id: int | None, text: str) -> Counter:
    """Uses of the words of a text, letters taken out where the hash of id and word says so."""
    runs = Counter(run.translate(LOWER) for run in RUN.findall(text))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # all are taken out before any comes back: what damage makes of a run is not damaged again
    hit = {r: runs.pop(r) for r in list(runs) if zlib.crc32(r.encode(), start) % DAMAGED == 0}
    for run, uses in hit.items():
        at = zlib.crc32(run.encode(), start) % len(run)
        runs[run[:at] + run[at + 1 :]] += uses
    return runs


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, uses in damaged_words(doc_id, text or "").items():
                        if len(word) >= LEAST_LENGTH:
                            counts[word] += uses
                    if len(counts) >= COUNTED_AT_ONCE:
                        yield counted()
                        counts.clear()
        if counts:
            yield counted()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(tidied(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_USES)


# --- neighbourhoods ---


def symbol_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Which of a few symbols a letter is hashed to."""
    mixed = letters.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    return ((mixed >> U(40)) % U(symbols)).astype(np.int64)


_WEIGHTS = np.random.default_rng(12).integers(1, 1 << 63, LONGEST + 1, np.uint64) | U(1)
_LENGTHS = np.random.default_rng(13).integers(1, 1 << 63, LONGEST + 2, np.uint64)


def reduced_keys(words: list[str], symbols: int) -> np.ndarray:
    """A hash of the reduced form of words of one length, at most LONGEST."""
    return _sums(_reduced(words, symbols)).sum(axis=1, dtype=np.uint64) + _LENGTHS[len(words[0])]


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    letters = np.array([list(map(ord, w)) for w in words])
    return symbol_of(letters, symbols)


def _sums(reduced: np.ndarray, shift: int = 0) -> np.ndarray:
    """What each symbol adds to the hash at its place, ``shift`` places to the left."""
    length = reduced.shape[1]
    return (reduced + 1).astype(np.uint64) * _WEIGHTS[np.maximum(np.arange(length) - shift, 0)]


def neighbour_keys(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the one-edit neighbourhoods of words of one length: key, kind, and the word's place.

    Replacements go to larger symbols only. Keys that a word would have twice come once.
    """
    reduced = _reduced(words, symbols)
    count, length = reduced.shape
    sums = _sums(reduced)
    total = sums.sum(axis=1, dtype=np.uint64)
    keys, kinds, places = [total + _LENGTHS[length]], [np.full(count, SAME)], [np.arange(count)]
    for step in range(1, symbols):
        larger = reduced + step < symbols
        row, at = np.nonzero(larger)
        keys.append(total[row] + U(step) * _WEIGHTS[at] + _LENGTHS[length])
        kinds.append(np.full(len(row), REPLACED))
        places.append(row)
    before = np.cumsum(sums, axis=1, dtype=np.uint64) - sums
    moved = _sums(reduced, 1)
    after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    # of a run of equal symbols any one may go: the first stands for all
    first = np.ones(reduced.shape, bool)
    first[:, 1:] = reduced[:, 1:] != reduced[:, :-1]
    row, at = np.nonzero(first)
    keys.append((before + after)[row, at] + _LENGTHS[length - 1])
    kinds.append(np.full(len(row), LEFT_OUT))
    places.append(row)
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(places)


def half_keys(word: str, length: int) -> list[int]:
    """Keys of the first and the last half of a long word that may meet one of ``length`` code points."""
    half, keys = length // 2, []
    for tag, part in (("<", word[:half]), (">", word[len(word) - half :])):
        data = f"{length}{tag}{part}".encode()
        keys.append(zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1]))
    return keys


def choose_symbols(lengths: dict[int, int]) -> int:
    """The number of symbols with the least cost: keys made, and words that meet under them.

    ``lengths`` has the number of words of each length. Letters are not used evenly, so symbols count for
    three quarters.
    """

    def cost(symbols: int) -> float:
        total = 0.0
        for length, words in lengths.items():
            if length <= LONGEST:
                replaced = 1 + length * (symbols - 1) / 2
                room = (0.75 * symbols) ** length
                total += words * (replaced + length)
                total += words * words * replaced / room + words * lengths.get(length - 1, 0) * length / room * 0.75 * symbols
        return total

    return min(SYMBOLS, key=lambda s: (cost(s), s))


def _keys(words: DataFrame, symbols: int, whole: bool) -> DataFrame:
    """``key, kind, word, n``: of whole neighbourhoods, or of the reduced vocabulary."""

    def rows(words_: list[str], uses: np.ndarray, keys: np.ndarray, kinds: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = pa.array(words_, pa.string())
        for at in range(0, len(keys), KEYS_AT_ONCE):
            cut = slice(at, at + KEYS_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[cut].view(np.int64)), pa.array(kinds[cut].astype(np.int8)),
                    held.take(pa.array(places[cut])), pa.array(uses[places[cut]]),
                ],
                ["key", "kind", "word", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[tuple[str, int]]] = {}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                by_length.setdefault(min(len(word), LONGEST + 1), []).append((word, n))
            for length, held in by_length.items():
                for at in range(0, len(held), 2048):
                    part = held[at : at + 2048]
                    texts, uses = [w for w, _ in part], np.array([n for _, n in part], np.int64)
                    if length >= LONGEST if whole else length > LONGEST:
                        # the shorter of two words asks under its own length, the longer is found under both
                        found = [half_keys(w, len(w)) if whole else half_keys(w, len(w)) + half_keys(w, len(w) - 1) for w in texts]
                        keys = np.array(found, np.int64).reshape(-1).view(np.uint64)
                        kinds = np.tile([FIRST_HALF, LAST_HALF], len(keys) // 2)
                        yield from rows(texts, uses, keys, kinds, np.repeat(np.arange(len(texts)), len(found[0])))
                    if length <= LONGEST and whole:
                        yield from rows(texts, uses, *neighbour_keys(texts, symbols))
                    elif length <= LONGEST:
                        yield from rows(texts, uses, reduced_keys(texts, symbols), np.full(len(texts), SAME), np.arange(len(texts)))

    return words.select("word", "n").mapInArrow(tidied(run), "key long, kind byte, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words one edit apart, once, of ``words(word, n)``."""
    lengths = {size: count for size, count in words.groupBy(F.least(F.length("word"), F.lit(LONGEST + 1))).count().collect()}
    symbols = choose_symbols(lengths)
    near = _keys(words, symbols, True).select("key", "kind", F.col("word").alias("a"), F.col("n").alias("n_a"))
    home = _keys(words, symbols, False)
    home = home.select("key", (F.col("kind") >= FIRST_HALF).alias("long"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    size_a, size_b = F.length("a"), F.length("b")
    # what can meet from both sides, or under both halves, counts once
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    half = F.floor(size_a / 2).cast("int")
    once = (
        F.when(F.col("kind") == REPLACED, ~F.col("long") & (size_a == size_b))
        .when(F.col("kind") == LEFT_OUT, ~F.col("long") & (size_b == size_a - 1))
        .when(F.col("kind") == SAME, ~F.col("long") & (size_a == size_b) & ordered)
        .when(F.col("kind") == FIRST_HALF, F.col("long") & ordered)
        .otherwise(F.col("long") & ordered & (F.left("a", half) != F.left("b", half)))
    )
    return near.join(home, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


# --- groups ---


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: forms followed to the last, twice as far a round.

    Counts grow from a word to its form, so there is no cycle and the rounds are few.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if step.filter("next IS NOT NULL").isEmpty():
            return found
        found = step.drop("next")


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word with its more frequent spelling.

    Words are the runs of Latin letters, A-Z made lower case and some of them damaged by the hash of the
    document's id and the run (a null id counts as an empty one), of at least LEAST_LENGTH code points and
    LEAST_USES uses over all documents. Two are near if one inserted, deleted or replaced code point makes
    one the other. ``form`` is the near word with the most uses (of equal ones the first in code-point
    order) if it has RATIO times the uses of the word, else null; ``root`` follows forms to the last.

    Null and empty texts have no words. Repeated rows count again. Other columns are not read; an empty
    table, or one without frequent words, gives no rows. Every pair of near words is found.
    """
    words = written(count_words(docs), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    one = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    other = pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    found = one.unionByName(other).groupBy("word").agg(best.alias("best"), F.count(F.lit(1)).alias("n_near"))
    joined = words.join(found, "word", "left")
    larger = -F.col("best.rank") >= RATIO * F.col("n")
    formed = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(larger, F.col("best.near")).alias("form"), F.when(larger, -F.col("best.rank")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
