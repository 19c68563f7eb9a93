"""Language identification, word first with backoff to character n-grams.

A word that any language knows is scored by its log frequency in each language. Any other word falls
back to its longest character n-grams that are known, and so on down to single characters (the method
of Jauhiainen et al., HeLI, 2016). A document gets the mean over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, tidied, unused

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LANGUAGES = 1_000
DOCS_PER_LANGUAGE = 2_000
WORDS_PER_LANGUAGE = 12_000
GRAMS_PER_LANGUAGE = 5_000
LONGEST_GRAM = 5
PENALTY = 7.0
CACHED_WORDS = 80_000
CACHED_COSTS = 1 << 21
COUNTED_AT_ONCE = 150_000
ROWS_AT_ONCE = 256


@dataclass
class LanguageModel:
    """Costs (negative log10 of relative frequency) by word and by n-gram, one per language."""

    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    longest: int = LONGEST_GRAM
    cache: dict[str, int] = field(default_factory=dict)
    costs: np.ndarray | None = None

    def cost(self, word: str) -> tuple[float, ...]:
        if (known := self.words.get(word)) is not None:
            return known
        marked = f" {word} "
        for n in range(min(self.longest, len(marked)), 0, -1):
            found = [c for i in range(len(marked) - n + 1) if (c := self.grams.get(marked[i : i + n])) is not None]
            if found:
                return tuple([sum(column) / len(found) for column in zip(*found)])
        return (PENALTY,) * len(self.languages)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        self._learn(set().union(*found))
        place = self.cache.__getitem__
        labels, scores = [], []
        for words in found:
            if not words:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = self.costs[np.fromiter(map(place, words), np.int64, len(words))].mean(axis=0)
            share = np.exp(-math.log(10) * (mean - mean.min()))
            best = int(mean.argmin())
            labels.append(self.languages[best])
            scores.append(float(share[best] / share.sum()))
        return labels, scores

    def _learn(self, words: set[str]) -> None:
        """Put the costs of ``words`` in the cache, a table of at most CACHED_WORDS rows and CACHED_COSTS costs beside them."""
        fresh = words - self.cache.keys()
        if self.costs is None or len(self.cache) + len(fresh) > len(self.costs):
            fresh = words
            self.cache.clear()
            self.costs = np.empty((max(min(CACHED_WORDS, CACHED_COSTS // len(self.languages)), len(words)), len(self.languages)))
        first = len(self.cache)
        if fresh:
            self.costs[first : first + len(fresh)] = [self.cost(word) for word in fresh]
            self.cache.update(zip(fresh, range(first, first + len(fresh))))


def held_out():
    """Whether a row is kept from training: crc32 of ``doc_id`` as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _top(counts: DataFrame, kept: int) -> list:
    """The ``kept`` most frequent units of each language; ranked in part before anything is sent."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "unit")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept).select("lang", "unit", "n").collect()


def _costs(rows: list, totals: dict[str, int], languages: list[str], key) -> dict[str, tuple[float, ...]]:
    place = {lang: i for i, lang in enumerate(languages)}
    table: dict[str, list[float]] = {}
    for lang, unit, n in rows:
        line = table.setdefault(unit, [PENALTY] * len(languages))
        line[place[lang]] = min(PENALTY, -math.log10(n / totals[lang, key(unit)]))
    return {unit: tuple(line) for unit, line in table.items()}


def train(
    docs: DataFrame,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    words_per_language: int = WORDS_PER_LANGUAGE,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on ``text`` and non-null ``lang`` of rows that are not held out.

    The fit takes ``docs_per_language`` rows of each language, picked by a hash of ``doc_id`` and text,
    and of no more than LANGUAGES languages, the most frequent ones. The model keeps a fixed number of
    words and of n-grams of each length per language.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("place")
    )
    # thin out by hash where the rows are; what is left is a little more than wanted, and is ranked
    labelled = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("labelled"))
    labelled = labelled.orderBy(F.desc("labelled"), "lang").limit(LANGUAGES)
    share = F.pmod("place", F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(F.broadcast(labelled), "lang").filter(share * F.col("labelled") <= F.lit(1.2 * docs_per_language + 50.0))
    first = Window.partitionBy("lang").orderBy("place")
    sample = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= docs_per_language)
    sample = sample.select("lang", "text").repartition(partitions(docs.sparkSession))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    counts[lang, 0, word] += n
                    marked = f" {word} "
                    for size in range(1, LONGEST_GRAM + 1):
                        for i in range(len(marked) - size + 1):
                            counts[lang, size, marked[i : i + size]] += n
            if len(counts) > COUNTED_AT_ONCE:
                yield packed(counts)
                counts.clear()
        yield packed(counts)

    def packed(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "size", "unit", "n"],
        )

    counted = sample.mapInArrow(tidied(count), "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")).cache()
    totals = {(lang, size): n for lang, size, n in counted.groupBy("lang", "size").agg(F.sum("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    words = _top(counted.filter((F.col("size") == 0) & (F.col("n") > 1)), words_per_language)
    grams = [row for size in range(1, LONGEST_GRAM + 1) for row in _top(counted.filter(F.col("size") == size), grams_per_language)]
    counted.unpersist()
    return LanguageModel(languages, _costs(words, totals, languages, lambda unit: 0), _costs(grams, totals, languages, len))


def _slices(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """A few rows at a time with their languages and scores; the cache of costs is the task's own."""
    model = replace(model, cache={}, costs=None)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, *model.predict(part.column("text").to_pylist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text alone.

    ``lang_pred`` is a language of the model, or ``und`` with score 0 if the text is null or has no
    letter (or the model no language). ``score`` is the share of the best language when the mean
    likelihoods of a word are made to sum to one. Ties go to the first language in alphabetical order.
    Repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, labels, scores in _slices(batches, shared.value):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that have a language: not ``und``, and a score of ``min_score`` or more.

    All columns stay and no row is sent to another task. With four languages a score of 0.25 means that
    none fits better than another. A null text has no language; each row is judged by its own text, so
    repeated rows fare alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, labels, scores in _slices(batches, shared.value):
            yield part.filter(pa.array([label != UNKNOWN and score >= min_score for label, score in zip(labels, scores)], pa.bool_()))

    # mapInArrow asks for columns by name and takes a dot for a field
    plain = docs.toDF(*[unused(docs, f"_{i}") if "." in c or "`" in c else c for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)
