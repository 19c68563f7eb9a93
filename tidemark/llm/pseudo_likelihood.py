"""Document scores by masked pseudo-likelihood.

A small network in numpy predicts every word from the words on both sides of it; a document's score is
the sum of the logarithms of those conditional probabilities. The network predicts a word class, and
the word within its class follows its frequency in the corpus.

What is gathered covers all documents: word counts are summed by word, and every task trains a replica
of the network on its part; replicas are averaged by block of parameters, weighted by the words they
have seen, so the driver gets one network however many tasks there are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import most_frequent, partitions, tidied, written

SIDE = 2
KNOWN_WORDS = 16_384
LONGEST_KNOWN = 32
INPUTS, OWN_INPUTS = 1024, 768
CLASSES, OWN_CLASSES = 96, 48
HIDDEN = 24
ROUNDS = 2
# one position in STRIDE of every document is a training example of a round; all are context.
# the rounds start at different positions: as many rounds as the stride train on every position once
STRIDE = ROUNDS
LEARNING_RATE = 0.3
EXAMPLES = 2048
BLOCK = 4096
ROWS_AT_ONCE = 512
COUNTED_AT_ONCE = 300_000
CACHED_ENDINGS = 200_000
ENDING = 3
PAD = INPUTS - 1


# stands for a neighbour beyond the ends of a text; no word has a blank
OUTSIDE = " "


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _ending(word: str) -> int:
    return zlib.crc32(word[-ENDING:].encode())


class _Endings(dict):
    """Ending of a word to its place in the tables, numbered as they come."""

    def __missing__(self, ending: str) -> int:
        self[ending] = place = len(self) + KNOWN_WORDS + 1
        return place


class _Places(dict):
    """Known word to its place in the tables; any other word has the place of its ending."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.endings = _Endings()

    def __missing__(self, word: str) -> int:
        return self.endings[word[-ENDING:]]


class Vocabulary:
    """Input symbol, class and log probability within the class of any word.

    A word that is not known is treated by its last characters, and takes an even share of what the
    unknown words of its class have in the corpus.
    """

    def __init__(self, known: list[tuple[str, int]], uses: np.ndarray, spread: np.ndarray):
        # uses: words of each class in the corpus; spread: different words of a class that are not known
        self.known, self.uses = known, uses.astype(float)
        inside = np.zeros(CLASSES)
        for rank, (word, n) in enumerate(known):
            inside[self.class_of(word, rank)] += n
        self.rest = np.log(np.maximum(self.uses - inside, 1.0) / np.maximum(spread, 1.0) / np.maximum(self.uses, 1.0))
        self._forget()

    def _forget(self) -> None:
        self._places = _Places({word: rank for rank, (word, _) in enumerate(self.known)})
        self._places[OUTSIDE] = KNOWN_WORDS
        self.inputs = np.full(KNOWN_WORDS + 1, PAD, np.int32)
        self.classes = np.zeros(KNOWN_WORDS + 1, np.int32)
        self.inner = np.zeros(KNOWN_WORDS + 1)
        for rank, (word, n) in enumerate(self.known):
            own = rank < OWN_INPUTS
            group = self.class_of(word, rank)
            self.inputs[rank] = rank if own else self._symbol(word)
            self.classes[rank] = group
            self.inner[rank] = math.log(n / max(self.uses[group], n))

    @staticmethod
    def class_of(word: str, rank: int | None) -> int:
        if rank is not None and rank < OWN_CLASSES:
            return rank
        return OWN_CLASSES + _ending(word) % (CLASSES - OWN_CLASSES)

    @staticmethod
    def _symbol(word: str) -> int:
        return OWN_INPUTS + _ending(word) % (PAD - OWN_INPUTS)

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words are in ``inputs``, ``classes`` and ``inner``."""
        if len(self.inputs) > CACHED_ENDINGS:
            self._forget()
        found = np.fromiter(map(self._places.__getitem__, words), np.int64, len(words))
        if fresh := list(self._places.endings)[len(self.inputs) - KNOWN_WORDS - 1 :]:
            groups = [self.class_of(ending, None) for ending in fresh]
            self.inputs = np.append(self.inputs, np.array([self._symbol(e) for e in fresh], np.int32))
            self.classes = np.append(self.classes, np.array(groups, np.int32))
            self.inner = np.append(self.inner, self.rest[groups])
        return found


class Network:
    """Sum of one vector per neighbour and position, tanh, softmax over word classes."""

    shapes = ((2 * SIDE, INPUTS, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, values: np.ndarray):
        self.parts, at = [], 0
        values = values.astype(np.float32)
        for shape in self.shapes:
            size = math.prod(shape)
            self.parts.append(values[at : at + size].reshape(shape).copy())
            at += size

    @classmethod
    def fresh(cls, uses: np.ndarray) -> Network:
        rng = np.random.default_rng(6)
        inputs, hidden, output, bias = (np.zeros(s) for s in cls.shapes)
        inputs = rng.normal(0, 0.1, inputs.shape)
        output = rng.normal(0, 0.1, output.shape)
        bias = np.log((uses + 1.0) / (uses + 1.0).sum())
        return cls(np.concatenate([x.ravel() for x in (inputs, hidden, output, bias)]))

    def values(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        inputs, hidden, _, _ = self.parts
        total = inputs[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += inputs[k].take(context[:, k], axis=0)
        total += hidden
        return np.tanh(total, out=total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        scores = self._hidden(context) @ self.parts[2]
        scores += self.parts[3]
        scores -= scores.max(axis=1, keepdims=True)
        mine = scores[np.arange(len(target)), target].copy()
        return mine - np.log(np.exp(scores, out=scores).sum(axis=1))

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss of the examples."""
        inputs, hidden_bias, output, bias = self.parts
        hidden = self._hidden(context)
        scores = hidden @ output + bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        scores[np.arange(len(target)), target] -= 1.0
        back = (scores @ output.T) * (1.0 - hidden * hidden)
        rate = np.float32(rate)
        scale = rate / np.float32(len(target))
        output -= scale * (hidden.T @ scores)
        bias -= scale * scores.sum(axis=0)
        hidden_bias -= scale * back.sum(axis=0)
        for k in range(2 * SIDE):
            # a vector moves by the mean over its own examples, damped where it has few
            mine = context[:, k].astype(np.int16)  # sorted in linear time
            order = np.argsort(mine, kind="stable")
            mine = mine[order]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            symbols, uses = mine[first], np.diff(np.r_[first, len(mine)])
            sums = np.add.reduceat(back[order], first, axis=0)
            inputs[k][symbols] -= rate * sums / (uses + 8.0).astype(np.float32)[:, None]


def _contexts(symbols: np.ndarray, counts: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """The symbols around every word, or those at ``place``; PAD beyond the ends of its text."""
    stops = np.repeat(np.cumsum(counts), counts)
    starts = stops - np.repeat(counts, counts)
    if place is None:
        place = np.arange(len(symbols))
    else:
        starts, stops = starts[place], stops[place]
    out = np.full((len(place), 2 * SIDE), PAD, np.int32)
    for k, shift in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        there = place + shift
        inside = (there >= starts) & (there < stops)
        out[inside, k] = symbols[there[inside]]
    return out


def _places_of(counts: np.ndarray, offset: int, stride: int) -> np.ndarray:
    """One position in ``stride`` of every text, from ``offset``, where the texts follow each other."""
    first = np.minimum(offset, counts - 1)
    # a text shorter than the offset gives its last word
    found = np.where(counts > 0, -(-(counts - first) // stride), 0)
    nth = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    return np.repeat(np.cumsum(counts) - counts + first, found) + stride * nth


def _examples(texts: list[str | None], offset: int, stride: int) -> list[str]:
    """Windows around one position in ``stride`` of every text, from ``offset``, as words: what ``train`` takes, plainly."""
    edge = [OUTSIDE] * SIDE
    out: list[str] = []
    for text in texts:
        words = words_of(text)
        padded = edge + words + edge
        # a text shorter than the offset gives its last word
        for at in range(min(offset, len(words) - 1), len(words), stride) if words else ():
            out += padded[at : at + 2 * SIDE + 1]
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def read_vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts of all words of all documents; the driver gets at most KNOWN_WORDS words and two sums per class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def packed() -> pa.RecordBatch:
            arrays = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for part in _parts(batches):
            for text in part.column("text").to_pylist():
                counts.update(words_of(text))
            if len(counts) >= COUNTED_AT_ONCE:
                yield packed()
                counts.clear()
        yield packed()

    counted = _texts(docs).mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "word-counts")
    top = most_frequent(counted.filter(F.char_length("word") <= LONGEST_KNOWN), KNOWN_WORDS, "n").collect()
    known = sorted(((row.word, row.n) for row in top), key=lambda entry: (-entry[1], entry[0]))
    ending = F.crc32(F.encode(F.expr(f"right(word, {ENDING})"), "UTF-8")) % F.lit(CLASSES - OWN_CLASSES)
    groups = counted.groupBy(ending.alias("ending")).agg(F.sum("n"), F.count(F.lit(1))).collect()
    uses, spread = np.zeros(CLASSES), np.zeros(CLASSES)
    for group, n, words in groups:
        uses[OWN_CLASSES + group], spread[OWN_CLASSES + group] = n, words
    for rank, (word, n) in enumerate(known):
        shared = Vocabulary.class_of(word, None)
        spread[shared] -= 1
        if rank < OWN_CLASSES:
            uses[shared] -= n
            uses[rank] += n
    return Vocabulary(known, uses, spread)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE, examples: int = EXAMPLES) -> Network:
    """The network after ``rounds`` passes over all documents, averaged over the tasks after each.

    One position in ``stride`` of every document is an example in each pass, ``examples`` make a step.
    """
    spark = docs.sparkSession
    network = Network.fresh(vocabulary.uses)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, network.values()))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            words, values = shared.value
            local, seen, waiting = Network(values), 0, []

            def learn(context: np.ndarray, target: np.ndarray) -> None:
                nonlocal seen
                local.step(context, target, LEARNING_RATE / (1.0 + seen / (400.0 * examples)))
                seen += len(target)

            for part in _parts(batches):
                split = [words_of(t) for t in part.column("text").to_pylist()]
                counts = np.array([len(f) for f in split], np.int64)
                chosen = _places_of(counts, turn * stride // rounds, stride)
                if not len(chosen):
                    continue
                places = words.places(list(chain.from_iterable(split)))
                waiting.append((_contexts(words.inputs[places], counts, chosen), words.classes[places[chosen]]))
                if sum(len(t) for _, t in waiting) >= examples:
                    context, target = (np.concatenate(x) for x in zip(*waiting))
                    # neighbouring examples are alike; mix them
                    order = np.random.default_rng(len(target)).permutation(len(target))
                    for at in range(0, len(order) - examples + 1, examples):
                        learn(context[order[at : at + examples]], target[order[at : at + examples]])
                    rest = order[len(order) // examples * examples :]
                    waiting = [(context[rest], target[rest])]
            if waiting:
                context, target = (np.concatenate(x) for x in zip(*waiting))
                if len(target):
                    learn(context, target)
            result = local.values()
            if seen:
                blocks = [result[at : at + BLOCK].tobytes() for at in range(0, len(result), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.binary())],
                    ["block", "weight", "data"],
                )

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, total, weight = None, None, 0.0

            def packed() -> pa.RecordBatch:
                mean = (total / weight).astype(np.float32).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([mean], pa.binary())], ["block", "data"])

            for batch in batches:
                columns = [batch.column(n) for n in ("block", "weight", "data")]
                for row in range(batch.num_rows):
                    block, w, data = (c[row].as_py() for c in columns)
                    if block != current:
                        if current is not None:
                            yield packed()
                        current, total, weight = block, 0.0, 0.0
                    total = total + w * np.frombuffer(data, np.float32).astype(np.float64)
                    weight += w
            if current is not None:
                yield packed()

        replicas = _texts(docs).mapInArrow(tidied(fit), "block int, weight double, data binary")
        owned = replicas.repartition(partitions(spark), "block").sortWithinPartitions("block")
        mean = owned.mapInArrow(tidied(average), "block int, data binary").collect()
        if mean:
            network = Network(np.concatenate([np.frombuffer(bytes(r.data), np.float32) for r in sorted(mean, key=lambda r: r.block)]))
    return network


def score_documents(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of the whole text of every row.

    Words are runs of characters other than white space, in lower case. Without words, or for a null
    text, the sum is 0 and the mean null. Repeated rows give repeated results; other columns are not
    read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = shared.value
        local = Network(values)
        for part in _parts(batches):
            split = [words_of(t) for t in part.column("text").to_pylist()]
            counts = np.array([len(f) for f in split], np.int64)
            places = words.places(list(chain.from_iterable(split)))
            context, target = _contexts(words.inputs[places], counts), words.classes[places]
            found = words.inner[places]
            for at in range(0, len(target), 8192):
                piece = slice(at, at + 8192)
                found[piece] += local.log_probabilities(context[piece], target[piece])
            total = np.append(0.0, np.cumsum(found))
            stops = np.cumsum(counts)
            sums = total[stops] - total[stops - counts]
            sums[counts == 0] = 0.0
            mean = sums / np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts), pa.array(sums), pa.array(mean, mask=counts == 0)],
                ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
            )

    return _texts(docs).mapInArrow(tidied(run), "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
