"""LM scoring: gradients, learning on held-out text, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pseudo_likelihood as pl
from tidemark.llm.common import most_frequent, table

SCHEMA = "doc_id long, text string"


def test_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    network = pl.Network.fresh(np.ones(pl.CLASSES))
    context = rng.integers(0, 40, (64, 2 * pl.SIDE)).astype(np.int32)
    target = rng.integers(0, 5, 64).astype(np.int32)
    losses = []
    for _ in range(200):
        losses.append(-network.log_probabilities(context, target).mean())
        network.step(context, target, 0.5)
    assert losses[-1] < 0.5 * losses[0]
    # the output layer's step against a numerical derivative
    again = pl.Network(network.values())
    before = network.parts[2].copy()
    network.step(context, target, 1e-2)
    moved = (before - network.parts[2]) / 1e-2
    up, down = pl.Network(again.values()), pl.Network(again.values())
    up.parts[2][3, 2] += 1e-2
    down.parts[2][3, 2] -= 1e-2
    slope = (down.log_probabilities(context, target).mean() - up.log_probabilities(context, target).mean()) / 2e-2
    assert abs(slope - moved[3, 2]) < 2e-3


def test_probabilities_sum_to_one_over_classes():
    network = pl.Network.fresh(np.arange(pl.CLASSES))
    context = np.zeros((pl.CLASSES, 2 * pl.SIDE), np.int32)
    assert abs(np.exp(network.log_probabilities(context, np.arange(pl.CLASSES))).sum() - 1) < 1e-4


def test_context_stays_inside_a_text():
    found = pl._contexts(np.array([1, 2, 3, 4, 5]), np.array([2, 0, 3]))
    p = pl.PAD
    assert found.tolist() == [[p, p, 2, p], [p, 1, p, p], [p, p, 4, 5], [p, 3, 5, p], [3, 4, p, p]]
    assert pl._examples(["a b c", None, "", "d"], 1, 16) == [pl.OUTSIDE, "a", "b", "c", pl.OUTSIDE, pl.OUTSIDE, pl.OUTSIDE, "d", pl.OUTSIDE, pl.OUTSIDE]


def test_the_rounds_train_on_every_position():
    counts = np.array([0, 1, 2, 17, 0, 50, 3])
    met = [pl._places_of(counts, turn * pl.STRIDE // pl.ROUNDS, pl.STRIDE) for turn in range(pl.ROUNDS)]
    assert set(np.concatenate(met).tolist()) == set(range(counts.sum()))


def test_windows_equal_those_cut_from_the_words():
    rng = random.Random(4)
    texts = [None, "", "a", *(" ".join(rng.choice("bcdefg") for _ in range(rng.randrange(1, 30))) for _ in range(20))]
    split = [pl.words_of(t) for t in texts]
    counts = np.array([len(f) for f in split])
    symbols = np.array([ord(w) for f in split for w in f])
    for offset, stride in ((0, 1), (0, 2), (1, 2), (8, 16)):
        place = pl._places_of(counts, offset, stride)
        plain = np.array([pl.PAD if w == pl.OUTSIDE else ord(w) for w in pl._examples(texts, offset, stride)]).reshape(-1, 2 * pl.SIDE + 1)
        assert symbols[place].tolist() == plain[:, pl.SIDE].tolist()
        assert pl._contexts(symbols, counts, place).tolist() == np.delete(plain, pl.SIDE, axis=1).tolist()


def test_training_helps_on_documents_it_has_not_seen(spark):
    rng = random.Random(2)
    pairs = [(f"l{i}", f"m{i}", f"r{i}") for i in range(20)]
    texts = [" ".join(w for _ in range(60) for w in rng.choice(pairs)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2)
    seen, unseen = docs.filter("doc_id < 250"), docs.filter("doc_id >= 250")
    vocabulary = pl.read_vocabulary(seen)
    trained, plain = pl.train(seen, vocabulary, rounds=3, stride=1, examples=64), pl.Network.fresh(vocabulary.uses)
    after, before = (pl.score_documents(unseen, vocabulary, n).agg(F.avg("mean_log_likelihood")).first()[0] for n in (trained, plain))
    assert after > before + 0.3
    shuffled = unseen.select("doc_id", F.array_join(F.shuffle(F.split("text", " ")), " ").alias("text"))
    assert pl.score_documents(shuffled, vocabulary, trained).agg(F.avg("mean_log_likelihood")).first()[0] < after - 0.3


def test_scores_equal_a_plain_sum(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    vocabulary = pl.read_vocabulary(docs)
    network = pl.train(docs, vocabulary, rounds=1)
    row = docs.orderBy("doc_id").first()
    words = pl.words_of(row.text)
    places = vocabulary.places(words)
    symbols = [pl.PAD] * pl.SIDE + vocabulary.inputs[places].tolist() + [pl.PAD] * pl.SIDE
    total = 0.0
    for i, place in enumerate(places):
        around = symbols[i : i + pl.SIDE] + symbols[i + pl.SIDE + 1 : i + 2 * pl.SIDE + 1]
        total += network.log_probabilities(np.array([around]), vocabulary.classes[[place]])[0] + vocabulary.inner[place]
    found = pl.score_documents(docs, vocabulary, network).filter(F.col("doc_id") == row.doc_id).first()
    assert found.n_tokens == len(words) and abs(found.log_likelihood - total) < 1e-3 * abs(total)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "one", 0), (4, "one", 0), (None, "a " * 100_000, 0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_tokens int")
    vocabulary = pl.read_vocabulary(docs)
    found = pl.score_documents(docs, vocabulary, pl.train(docs, vocabulary)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 100_000), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert all((r.mean_log_likelihood is None and r.log_likelihood == 0) == (r.n_tokens == 0) for r in found)
    empty = docs.limit(0)
    vocabulary = pl.read_vocabulary(empty)
    assert pl.score_documents(empty, vocabulary, pl.train(empty, vocabulary)).collect() == []


def test_most_frequent_is_bounded_and_whole(spark):
    counted = spark.createDataFrame([(f"w{i}", 1 + i % 50) for i in range(1000)], "word string, n long")
    for at_most in (0, 10, 100, 999, 1000, 5000):
        found = most_frequent(counted, at_most, "n").collect()
        assert len(found) <= at_most
        if found:
            least = min(r.n for r in found)
            assert len(found) == counted.filter(F.col("n") >= least).count()
