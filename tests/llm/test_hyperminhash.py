"""Near copies of word pairs against brute force over all pairs, and sketches against true similarities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hyperminhash

SCHEMA = "doc_id long, text string"


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, out = {}, []
    for doc_id, text in rows:
        words = (text or "").translate(lower).replace("\t", " ").replace("\n", " ").split()
        found = {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} - {()}
        sets.setdefault(doc_id, []).append(found)
        out.append((doc_id, len(found)))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((d, n, root(d) if d is not None else None, d is None or root(d) == d) for d, n in out), key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in hyperminhash.near_copies(df).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_small_and_large_sets_with_chains(spark):
    rng = random.Random(7)
    rows = []
    for length in (1, 2, 3, 5, 6, 7, 9, 12, 16, 21, 30, 60, 120, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(6):
            rows.append(" ".join(base))
            rows.append(" ".join(edited(rng, base, max(1, length // 25))))
            base = base + [f"t{rng.randrange(10**6)}"] if rng.random() < 0.6 else edited(rng, base, max(1, length // 20))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(spark, rows) == brute(rows)


def test_families_that_are_half_alike(spark, monkeypatch):
    """Two families with much in common: members are told apart by their centres, not pair by pair."""
    rng = random.Random(8)
    seen = []
    whole = hyperminhash._compared
    monkeypatch.setattr(hyperminhash, "_compared", lambda pairs, texts: seen.append(pairs.count()) or whole(pairs, texts))
    common = [f"c{i}" for i in range(45)]
    families = [common + [f"{x}{i}" for i in range(15)] for x in "ab"]
    rows = list(enumerate(" ".join(edited(rng, families[i % 2], 1)) for i in range(400)))
    got = result(spark, rows)
    assert got == brute(rows) and len({r[2] for r in got}) == 2
    assert sum(seen) < 2 * len(rows)


def test_bridges_between_centres(spark):
    """Members of two centres that are no copies of each other link to one another."""
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for step in range(14):
            rows.append(" ".join(words))
            for _ in range(3):
                words[rng.randrange(len(words))] = f"s{step}{rng.randrange(10**6)}"
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(spark, rows) == brute(rows)


def test_shared_passage(spark):
    rng = random.Random(10)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((4, 10, 16, 40, 100)))]
        rows.append(" ".join(own + passage))
        if i % 4 == 0:
            rows.append(" ".join(edited(rng, own, 1) + passage))
    rows = list(enumerate(rows))
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one two"), (6, "a b c d e f g"), (14, "one two"),
            (6, "a b c d e f g"), (7, "a b c d e f g"), (8, "É b c d e"), (9, "é b c d e"), (10, "x " * 5000), (11, "x " * 9000),
            (12, "p q r s t u v w"), (12, "other words that tie two sets"), (13, "Other words that tie two sets"), (15, "p q r s t u v w")]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert hyperminhash.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], SCHEMA + ", n long").withColumn("component", F.lit(0))
    assert [tuple(r) for r in hyperminhash.near_copies(docs).orderBy("doc_id").collect()] == [(1, 5, 1, True), (2, 5, 1, False)]


@pytest.mark.parametrize("size,shared", [(30, 0.9), (500, 0.5), (5000, 0.8), (5000, 0.0)])
def test_estimates_are_near_the_truth(size, shared):
    rng = np.random.default_rng(size)
    found = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, int(size * shared), np.uint64)
        sets = [np.unique(np.append(both, rng.integers(0, 1 << 63, size - len(both), np.uint64))) for _ in range(2)]
        truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        sketches = [hyperminhash.registers(s)[None, :] for s in sets]
        got, margin = hyperminhash.estimates(*sketches, *[np.array([len(s)]) for s in sets])
        assert abs(got[0] - truth) <= margin[0]
        found.append(got[0] - truth)
    assert abs(np.mean(found)) < 0.03


def test_chance_of_equal_registers():
    rng = np.random.default_rng(5)
    equal = []
    for _ in range(300):
        a, b = (hyperminhash.registers(rng.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)) for _ in range(2))
        equal.append((a == b).mean())
    chance = hyperminhash.chance_of_equal(np.array([20_000.0]), np.array([20_000.0]))[0]
    assert chance / 2 < np.mean(equal) < chance * 2


def test_alike_sets_meet_in_a_band():
    rng = np.random.default_rng(6)
    for size in (5, 10, 40, 200, 2000):
        for _ in range(200):
            both = rng.integers(0, 1 << 62, size, np.uint64) * np.uint64(4)
            other = np.append(both[: size - max(1, size // 10)], rng.integers(0, 1 << 62, size // 10, np.uint64))
            if len(other) / size >= 0.8:
                keys = [hyperminhash.band_keys(hyperminhash.registers(np.unique(s))) for s in (both, other)]
                assert len(np.intersect1d(*keys)), size
