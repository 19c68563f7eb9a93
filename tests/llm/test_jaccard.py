"""Groups by Jaccard similarity against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, out = {}, []
    for doc_id, text in rows:
        words = (text or "").translate(lower).replace("\t", " ").replace("\n", " ").split()
        found = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
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
    return sorted(((d, n, root(d) if d is not None else None) for d, n in out), key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard.near_groups(df).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_small_and_large_sets_with_chains(spark):
    rng = random.Random(7)
    rows = []
    for length in (1, 3, 4, 5, 6, 9, 12, 14, 16, 18, 21, 25, 30, 34, 60, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(5):
            rows.append(" ".join(base))
            rows.append(" ".join(edited(rng, base, 1)))
            # a chain: each text an edit of the one before
            base = base + [f"t{rng.randrange(10**6)}"] if rng.random() < 0.6 else edited(rng, base, 1)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(spark, rows) == brute(rows)


def test_shared_passage_does_not_link_but_hides_nothing(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((4, 10, 14, 16, 40)))]
        rows.append(" ".join(own + passage))
        if i % 4 == 0:
            rows.append(" ".join(edited(rng, own, 1) + passage))
    rows = list(enumerate(rows))
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE Two"), (None, "one two"), (6, "a b c d e f g"),
            (6, "a b c d e f g"), (7, "a b c d e f g"), (8, "É b c d e"), (9, "é b c d e"), (10, "x " * 5000), (11, "x " * 9000)]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_groups(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], SCHEMA + ", n long").withColumn("component", F.lit(0))
    assert [tuple(r) for r in jaccard.near_groups(docs).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_light_keys_cover_every_link():
    for a in range(1, 25):
        for b in range(a, min(24, a * 5 // 4) + 1):
            size = jaccard.needed_overlap(a, b)
            assert size in jaccard.subset_sizes(a, 24) and size in jaccard.subset_sizes(b, 24)


@pytest.mark.parametrize("sizes", [{}, {5: 100}, {n: 10 for n in range(1, 25)}, {24: 1000, 500: 10}])
def test_boundary_is_in_range(sizes):
    assert 0 <= jaccard.choose_boundary(sizes) <= jaccard.LIGHT_AT_MOST
