"""Exact copies against brute force; the directory by itself."""

import hashlib

import numpy as np

from tidemark.llm import exact

SCHEMA = "doc_id long, text string"


def brute(rows):
    plain = [(i, t or "", (t or "").translate({ord(c): None for c in exact.SPACE})) for i, t in rows]
    groups = {}
    for i, text, norm in plain:
        groups.setdefault(norm, []).append((-len(text), i is None, i))
    out = []
    for i, text, norm in plain:
        best = min(groups[norm])
        out.append((i, best[2], len(groups[norm]), i == best[2] and len(text) == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    rows = [(i, f"text {i % 37} of\tmany") for i in range(200)]
    rows += [(300, "a b"), (301, "ab "), (302, " a  b "), (303, "a b"), (304, None), (305, ""), (306, " \n"), (307, "ab "), (307, "ab ")]
    rows += [(400, "x" * 200_000), (401, "x " * 200_000), (None, "ab"), (None, None)]
    for capacity in (exact.BUCKET_BYTES, 64):
        found = exact.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity).collect()
        assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(empty).collect() == []
    docs = spark.createDataFrame([(2, "a", "x"), (1, "a ", "y"), (1, "a ", "y"), (3, "b", "z")], SCHEMA + ", sha string")
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a ", "y"), (3, "b", "z")]


def test_directory_splits_only_overfull_buckets():
    loads = np.array([1, 1, 1, 1, 40, 1, 30, 30.0])
    found = exact.directory(loads, 50)
    held = np.bincount(found, weights=loads.reshape(len(found), -1).sum(axis=1))
    assert (held <= 50).all() and len(set(found[: len(found) // 2])) == 1
    assert len(exact.directory(loads, 1000)) == 1
    # one slot alone may stay overfull: its key cannot be split
    assert len(set(exact.directory(np.array([100.0, 0, 0, 0]), 10))) == 3


def test_null_and_repeated_ids_bring_no_copies_back(spark):
    rows = [
        (None, "only here"), (None, "a b"), (1, "a b"), (None, "twice"), (None, "twice"), (2, "c  d"), (2, "c d"), (2, "e"), (3, "e "),
        (None, None), (4, "über\tall\x0b"), (4, "f"), (4, "f"), (5, "überall"),
    ]
    kept = exact.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(None, "only here"), (1, "a b"), (None, "twice"), (2, "c  d"), (3, "e "), (None, None), (4, "über\tall\x0b"), (4, "f")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))
