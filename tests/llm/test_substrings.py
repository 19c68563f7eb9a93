"""Substring dedup against brute force."""

import random
import re

import numpy as np

from tidemark.llm import substrings

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            content = tuple(words[at : at + window])
            if content in seen:
                gone[at : at + window] = [True] * window
            seen.add(content)
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def result(spark, rows, window):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted((tuple(r) for r in substrings.remove_repeats(df, window).collect()), key=repr)


def documents(seed, count, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 70))] for _ in range(6)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            words += rng.choice(passages) if rng.random() < 0.5 else []
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rng.shuffle(rows)
    return rows


def test_random_documents(spark):
    rows = documents(1, 150, [f"w{i}" for i in range(400)])
    assert result(spark, rows, 20) == brute(rows, 20)
    # few words: windows repeat within documents and minimisers are shared
    rows = documents(2, 60, ["a", "b", "é\x00"])
    assert result(spark, rows, 5) == brute(rows, 5)


def test_batches_smaller_than_the_copies(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 500)
    rows = documents(3, 80, [f"w{i}" for i in range(50)]) + [(1000 + i, "same " * 30 + "text") for i in range(40)]
    assert result(spark, rows, 20) == brute(rows, 20)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "x " * 19), (6, "x " * 20), (7, "x " * 45), (9, long), (8, long), (None, "x " * 30), (1, "\x1f\xa0 " * 25)]
    assert result(spark, rows, 20) == brute(rows, 20)
    twice = [(1, "x y z " * 10), (1, "x y z " * 10)]
    assert sorted(r[2] for r in result(spark, twice, 20)) == sorted((brute(twice, 20)[0][2], brute(twice, 20)[1][2]))


def test_empty_table_and_extra_columns(spark):
    assert result(spark, [], 20) == []
    docs = spark.createDataFrame([(1, "a b", 3, 4)], SCHEMA + ", batch int, payload int")
    assert [tuple(r) for r in substrings.remove_repeats(docs).collect()] == [(1, 2, 0, "a b")]


def test_equal_hashes_are_told_apart_by_their_text(monkeypatch):
    # every window has the same hash; only the words decide
    monkeypatch.setattr(substrings, "_combined", lambda hashes, size: np.zeros(max(0, len(hashes) - size + 1), np.uint64))
    block = substrings.pack(np.array([1, 2, 3], "<i8"), np.array([0, 0, 0], "<i8"), np.array([0, 1, 2], "<i4"), np.array([1, 1, 1], "<i4"), np.frombuffer(b"a b c d a b", np.uint8))
    ((batch, verdict),) = substrings._verdict([(9, block)], 2)
    numbers, bits = substrings.unpack(verdict, "<i4", "u1")
    assert batch == 9 and numbers.tolist() == [2] and np.unpackbits(bits, count=1).tolist() == [0]
