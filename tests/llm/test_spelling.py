"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    """Near words of each word, by a table of every word with one place left open."""
    open_at = {}
    for w in words:
        for i in range(len(w)):
            open_at.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= open_at[w[:i], w[i + 1 :]] - {w}
            if w[:i] + w[i + 1 :] in near:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    return near


def brute(rows):
    words = brute_words(rows)
    near, form = neighbours(words), {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    got = spelling.group_variants(df)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("letters", ["ab", "abcdéàÿ÷"])
def test_many_near_words_with_chains(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling, "LONGEST", 12)
    rng = random.Random(len(letters))
    rows = []
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 17))) for _ in range(40)]
    for at in range(400):
        word = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word))
            word[i : i + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
        rows.append((at, " ".join(["".join(word)] * rng.choice((1, 5, 6, 30, 200)))))
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows) and any(r[2] != r[1] for r in got if r[1]) and any(r[4] > 3 for r in got)


def test_every_pair_meets_once(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(900)}
    words |= {"x" * n + y + "z" * m for n in (20, 21, 25) for m in (18, 19, 20, 21) for y in ("", "q", "x", "z")}
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    met = [tuple(sorted((r.a, r.b))) for r in pairs]
    assert len(met) == len(set(met))
    assert set(met) == {tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b)}


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v", "w3")]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == dict.fromkeys([f"w{i}" for i in range(20)] + ["v"], "w20")


def test_odd_rows(spark):
    word = "abcdefgh"
    rows = [(1, None), (2, ""), (3, " \n"), (None, f"{word} " * 5), (4, "ÉCOLES École École École Écoles " * 3), (4, "écoles " * 9), (4, "écoles " * 9),
            (5, "l" * 50_000 + " "), *[(10 + i, "l" * 60_000) for i in range(6)], *[(20 + i, "l" * 59_999 + "m") for i in range(40)], (6, "short " * 100)]
    df = spark.createDataFrame(rows, SCHEMA + "").repartition(3)
    assert result(df) == brute(rows)


def test_damage_is_judged_on_the_text_as_it_is(spark):
    """A run that damage makes of another one counts as it is, even where the text has it as a run to be damaged."""
    cascades = [(1, "leiikfkh", "leikfkh", "leikkh"), (2, "ajiljhab", "ajljhab", "aljhab")]
    for doc_id, run, once, twice in cascades:
        text = f"{run} {once} " * 6
        assert spelling.damaged_words(doc_id, text) == {once: 6, twice: 6}
        assert spelling.damaged_words(doc_id, f"{once} {run} " * 6) == {once: 6, twice: 6}
    rows = [(doc_id, f"{run} {once} " * 6) for doc_id, run, once, _ in cascades]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "letters " * 30, "w", 1), (2, "lettres letter " * 5, "w", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", word string, n int")
    assert result(df) == brute([r[:2] for r in rows])


def test_keys_of_a_neighbourhood_are_distinct():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(50)]
    for symbols in (3, 7):
        keys, _, places = spelling.neighbour_keys(words, symbols)
        for at in range(len(words)):
            own = keys[places == at]
            assert len(own) == len(np.unique(own))
