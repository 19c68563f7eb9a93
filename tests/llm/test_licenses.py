"""License scans against brute force, and the rules."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses
from tidemark.llm.common import table
from tidemark.llm.license_rules import BASE, GATES, rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(text):
    words = words_of(text)
    places = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    first, last = (f((i for i, _ in places), default=None) for f in (min, max))
    return (len(words), len(places), first, last, ",".join(sorted({label for _, label in places})))


def brute_labels(text):
    """All matches of all rules, without gates, resolved pair by pair."""
    joined = "".join(" " + w for w in words_of(text))
    found = []
    for order, rule in enumerate(rules()):
        for m in re.finditer(f" ({rule.pattern})(?= |$)", joined):
            start = joined[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), rule.priority, rule.label, rule.base))

    def beaten(a):
        return any(
            b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[2] < a[2] or (b[2] == a[2] and b[3:] < a[3:]))
            for b in found
        )

    return ",".join(sorted({a[3] for a in found if a[4] or not beaten(a)}))


TEXTS = [
    None, "", "  ", "MIT License, mit license; MIT   LICENSE", "x mit licensee mit license", "1mit license", "Ж mit license Ж",
    "Licensed under the GNU Lesser General Public License, version 2.1 or later.", "\x01mit license\x01", "mit license " * 3000,
    "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3. See apache license version 2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "the bsd 3-clause license and bsd license",
    "mozilla public license 2.0 eclipse public license 2.0 isc license zlib license", "general public general public license",
]


def test_scans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, words int")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert r.labels == brute_labels(text), text
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])


def test_every_rule_passes_its_gates():
    assert len(rules()) > 200
    for rule in rules():
        assert any(gate in rule.keyword or gate in rule.pattern for gate in GATES), rule
        assert re.compile(rule.pattern)


@pytest.mark.parametrize("phrase", [phrase for _, phrase in BASE])
def test_base_phrases_pass_a_gate(phrase):
    assert any(gate in phrase for gate in GATES)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in licenses.scan_licenses(docs).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert licenses.scan_licenses(docs.filter(F.lit(False))).collect() == []
