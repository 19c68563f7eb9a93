"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F
from test_exact import brute as exact_brute
from test_jaccard import brute as near_brute

import corpus_pipeline
from tidemark.llm import components
from tidemark.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF_DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_language_keeps_what_has_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect() if r.text and re.search(r"[^\W\d_]", r.text)}


def test_exact_copies(stages):
    want = {i for i, _, _, kept, _ in exact_brute([(r.doc_id, r.text) for r in stages[1].collect()]) if kept}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_near_copies(stages):
    want = {i for i, _, group in near_brute([(r.doc_id, r.text) for r in stages[2].collect()]) if group == i}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(want)


def test_benchmark(spark, stages):
    items = [" ".join(r.text.split()) for r in table(spark, SF_DIR, "benchmark").collect()]
    clean = {r.doc_id for r in stages[3].collect() if not any(i in " ".join(r.text.split()) for i in items)}
    assert {r.doc_id for r in stages[4].collect()} == clean


def test_tokens_and_run(spark, stages):
    last = sorted((r.doc_id, r.ids_sha256) for r in stages[-1].collect())
    assert [i for i, _ in last] == sorted(r.doc_id for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == last


def test_odd_rows_pass_all_stages(spark):
    schema = table(spark, SF_DIR, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the text of one", "en", None, 15), (3, "the text of one", "en", None, 15),
            (4, "word " * 100_000, "de", "s", 1), (None, "some other text of its own", "en", "s", 2)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "test-odd")
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 3, 4]
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "test-empty")
    assert docs.count() == 0


def test_clashing_names_pass_all_stages(spark):
    schema = table(spark, SF_DIR, "documents").schema
    rows = [(i, f"the words of text {i % 3} stand here for all to see and to read", "en", "s", 50) for i in range(6)]
    names = ["_kept", "_SHA", "_chars", "_rows", "_found", "_dropped", "__dropped", "row", "host", "n", "words", "text_sha256", "a.b"]
    docs = spark.createDataFrame(rows, schema).withColumns({name: F.lit(7) for name in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, written(stage(spark, docs, SF_DIR), "test-clash")
        assert docs.columns == before
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 100)] + [(500, 500 + i) for i in range(1, 200)]
    found = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, **{500 + i: 500 for i in range(200)}}
    assert len(found) == 264
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
