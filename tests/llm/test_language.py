"""Language identification: held-out accuracy, odd rows, and what may be learned from."""

import zlib

from tidemark.llm import language
from tidemark.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    found = language.identify(docs, language.train(docs)).toPandas().merge(docs.toPandas(), on="doc_id")
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(found.doc_id, found.held_out))
    held = found[found.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.99


def test_unseen_words_fall_back_to_shorter_grams():
    model = language.LanguageModel(["a", "b"], {"known": (1.0, 3.0)}, {"xyz": (2.0, 1.0), "q": (0.5, 4.0)})
    assert model.cost("known") == (1.0, 3.0)
    assert model.cost("wxyzw") == (2.0, 1.0)
    assert model.cost("qq") == (0.5, 4.0)
    assert model.cost("zzz") == (language.PENALTY, language.PENALTY)
    assert model.predict(["known", "xyz 12", None, "", "123 !"])[0] == ["a", "b", "und", "und", "und"]


def test_odd_rows(spark):
    train = [(i, text, lang, 0) for i in range(40) for text, lang in (("the house and the tree", "en"), ("das haus und der baum", "de"))]
    train += [(90, "le chat et la maison", None, 0), (None, "the", "en", 0)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, score int")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "12 34", "de", 0), (4, "the " * 100_000, None, 0), (4, "the " * 100_000, None, 0), (None, "baum", None, 0)]
    found = language.identify(spark.createDataFrame(rows, docs.schema), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")]
    assert all(r.score == 0 for r in found[:3]) and all(0.5 < r.score <= 1 for r in found[3:])
    kept = language.keep_identified(spark.createDataFrame(rows, docs.schema), model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [4, 4, None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == [] and language.identify(docs, model).collect() == []
    one = spark.createDataFrame([(1, "word", "en")], docs.schema)
    assert [tuple(r) for r in language.identify(one, model).collect()] == [(1, False, "und", 0.0)]


def test_sample_is_bounded_and_fixed(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    first, second = (language.train(docs.repartition(n), docs_per_language=20, words_per_language=50, grams_per_language=30) for n in (1, 5))
    assert first.words == second.words and first.grams == second.grams
    assert len(first.words) <= 50 * len(first.languages)
