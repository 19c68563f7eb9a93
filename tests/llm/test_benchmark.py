"""Benchmark decontamination: verbatim, re-parameterised and clean documents."""

import random

from tidemark.llm import benchmark
from tidemark.llm.common import table

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
QUESTION = (
    "Anna has 12 apples and gives 5 apples to Boris. Later Anna buys 30 kg of pears for 12 dollars at the market "
    "in town. How many apples does Anna have after the trip to the market?"
)


def filler(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def found(spark, docs, items=((1, QUESTION),)):
    rows = benchmark.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(items), ITEMS)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_verbatim_and_reparameterised(spark):
    other = QUESTION.replace("Anna", "Clara").replace("Boris", "David").replace("12", "1,450").replace("30 kg", "7 lb")
    mixed = QUESTION.replace("12 apples", "3 apples")  # 12 dollars stay: 12 stands for two values
    rows = found(spark, [
        (1, filler(1) + ". " + QUESTION + " " + filler(2)), (2, filler(3) + ".\n" + QUESTION.upper() + filler(4)),
        (3, filler(5) + ". " + other + " " + filler(6)), (4, filler(7)), (5, mixed + filler(8)),
        (6, " ".join(QUESTION.split()[:12]) + filler(9)),
    ])
    assert rows[1, 1].verbatim and rows[1, 1].coverage == 1.0
    assert not rows[3, 1].verbatim and rows[3, 1].consistency == 1.0
    assert (4, 1) not in rows and (6, 1) not in rows
    if (5, 1) in rows:
        assert rows[5, 1].consistency < 1.0


def test_inconsistent_slots_are_no_copy(spark):
    item = "take 1 cup and then add 1 cup to 1 pot while 1 pan and 1 lid heat on 1 stove for 1 hour in 1 room"
    values = iter(range(100, 200))
    random_ = " ".join(str(next(values)) if w == "1" else w for w in item.split())
    one = " ".join("7" if w == "1" else w for w in item.split())
    rows = found(spark, [(1, item), (2, one), (3, random_)], [(9, item)])
    assert set(rows) == {(1, 9), (2, 9)}


def test_given_tables(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    texts = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in " ".join((r.text or "").split())}
    got = {(r.doc_id, r.item_id) for r in benchmark.contaminated(docs, items).collect()}
    assert whole and whole <= got
    kept = benchmark.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_words_and_template_have_one_length(spark):
    from pyspark.sql import functions as F

    texts = ["He paid 1,234.50 dollars, and Anna went 5 km.", "", "The Cat. A Dog and Bird, Über alles 3 m", "1 2 3", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(benchmark.marked_words(F.col("text")).alias("w"))
    for w, t in df.select("w", benchmark.template(F.col("w"))).collect():
        assert len(w.split(" ")) == len(t.split(" "))
    assert df.select(benchmark.template(F.col("w"))).first()[0] == "he paid #n #u and #p went #n #u"


def test_odd_rows(spark):
    text = filler(11, 30)
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, text + " " + filler(12, 20_000)), (5, "a b c")]
    items = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "a b c"), (5, "1 2 3 4 5 6 7 8")]
    rows = found(spark, docs, items)
    assert set(rows) == {(3, 1), (None, 1), (4, 1)}
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}
    clash = spark.createDataFrame([(1, text, 5, 6, 7)], DOCS + ", item_id long, window int, place int")
    kept = benchmark.drop_contaminated(clash, spark.createDataFrame([(1, "other words that are not there at all", 1)], ITEMS + ", doc_id int"))
    assert [tuple(r) for r in kept.collect()] == [(1, text, 5, 6, 7)]


def test_a_copy_is_found_beside_inconsistent_text(spark):
    item = "take 1 cup and then add 1 cup to 1 pot while 1 pan and 1 lid heat on 1 stove for 1 hour in 1 room"
    values = iter(range(100, 200))
    random_ = " ".join(str(next(values)) if w == "1" else w for w in item.split())
    longer = item.replace("1", "7").replace("while", "while all the time")  # two alignments
    docs = [
        (1, f"{item} {random_}"), (2, f"{random_} {filler(21, 9)} {longer} {filler(22, 30)} {random_}"),
        (3, f"{random_} {filler(23, 9)} {random_}"), (4, random_), (4, item), (None, random_), (None, item),
    ]
    rows = found(spark, docs, [(9, item)])
    assert set(rows) == {(1, 9), (2, 9), (4, 9), (None, 9)}
    assert all(rows[d, 9].verbatim and rows[d, 9].consistency == 1.0 for d in (1, 4, None))
    assert rows[2, 9].consistency == 1.0 and not rows[2, 9].verbatim


def test_case_and_white_space_do_not_hide_a_copy(spark):
    names = "In which year did the Treaty of Westphalia between France and Sweden end the Thirty Years War in Europe"
    forms = [names.lower(), names.upper(), names.replace(" ", "  "), names.replace(" ", "\n"), names.replace(" ", " "), QUESTION.upper(), QUESTION.lower()]
    forms.append(names.replace("Westphalia", "Utrecht").replace(" ", " \t"))  # other values, other blanks
    rows = found(spark, [(i, f"{filler(30 + i)}.\n{t} {filler(40 + i)}") for i, t in enumerate(forms)], [(1, names), (2, QUESTION), (3, names.lower())])
    assert {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 1)} <= set(rows)
    assert {(i, 3) for i in range(5)} <= set(rows)
    assert all(rows[i, 1].verbatim and rows[i, 1].coverage == 1.0 for i in range(5)) and not rows[7, 1].verbatim


def test_short_items_and_items_of_placeholders(spark):
    items = [(1, "What is 17 + 25?"), (2, "1 2 3 4 5 6 7 8"), (3, "Then Anna, Boris, Clara, David, Emil"), (4, "42"), (5, " ?! "), (6, "")]
    texts = ["what is 17 25", "he said 1, 2, 3, 4, 5, 6, 7, 8 and", "THEN ANNA BORIS CLARA DAVID EMIL", "it is 42", "8 7 6 5 4 3 2 1", "", "?!", "what was 17"]
    docs = spark.createDataFrame([(i, f"{filler(50 + i)} {t} {filler(60 + i)}" if len(t) > 2 else t) for i, t in enumerate(texts)], DOCS)
    asked = spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in benchmark.contaminated(docs, asked, short=True).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert {r.doc_id for r in benchmark.drop_contaminated(docs, asked).collect()} == {4, 5, 6, 7}
