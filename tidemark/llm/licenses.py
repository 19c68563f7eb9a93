"""License scans in DataFrame expressions only: keyword gates, ordered rules, containment.

Nothing is sent between tasks: every step is an expression over the row. A document without any gate
word never meets a regular expression of a rule, and a rule is tried only where its own keyword stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_rules import CONFIDENCE, GATES, HINT, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"


def words_text(text: Column) -> Column:
    """The words of a text, each with a blank before it; a blank can be nowhere else."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), F.rtrim(F.regexp_replace(plain, BETWEEN_WORDS, " "))), "^ +", " ")


def word_count(words: Column) -> Column:
    """Words in a text or slice of :func:`words_text`: its blanks, but for an empty text."""
    blanks = F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == " ", 0).otherwise(blanks).cast("long")


def _rule_array(found: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"),
                F.lit(f" ({r.pattern})(?= |$)").alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.base).alias("base"),
            )
            for r in found
        ]
    )


def _places(words: Column, rule: Column) -> Column:
    """Start, stop, priority, label and base of every match of a rule, counted in words."""
    lengths = F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), word_count)
    marked = F.split(F.regexp_replace(words, rule["pattern"], F.lit(f" {MARK}$1")), " ", -1)
    numbered = F.transform(marked, lambda word, at: F.when(word.startswith(MARK), at - 1))
    starts = F.filter(numbered, lambda at: at.isNotNull())
    return F.zip_with(
        starts, lengths,
        lambda start, n: F.struct(
            start.cast("long").alias("start"), (-(start + n)).cast("long").alias("minus_stop"),
            rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base"),
        ),
    )


def _resolve(places: Column) -> Column:
    """Walk the matches by start, longest first, and drop those that lie in one of no lower priority.

    The state has, for each priority, how far matches of that priority or a higher one reach. All
    matches that could contain a later one have been seen by then, so one comparison decides. A dropped
    match still reaches as far as the one it lies in.
    """
    levels = HINT + 1
    none = F.array().cast("array<string>")
    start = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), levels).alias("reach"), none.alias("labels"), none.alias("base_labels"),
        F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
        F.lit(0.0).alias("score"),
    )
    confidence = F.array(*[F.lit(c) for c in CONFIDENCE])

    def step(state: Column, place: Column) -> Column:
        stop = -place["minus_stop"]
        kept = place["base"] | (F.element_at(state["reach"], place["priority"] + 1) < stop)
        one = F.array(place["label"])
        reach = F.transform(state["reach"], lambda r, level: F.when(level >= place["priority"], F.greatest(r, stop)).otherwise(r))
        return F.struct(
            reach.alias("reach"),
            F.when(kept, F.array_union(state["labels"], one)).otherwise(state["labels"]).alias("labels"),
            F.when(place["base"], F.array_union(state["base_labels"], one)).otherwise(state["base_labels"]).alias("base_labels"),
            (state["n_base"] + place["base"].cast("long")).alias("n_base"),
            F.when(place["base"], F.least(state["first"], place["start"])).otherwise(state["first"]).alias("first"),
            F.when(place["base"], F.greatest(state["last"], place["start"])).otherwise(state["last"]).alias("last"),
            F.when(kept, F.greatest(state["score"], F.element_at(confidence, place["priority"] + 1))).otherwise(state["score"]).alias("score"),
        )

    return F.aggregate(F.array_sort(places), start, step)


def scan_licenses(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """Licences named in the whole text of every row.

    Result: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. Words are
    runs of digits, ASCII letters and characters beyond ASCII, after A-Z are made lower case. The base
    columns count all places of the phrases in ``license_rules.BASE``. ``labels`` has these and the
    labels of the rules whose matches are not contained in a match of the same or a higher priority.
    ``score`` is the highest confidence of a match that stays, 0 without one. A null text counts as
    empty; repeated rows give repeated results; other columns are not read.
    """
    array = _rule_array(found or rules())
    words = words_text(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    gate = reduce(Column.__or__, [F.contains(F.col("words"), F.lit(word)) for word in GATES])
    tried = F.filter(array, lambda rule: F.contains(F.col("words"), rule["keyword"]))
    places = F.flatten(F.transform(tried, lambda rule: _places(F.col("words"), rule)))
    scanned = rows.select("doc_id", word_count(F.col("words")).alias("n_words"), F.when(gate, _resolve(places)).alias("found"))
    text = lambda column: F.coalesce(F.array_join(F.array_sort(column), ","), F.lit(""))
    return scanned.select(
        "doc_id", "n_words", F.coalesce("found.n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("found.first").alias("first_word"), F.col("found.last").alias("last_word"),
        text(F.col("found.base_labels")).alias("base_labels"), text(F.col("found.labels")).alias("labels"),
        F.coalesce("found.score", F.lit(0.0)).alias("score"),
    )
