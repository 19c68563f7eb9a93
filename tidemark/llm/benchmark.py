"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers, units and names become typed placeholders, so a question keeps its template when its parameters
change. Windows of five template words, and of five words as they are (in lower case), are hash-joined
with those of the benchmark; for the pairs whose
windows cover enough of an item, the words behind the placeholders are compared: an item's value must
stand for one value of the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused, written

WINDOW = 5
COVERED = 0.8
CONSISTENT = 0.8
# alignments that differ by fewer words are one copy with words put in or left out
NEAR = 8
LITERAL_WORDS = 2
# the item side is sent to all tasks up to this many windows (about 40 bytes each)
BROADCAST_WINDOWS = 250_000

NUMBER, NAME, UNIT = "#n", "#p", "#u"
NAME_MARK = "\x02"
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound "
    "pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years hz khz mhz ghz w kw mw kwh v kv a ma c f k pa kpa bar j kj cal kcal b kb mb "
    "gb tb percent degree degrees dollar dollars cent cents euro euros usd eur gbp mph kmh"
).split()


def marked_words(text: Column) -> Column:
    """The words of a text in lower case, joined by single blanks; a name has a mark before it.

    A word is a run of letters and digits; a separator between two digits does not end one. A name is
    a capitalised word that does not begin a sentence. White space of any kind and length is one blank.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\s\p{{Z}}{NAME_MARK}&&[^ ]][\s\p{{Z}}{NAME_MARK}]*| [\s\p{{Z}}{NAME_MARK}]+", " ")
    named = F.regexp_replace(plain, r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu}\p{Ll})", NAME_MARK)
    joined = F.regexp_replace(named, r"(?<=\p{N})[.,:](?=\p{N})", "")
    return F.lower(F.trim(F.regexp_replace(joined, rf"[^\p{{L}}\p{{N}}{NAME_MARK}]+", " ")))


def template(words: Column) -> Column:
    """The words with placeholders for numbers, names and units; word by word."""
    numbers = F.regexp_replace(words, r"(?<![^ ])\p{N}[^ ]*", NUMBER)
    names = F.when(F.contains(numbers, F.lit(NAME_MARK)), F.regexp_replace(numbers, rf"{NAME_MARK}+[^ ]+", NAME)).otherwise(numbers)
    units = F.regexp_replace(names, rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", UNIT)
    return F.when(F.contains(names, F.lit(NUMBER)), units).otherwise(names)


def _split(rows: DataFrame, *kept: str) -> DataFrame:
    """``words`` (without marks) and ``parts`` (the template) as arrays of one length, beside the columns ``kept``."""
    words = rows.select(*kept, marked_words(F.col("text")).alias("marked"))
    both = words.select(*kept, "marked", template(F.col("marked")).alias("plain"))
    words = F.translate("marked", NAME_MARK, "")
    return both.select(*kept, F.split(words, " ", -1).alias("words"), F.split("plain", " ", -1).alias("parts"))


def _places(size: int, name: str) -> Column:
    """The start of every window of the array ``name``, from 0; none in a shorter one.

    An array that an expression uses only once would be made anew for each window by the optimizer, so it
    has to be the one whose windows are cut.
    """
    last = F.size(name) - F.lit(size)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _window(name: str, at: Column, size: int) -> Column:
    return F.slice(name, at + 1, size)


def _cut(size: int) -> Column:
    return F.transform(
        _places(size, "words"),
        lambda at: F.struct(at.alias("place"), F.lit(size).alias("size"), _window("words", at, size).alias("words"), _window("parts", at, size).alias("parts")),
    )


def _hashes(name: str, size: int) -> Column:
    return F.transform(_places(size, name), lambda at: F.xxhash64(_window(name, at, size)))


def _placeholder(part: Column) -> Column:
    return part.isin(NUMBER, NAME, UNIT)


def _detailed(rows: DataFrame, sizes: list[int], *kept: str) -> DataFrame:
    """A row per window: its place, size, words, template and slots; ``literal`` tells whether the template is used.

    A slot is its place in the text, its type and the word behind it.
    """
    # cut before the rows are made: a row has the words of its window, not those of the text
    cut_out = [_cut(size) for size in sizes]
    cut = rows.select(*kept, F.size("parts").alias("length"), F.explode(F.concat(*cut_out)).alias("cut")).select(*kept, "length", "cut.*")
    literal = F.size(F.filter("parts", lambda part: ~_placeholder(part))) >= LITERAL_WORDS
    slots = F.filter(
        F.transform(
            F.arrays_zip("parts", "words"),
            lambda both, at: F.when(
                _placeholder(both["parts"]),
                F.struct((F.col("place") + at).alias("at"), both["parts"].alias("kind"), both["words"].alias("word")),
            ),
        ),
        lambda slot: slot.isNotNull(),
    )
    return cut.select(*kept, "length", "place", "size", "words", "parts", literal.alias("literal"), slots.alias("slots"))


def _keys() -> Column:
    """What a window is met by: its template, if enough of it is words, and its words as they are."""
    return F.when(F.col("literal"), F.array_distinct(F.array("parts", "words"))).otherwise(F.array("words"))


def contaminated(docs: DataFrame, items: DataFrame, covered: float = COVERED, consistent: float = CONSISTENT, short: bool = False) -> DataFrame:
    """The pairs of document and benchmark item where the document has the item, perhaps re-parameterised.

    Result: ``doc_id, item_id, n_windows, n_matched, coverage, n_slots, consistency, verbatim``.
    ``coverage`` is the share of the words of the item's windows that windows of the document cover, by
    template or by the words themselves without regard to case, and at least ``covered``. ``consistency`` is the share of slots whose value is the one most
    often met for that item value in the same alignment, 1 without slots, and at least ``consistent``.
    Both are taken for each alignment of a row alone, for alignments of a row that differ by fewer than
    NEAR words, and for all alignments of a document; one that passes is enough, and the best is given.
    ``verbatim`` tells whether all its slots agree word for word. Windows with fewer than two words that
    are no placeholders are met by their words alone, and coverage may leave them out if others remain. With
    ``short`` an item of fewer than five words is one window of its whole length; without it such items are
    not looked for. Null texts, texts without a word and null ids of items match nothing; a null ``doc_id``
    is kept as null, all such rows as one document, as are rows that repeat a ``doc_id``. Other columns are
    not read; an empty table on either side gives no rows.
    """
    named = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    asked = _detailed(_split(named, "item_id"), list(range(1, WINDOW + 1)) if short else [WINDOW], "item_id")
    # an item shorter than a window is a window of its own; a text without a word has one empty word
    asked = asked.filter((F.col("size") == WINDOW) | (F.col("size") == F.col("length"))).filter(F.array_join("words", "") != "")
    asked = written(asked.select("*", _keys().alias("keys")), "benchmark-windows")
    whole = asked.groupBy("item_id", "size").agg(
        F.count(F.lit(1)).alias("n_windows"), F.size(_covered_words()).alias("n_words"), F.size(_covered_words("literal")).alias("n_literal")
    )
    sizes = [r["size"] for r in asked.select("size").distinct().collect()] or [WINDOW]

    # all windows of all documents, as hashes of their template and of their words, against those of the benchmark
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = _split(plain, "doc_id")
    hashes = F.concat(*[F.array_union(_hashes("parts", size), _hashes("words", size)) for size in sizes])
    met = parts.select("doc_id", F.explode(hashes).alias("hash"))
    keys = asked.select(F.explode("keys").alias("key"), "item_id", "place", "size", "literal").withColumn("hash", F.xxhash64("key")).drop("key")
    if keys.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    found = met.join(keys, "hash").groupBy("doc_id", "item_id", "size").agg(_covered_words().alias("words"), _covered_words("literal").alias("literals"))
    found = found.join(whole, ["item_id", "size"])
    found = found.filter(_coverage(F.size("words"), F.size("literals")) >= covered)
    item = ["item_id", "size", "n_windows", "n_words", "n_literal"]
    pairs = written(found.select("doc_id", *item), "benchmark-pairs")

    # the pairs in question again, by the words themselves; rows that repeat a doc_id are told apart
    some = pairs.select(F.col("doc_id").alias("_asked")).distinct()
    texts = plain.join(some, F.col("doc_id").eqNullSafe(F.col("_asked")), "left_semi").withColumn("row", F.xxhash64("text"))
    mine = _detailed(_split(texts, "doc_id", "row"), sizes, "doc_id", "row")
    mine = mine.select("doc_id", "row", "place", "words", "slots", F.explode(_keys()).alias("key"))
    its = asked.select(
        F.col("item_id").alias("_item"), F.explode("keys").alias("_key"), F.col("place").alias("item_place"), "literal", F.col("slots").alias("item_slots")
    )
    near = pairs.select(F.col("doc_id").alias("_doc"), *item)
    both = mine.join(near, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(its, (F.col("key") == F.col("_key")) & (F.col("item_id") == F.col("_item")))
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    # what agrees by its words has the values of the item
    slots = F.when(F.col("key") == F.col("words"), F.col("item_slots")).otherwise(F.col("slots")).alias("slots")
    both = written(both.select("doc_id", *item, "row", shift, F.col("item_place").alias("place"), "literal", slots, "item_slots"), "benchmark-matches")
    aligned = ["doc_id", "item_id", "row", "shift"]
    cover = both.groupBy("doc_id", *item, "row", "shift").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("literal"), F.col("place"))).alias("literals"))
    slots = both.select(*aligned, F.explode(F.arrays_zip("slots", "item_slots")).alias("slot"))
    slots = slots.select(*aligned, F.col("slot.item_slots").alias("its"), F.col("slot.slots.word").alias("word")).distinct()
    values = slots.groupBy(*aligned, "its.kind", F.col("its.word").alias("value"), "word").agg(F.count(F.lit(1)).alias("uses"))
    best = values.groupBy(*aligned, "kind", "value").agg(
        F.max("uses").alias("most"), F.sum("uses").alias("uses"), F.bool_and(F.col("value") == F.col("word")).alias("same")
    )
    checked = best.groupBy(*[F.col(c).alias(f"_{c}") for c in aligned]).agg(
        F.sum("most").alias("most"), F.sum("uses").alias("uses"), F.bool_and("same").alias("same")
    )
    met = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in aligned]
    joined = cover.join(checked, met[0] & met[1] & met[2] & met[3], "left")

    # an alignment, those near each other, and all of a document stand for the pair each on its own
    ways = joined.select("*", F.explode(_ways()).alias("way")).groupBy("doc_id", *item, "way").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("literals"))).alias("literals"),
        F.coalesce(F.sum("most"), F.lit(0)).alias("most"), F.coalesce(F.sum("uses"), F.lit(0)).alias("n_slots"),
        F.coalesce(F.bool_and("same"), F.lit(True)).alias("verbatim"),
    )
    measured = ways.select(
        "doc_id", "item_id", "n_windows", F.size("places").cast("long").alias("n_matched"),
        _coverage(F.size(_spread(F.col("places"))), F.size(_spread(F.col("literals")))).alias("coverage"), "n_slots",
        F.when(F.col("n_slots") > 0, F.col("most") / F.col("n_slots")).otherwise(1.0).alias("consistency"), "verbatim",
    )
    passed = measured.filter((F.col("coverage") >= covered) & (F.col("consistency") >= consistent))
    found = passed.groupBy("doc_id", "item_id", "n_windows").agg(F.max(F.struct("verbatim", "coverage", "consistency", "n_matched", "n_slots")).alias("best"))
    return found.select("doc_id", "item_id", "n_windows", *[f"best.{c}" for c in ("n_matched", "coverage", "n_slots", "consistency", "verbatim")])


def _ways() -> Column:
    """The sets of alignments that one at ``shift`` of ``row`` belongs to; any NEAR neighbouring shifts share a set."""
    shift, row = F.col("shift").cast("long"), F.col("row")
    way = lambda kind, row, at: F.struct(F.lit(kind).alias("kind"), row.alias("row"), at.cast("long").alias("at"))
    return F.array(
        way("alone", row, shift), way("near", row, F.floor(shift / (2 * NEAR))), way("near, between", row, F.floor((shift + NEAR) / (2 * NEAR))),
        way("all", F.lit(0).cast("long"), F.lit(0)),
    )


def _spread(places: Column) -> Column:
    """The places of an item that its windows at ``places`` cover; at most as many as it has words."""
    return F.array_distinct(F.flatten(F.transform(places, lambda at: F.sequence(at, at + F.col("size") - 1))))


def _covered_words(which: str = "true") -> Column:
    return _spread(F.collect_set(F.when(F.expr(which), F.col("place"))))


def _coverage(words: Column, literals: Column) -> Column:
    """Of all words of an item, or of those in windows that templates can meet, whichever is more."""
    return F.greatest(words / F.col("n_words"), F.when(F.col("n_literal") > 0, literals / F.col("n_literal")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that have an item of the benchmark; all columns stay.

    Rows of one ``doc_id`` go together, null ids too; null and empty texts have no item and stay.
    """
    name = unused(docs, "_found")
    found = contaminated(docs, items, short=True).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
