"""Change sets over text and over JSON values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bind import let

_SPAN = "array<struct<start:int,seq:int,stop:int,old:string,new:string>>"


def change_list(changes: list[tuple[str, str]]) -> Column:
    """A fixed list of ``(old, new)`` as an array column."""
    return F.array(*[
        F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in changes
    ])


def _quoted(literal: Column) -> Column:
    inner = F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def spans(text: Column, changes: Column) -> Column:
    """All places of all old values: ``array<struct<start, seq, stop, old, new>>``, start from 1.

    Places of one value do not overlap each other; ``seq`` is the order in which the changes were
    added. An empty old value has no places.
    """

    def places(change: Column, index: Column) -> Column:
        size = F.length(change["old"])
        gaps = F.split(text, _quoted(change["old"]), -1)
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

        def step(acc: Column, gap: Column) -> Column:
            here = acc["at"] + F.length(gap)
            return F.struct(
                (here + size).alias("at"), F.concat(acc["found"], F.array(here)).alias("found")
            )

        def to_spans(starts: Column) -> Column:
            return F.transform(starts, lambda s: F.struct(
                s.alias("start"), index.alias("seq"), (s + size).alias("stop"),
                change["old"].alias("old"), change["new"].alias("new"),
            ))

        leading = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
        found = let(F.aggregate(leading, start, step, lambda acc: acc["found"]), to_spans)
        return F.when((size > 0) & text.contains(change["old"]), found).otherwise(
            F.array().cast(_SPAN)
        )

    return F.flatten(F.transform(changes, places))


def apply_changes(text: Column, changes: Column) -> Column:
    """Replace from right to left.

    Of changes that start at the same place the first added counts. A change is left out when the
    text at its place is no longer the old value, as after an overlapping change to its right.
    """
    ordered = F.array_sort(spans(text, changes))

    def first_at_place(all_spans: Column) -> Column:
        return F.filter(
            all_spans,
            lambda s, i: (i == 0) | (F.get(all_spans, i - 1)["start"] != s["start"]),
        )

    def put(acc: Column, s: Column) -> Column:
        size = s["stop"] - s["start"]
        return F.when(
            F.substring(acc, s["start"], size) == s["old"],
            F.concat(
                F.substring(acc, F.lit(1), s["start"] - 1), s["new"],
                F.substring(acc, s["stop"], F.length(acc)),
            ),
        ).otherwise(acc)

    return F.when(
        text.isNotNull(),
        let(ordered, lambda o: F.aggregate(F.reverse(first_at_place(o)), text, put)),
    )


def apply_change_list(text: Column, changes: list[tuple[str, str]]) -> Column:
    """:func:`apply_changes` for a list known when the query is built, in time linear in the text.

    All old values are matched by one expression. Where it finds as many places as the values have
    one by one, no two places touch and the text is put together from its pieces. Any other text
    goes through :func:`apply_changes`.
    """
    first = {}
    for old, new in changes:
        if old:
            first.setdefault(old, new)
    simple = not any(old[:n] == old[-n:] for old in first for n in range(1, len(old)))
    slow = apply_changes(text, change_list(changes))
    if not first or not simple:
        return slow
    either = "|".join(re.escape(old) for old in first)
    pairs = [F.lit(x) for pair in first.items() for x in pair]

    def put(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(either), F.lit(0))
        alone = F.lit(0)
        for old in first:
            gone = F.length(t) - F.length(F.replace(t, F.lit(old), F.lit("")))
            alone = alone + gone / F.lit(len(old))

        def joined(found: Column) -> Column:
            news = F.transform(found, lambda h: F.try_element_at(F.create_map(*pairs), h))
            parts = F.transform(
                F.arrays_zip(F.split(t, either, -1).alias("gap"), news.alias("new")),
                lambda z: F.concat(z["gap"], F.coalesce(z["new"], F.lit(""))),
            )
            return F.when(F.size(found) == alone, F.array_join(parts, "")).otherwise(slow)

        return let(hits, joined)

    return let(text, put)


def change_rows(df: DataFrame, key: str, text: str, changes: Column) -> DataFrame:
    """One row per place of a change: ``key, start, seq, stop, old, new``."""
    return df.select(key, F.explode(spans(F.col(text), changes)).alias("s")).select(key, "s.*")


def overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Neighbouring changes of a text whose spans overlap."""
    w = W.partitionBy(key).orderBy("start", "seq")
    nxt = rows.withColumns({
        "next_start": F.lead("start").over(w), "next_stop": F.lead("stop").over(w),
    })
    return nxt.filter(F.col("next_start") < F.col("stop")).select(
        key, "start", "stop", "next_start", "next_stop"
    )


def change_json_values(data: Column, changes: dict[str, dict[str, str]]) -> Column:
    """Replace values by ``{dotted path: {old text: new text}}`` in a ``map<string, variant>``.

    A path that is missing, or leads through something that is not an object, changes nothing.
    A number stays a number when the new text is one.
    """
    tree: dict = {}
    for path, values in changes.items():
        *parents, last = path.split(".")
        node = tree
        for step in parents:
            node = node.setdefault(step, {}).setdefault("in", {})
        node.setdefault(last, {})["values"] = values

    def new_scalar(v: Column, values: dict[str, str]) -> Column:
        kind = F.schema_of_variant(v)
        table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        new = F.try_element_at(table, F.try_variant_get(v, "$", "string"))
        number = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.coalesce(
            F.when(kind == "BIGINT", new.try_cast("bigint").cast("variant")),
            F.when(number, new.try_cast("double").cast("variant")),
            new.cast("variant"),
            v,
        )

    def put(fields: Column, node: dict) -> Column:
        def each(k: Column, v: Column) -> Column:
            chosen = F.when(F.lit(False), v)
            for name, child in node.items():
                new = new_scalar(v, child["values"]) if "values" in child else v
                if "in" in child:
                    inner = F.try_variant_get(v, "$", "map<string,variant>")
                    new = F.coalesce(
                        F.when(inner.isNotNull(), F.to_variant_object(put(inner, child["in"]))), new
                    )
                chosen = chosen.when(k == name, new)
            return chosen.otherwise(v)

        return F.transform_values(fields, each)

    return put(data, tree) if tree else data


def change_json_text(line: Column, data: Column, changes: dict[str, dict[str, str]]) -> Column:
    """The same on JSON text; a line that is not one object comes back unchanged."""
    return F.when(data.isNotNull(), F.to_json(change_json_values(data, changes))).otherwise(line)
