"""Putting moved instants back into records, and turning records into text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import instants as I
from tidemark.functions.affine import Affine
from tidemark.functions.bind import computed_once, let, let_any, whole_div
from tidemark.operators.extract import INSTANTS, MATCHED, FieldReader, Found, instants
from tidemark.operators.rawtext import shift_text
from tidemark.plans.pattern_sets import Pattern
from tidemark.plans.text_families import DEFAULT_FAMILIES


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace only the first occurrence; NULL when there is none."""
    at = F.call_function("locate", old, text)
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1), new,
            F.substring(text, at + F.length(old), F.length(text)),
        ),
    )


def _decimals_text(us: Column, decimals: Column) -> Column:
    """Epoch seconds with a given number of decimals, rounded half to even."""
    shown = F.least(decimals, F.lit(6))
    step = F.pow(F.lit(10.0), 6 - shown).cast("bigint")
    q, r = whole_div(us, step), F.abs(us % step)
    up = (2 * r > step) | ((2 * r == step) & (F.pmod(q, F.lit(2)) == 1))
    rounded = q + F.when(up, F.signum(us).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def show(n: Column) -> Column:
        digits = F.lpad(F.abs(n).cast("string"), F.greatest(shown + 1, F.length(F.abs(n).cast("string"))), F.lit("0"))
        whole = F.substring(digits, F.lit(1), F.length(digits) - shown)
        return F.concat(
            F.when(n < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."),
            F.rpad(F.right(digits, shown), decimals, F.lit("0")),
        )

    return let(rounded, show)


def matched_text(us: Column, fmt: str, matched: Column) -> Column:
    """A moved instant in the notation of a regex field."""
    plain = I.format_micros(us, fmt)
    if fmt not in I.EPOCH_SECONDS:
        return plain
    decimals = F.length(F.get(F.split(matched, r"\."), F.lit(1)))
    return F.when(matched.contains("."), _decimals_text(us, decimals)).otherwise(plain)


def put_matched(value: Column, us: Column, fmt: str, matched: Column) -> Column:
    """New text of a regex field: the first occurrence of the match is replaced."""
    new = matched_text(us, fmt, matched)
    return F.coalesce(replace_first(value, matched, new), new)


def _same_encoding(v: Column, us: Column, fmt: str) -> Column:
    """The moved instant as a number where the field held a number."""
    kind = F.schema_of_variant(v)
    seconds = fmt in I.EPOCH_SECONDS
    whole = whole_div(us, F.lit(I.SECOND)) if seconds else I.epoch_millis(us)
    fraction = us.cast("double") / F.lit(1e6 if seconds else 1e3)
    return (
        F.when(kind == "BIGINT", whole.cast("variant"))
        .when(kind == "STRING", I.iso_text(us).cast("variant"))
        .otherwise(fraction.cast("variant"))
    )


def put_instants(
    data: Column,
    moved: Sequence[Found],
    keep_encoding: bool = False,
    paths: dict[str, str] | None = None,
    plain: Column | None = None,
    zone_offset: int = 0,
) -> Column:
    """Write moved instants into a ``map<string, variant>``, other fields and their order kept.

    A plain field becomes ISO text (or keeps its number with ``keep_encoding``); a regex field has
    its match replaced. ``paths`` sends a field to another dotted path, whose missing parents are
    created. ``plain`` is a ``map<string, timestamp>`` of further top-level fields, all written as ISO
    text; it keeps the expression small when there are many.
    """
    paths = paths or {}
    tree: dict = {}
    for f in moved:
        steps = paths.get(f.field, f.field).split(".")
        node = tree
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = f

    def leaf(f: Found, v: Column) -> Column:
        plain = I.iso_text(f.us, zone_offset).cast("variant")
        if f.hits:
            text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
            chosen = plain
            for hit, fmt in f.hits:  # the last pattern that matched counts
                new = put_matched(text, f.us, fmt, hit).cast("variant")
                chosen = F.when(hit.isNotNull(), new).otherwise(chosen)
            return chosen
        if keep_encoding and (f.format in I.EPOCH_SECONDS or f.format in I.EPOCH_MILLIS):
            return _same_encoding(v, f.us, f.format)
        return plain

    def any_moved(node: dict) -> Column:
        flags = [
            any_moved(child) if isinstance(child, dict) else child.us.isNotNull()
            for child in node.values()
        ]
        result = flags[0]
        for flag in flags[1:]:
            result = result | flag
        return result

    nothing = F.lit(None).cast("variant")
    no_fields = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")
    )

    def new_value(child, v: Column) -> Column:
        if isinstance(child, Found):
            return leaf(child, v)
        inner = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), no_fields)
        return F.to_variant_object(put(inner, child))

    def put(fields: Column, node: dict, top: bool = False) -> Column:
        def each(k: Column, v: Column) -> Column:
            kept = v
            if top and plain is not None:
                ts = F.when(~k.contains("."), F.try_element_at(plain, k))
                text = let(F.unix_micros(ts), lambda us: I.iso_text(us, zone_offset))
                kept = F.when(ts.isNotNull(), text.cast("variant")).otherwise(v)
            chosen = F.when(F.lit(False), v)
            for name, child in node.items():
                flag = any_moved(child) if isinstance(child, dict) else child.us.isNotNull()
                chosen = chosen.when((k == name) & flag, new_value(child, v))
            return chosen.otherwise(kept)

        def with_key(m: Column, name: str, child) -> Column:
            flag = any_moved(child) if isinstance(child, dict) else child.us.isNotNull()
            added = F.create_map(F.lit(name), nothing)
            return let_any(m, lambda x: F.when(
                flag & ~F.map_contains_key(x, F.lit(name)), F.map_concat(x, added)
            ).otherwise(x))

        def widen(m: Column) -> Column:
            for name, child in node.items():
                m = with_key(m, name, child)
            return m

        return F.transform_values(widen(fields) if paths else fields, each)

    return put(data, tree, True) if tree or plain is not None else data


def shift_records(
    df: DataFrame,
    read: FieldReader,
    patterns: Sequence[Pattern],
    plan: Affine,
    data: str = "data",
    raw_field: str = "_raw",
    sourcetype: str | None = None,
    keep_encoding: bool = False,
) -> DataFrame:
    """Replay records: ``data`` with moved instants, plus the old and new instants by field.

    Adds ``timestamps`` and ``new_timestamps``. The text in ``raw_field`` is moved too, for records
    with at least one instant, by the families of the ``sourcetype`` column.
    """
    staged, found = instants(df, read, patterns)
    return shift_found(staged, found, plan, data, raw_field, sourcetype, keep_encoding)


def moved_instants(df: DataFrame, found: Sequence[Found], plan: Affine) -> DataFrame:
    """Add ``timestamps`` and ``new_timestamps``, the old and new instants by field; records are left as they are."""
    staged = _moved_once(df, found, plan)
    return staged.drop("_old", "_new", INSTANTS, MATCHED)


def _moved_once(df: DataFrame, found: Sequence[Found], plan: Affine) -> DataFrame:
    names = F.array(*[F.lit(f.field) for f in found])

    def as_map(us: str) -> Column:
        # most records have one or two of the fields
        read = F.filter(F.arrays_zip(names.alias("key"), F.col(us).alias("us")), lambda e: e["us"].isNotNull())
        return F.map_from_entries(F.transform(
            read, lambda e: F.struct(e["key"].alias("key"), F.timestamp_micros(e["us"]).alias("value"))
        ))

    # the readings and the moved instants are computed once each
    staged = computed_once(df, {"_old": F.array(*[f.us for f in found])})
    staged = computed_once(staged, {"_new": F.transform("_old", plan)})
    staged = computed_once(staged, {"timestamps": as_map("_old"), "new_timestamps": as_map("_new")})
    return staged


def shift_found(
    df: DataFrame,
    found: Sequence[Found],
    plan: Affine,
    data: str = "data",
    raw_field: str = "_raw",
    sourcetype: str | None = None,
    keep_encoding: bool = False,
) -> DataFrame:
    def special(f: Found) -> bool:
        numeric = f.format in I.EPOCH_SECONDS or f.format in I.EPOCH_MILLIS
        return "." in f.field or bool(f.hits) or (keep_encoding and numeric)

    # so are the moved record and its text
    staged = _moved_once(df, found, plan)
    apart = [
        replace(f, us=F.get(F.col("_new"), F.lit(i))) for i, f in enumerate(found) if special(f)
    ]
    kind = None if sourcetype is None else F.col(sourcetype)
    put = put_instants(F.col(data), apart, keep_encoding, plain=F.col("new_timestamps"))
    staged = computed_once(staged, {"_put": put})
    raw_value = F.try_element_at(F.col("_put"), F.lit(raw_field))
    raw = F.when(
        (F.size("new_timestamps") > 0) & (F.schema_of_variant(raw_value) == "STRING"),
        F.try_variant_get(raw_value, "$", "string"),
    )
    staged = computed_once(staged, {"_raw_new": shift_text(raw, plan, DEFAULT_FAMILIES, kind)})
    with_raw = F.transform_values(
        "_put", lambda k, v: F.when(k == raw_field, F.col("_raw_new").cast("variant")).otherwise(v)
    )
    final = F.when(F.col("_raw_new").isNotNull(), with_raw).otherwise(F.col("_put"))
    return staged.withColumn(data, final).drop("_put", "_raw_new", "_old", "_new", INSTANTS, MATCHED)


# ---------------------------------------------------------------------------------------------
# records to text


def as_json(data: Column) -> Column:
    """One compact JSON object."""
    return F.to_json(data)


def as_line(data: Column, raw: Column | None = None) -> Column:
    """The ``line`` field if there is one, else the text as read, else the object as JSON."""
    line = F.try_variant_get(F.try_element_at(data, F.lit("line")), "$", "string")
    return F.coalesce(line, *([] if raw is None else [raw]), F.to_json(data))


def json_array_lines(df: DataFrame, file: str, order: str, record: str) -> DataFrame:
    """``file, place, line``: the lines of one JSON array per file, in order of ``place``.

    Rows are sorted within a file and pass one by one, so a task holds no array, whatever its size. The
    result is partitioned by file and sorted: written as text, partitioned by file, it is the arrays.
    """
    within = W.partitionBy(file).orderBy(order)
    place = F.row_number().over(within) - 1
    last = F.lead(F.lit(1)).over(within).isNull()
    line = F.concat(F.when(place == 0, "[").otherwise(""), F.col(record), F.when(last, "]").otherwise(","))
    return df.select(file, place.cast("long").alias("place"), line.alias("line"))
