"""Finding the instants of a record: by field patterns, by sourcetype, or anywhere in text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import instants as I
from tidemark.functions.bind import blank_to_null, computed_once, let
from tidemark.functions.values import Value, read_instant, typed_value, variant_value
from tidemark.plans.pattern_sets import GENERIC, METADATA, REGISTRY, REQUIRED_ANY, Pattern

FieldReader = Callable[[str], Value]


# ---------------------------------------------------------------------------------------------
# reading fields


def json_path(steps: Sequence[str]) -> str:
    return "$" + "".join("['" + step.replace("'", "\\'") + "']" for step in steps)


def map_reader(data: Column) -> FieldReader:
    """Fields of a ``map<string, variant>`` by dotted path."""

    def read(field: str) -> Value:
        top, *rest = field.split(".")
        v = F.try_element_at(data, F.lit(top))
        return variant_value(F.try_variant_get(v, json_path(rest), "variant") if rest else v)

    return read


def struct_reader(df: DataFrame, prefix: str | None = None) -> FieldReader:
    """Fields of declared columns (or of the struct column ``prefix``) by dotted path."""
    root = df.schema if prefix is None else df.schema[prefix].dataType

    def read(field: str) -> Value:
        col, dtype = (None if prefix is None else F.col(f"`{prefix}`")), root
        steps = field.split(".")
        for i, step in enumerate(steps):
            if isinstance(dtype, T.VariantType):
                return variant_value(F.try_variant_get(col, json_path(steps[i:]), "variant"))
            if not isinstance(dtype, T.StructType) or step not in dtype.fieldNames():
                return Value()
            col = F.col(f"`{step}`") if col is None else col.getField(step)
            dtype = dtype[step].dataType
        return typed_value(col, dtype)

    return read


JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BAD = "_unreadable"


def json_fields(
    df: DataFrame, raw: str, patterns: Iterable[Pattern]
) -> tuple[DataFrame, FieldReader]:
    """Parse only the top-level fields that the patterns name out of JSON text, in one go.

    The frame gets a helper column per field, and ``is_object`` (false where the text is not one
    JSON object). Used where nothing but instants is needed: no other value is built.
    """
    tops = list(dict.fromkeys(p.field.split(".")[0] for p in patterns))
    schema = T.StructType(
        [T.StructField(t, T.VariantType()) for t in tops] + [T.StructField(_BAD, T.StringType())]
    )
    options = {**JSON_OPTIONS, "columnNameOfCorruptRecord": _BAD}
    text = stripped(F.col(raw))
    parsed = F.when(looks_like_object(text), F.from_json(text, schema, options))
    # names are replaced by position: fields may differ in letter case only
    helpers = [f"_field_{i}" for i in range(len(tops))]
    staged = df.withColumn("_parsed", parsed)
    flat = staged.select(*df.columns, F.col("_parsed").isNotNull().alias("_known"), "_parsed.*")
    flat = flat.toDF(*df.columns, "_known", *helpers, _BAD)
    good = F.col("_known") & F.col(_BAD).isNull()
    flat = flat.withColumn("is_object", good).withColumns(
        {h: F.when(F.col("is_object"), F.col(h)) for h in helpers}
    )
    places = dict(zip(tops, helpers))

    def read(field: str) -> Value:
        top, *rest = field.split(".")
        v = F.col(places[top])
        return variant_value(F.try_variant_get(v, json_path(rest), "variant") if rest else v)

    return flat.drop("_known", _BAD), read


# What counts as white space around a record.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(raw: Column) -> Column:
    return F.btrim(raw, F.lit(WHITE_SPACE))


def looks_like_object(text: Column) -> Column:
    """Whether text without white space around it can be a JSON object."""
    return text.startswith("{") & text.endswith("}")


def json_object(raw: Column) -> Column:
    """JSON text to ``map<string, variant>``, NULL where it is not one object."""
    text = stripped(raw)
    return F.when(looks_like_object(text), F.from_json(text, "map<string,variant>", JSON_OPTIONS))


# ---------------------------------------------------------------------------------------------
# instants by field


@dataclass(frozen=True)
class Found:
    """One field: its instant (microseconds), and what the regex patterns matched, with their formats."""

    field: str
    us: Column
    hits: tuple[tuple[Column, str], ...] = ()
    format: str = "iso8601"


INSTANTS, MATCHED = "_instants", "_matched"


def _regex_text(text: Column, regex: str) -> Column:
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 1))


def _candidate(value: Value, p: Pattern, place: int, hit: Column | None) -> Column:
    """What a pattern sees: the place of its field, its format, and the value in the form it is held."""
    if p.regex is not None:
        value = Value(hit, value.number, value.instant)
    held, none = value.variant, Value()
    return F.struct(
        F.lit(place).alias("field"),
        F.lit(p.format).alias("format"),
        (F.lit(None).cast("variant") if held is None else held).alias("variant"),
        (value if held is None else none).text.alias("text"),
        (value if held is None else none).number.alias("number"),
        value.instant.alias("instant"),
    )


def _is_held(e: Column) -> Column:
    held = e["variant"].isNotNull() | e["text"].isNotNull() | e["number"].isNotNull() | e["instant"].isNotNull()
    return F.coalesce(held, F.lit(False))


def _read_candidate(formats: Sequence[str]) -> Callable[[Column], Column]:
    def by_format(e: Column, text: Column, number: Column) -> Column:
        value = Value(text, number, e["instant"])
        chosen = F.when(F.lit(False), F.lit(None).cast("bigint"))
        for fmt in formats:
            chosen = chosen.when(e["format"] == fmt, read_instant(value, fmt))
        return F.struct(e["field"].alias("field"), chosen.alias("us"))

    def read(e: Column) -> Column:
        def of_variant(v: Column) -> Column:
            inner = variant_value(v)
            return let(
                F.coalesce(e["text"], inner.text),
                lambda t: let(F.coalesce(e["number"], inner.number), lambda n: by_format(e, t, n)),
            )

        return let(e["variant"], of_variant)

    return read


def find_instants(
    df: DataFrame, read: FieldReader, patterns: Sequence[Pattern]
) -> tuple[DataFrame, list[Found]]:
    """Try patterns in order; the last success of a field counts.

    The fields are looked up once each, and their kind is tested once; each of their patterns is an
    expression over two plain columns, text and number. The readings are held in helper columns of the
    returned frame (see :func:`drop_helpers`); the fields found refer to them.
    """
    df = drop_helpers(df)
    original = df.columns
    values = {p.field: read(p.field) for p in patterns}
    held = {f"_held_{i}": v.variant for i, v in enumerate(values.values()) if v.variant is not None}
    df = df.withColumns(held) if held else df
    parts, plain = {}, {}
    for i, (field, value) in enumerate(values.items()):
        value = variant_value(F.col(f"_held_{i}")) if f"_held_{i}" in held else value
        parts |= {f"_text_{i}": value.text, f"_number_{i}": value.number, f"_instant_{i}": value.instant}
        plain[field] = Value(*[F.col(f"_{kind}_{i}") for kind in ("text", "number", "instant")])
    df = df.withColumns(parts) if parts else df

    with_regex = [p for p in patterns if p.regex is not None]
    if with_regex:
        df = computed_once(df, {MATCHED: F.array(*[_regex_text(plain[p.field].text, p.regex) for p in with_regex])})
    hits = {p: F.get(F.col(MATCHED), F.lit(i)) for i, p in enumerate(with_regex)}
    readings, tries = [], {}
    for p in patterns:
        value = plain[p.field]
        # a value that is not text is read as it is
        value = Value(hits[p], value.number, value.instant) if p in hits else value
        tries.setdefault(p.field, []).insert(0, F.get(F.col(INSTANTS), F.lit(len(readings))))
        readings.append(read_instant(value, p.format))
    df = computed_once(df, {INSTANTS: F.array(*readings).cast("array<bigint>")})
    df = computed_once(df, {INSTANTS: F.array(*[F.coalesce(*t) for t in tries.values()])})
    df = df.select(*[f"`{c}`" for c in original], *([MATCHED] if hits else []), INSTANTS)
    places = [F.get(F.col(INSTANTS), F.lit(i)) for i in range(len(tries))]
    return df, _fields_found(patterns, places, hits)


def _fields_found(
    patterns: Sequence[Pattern], places: Sequence[Column], hits: dict[Pattern, Column]
) -> list[Found]:
    """The fields in the order in which patterns name them first, each with its instant."""
    matched: dict[str, tuple] = {}
    for p in patterns:
        if p in hits:
            matched[p.field] = (*matched.get(p.field, ()), (hits[p], p.format))
    last = {p.field: p.format for p in patterns}
    return [Found(field, us, matched.get(field, ()), last[field]) for field, us in zip(last, places)]


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(INSTANTS, MATCHED)


def instants(
    df: DataFrame, read: FieldReader, patterns: Iterable[Pattern]
) -> tuple[DataFrame, list[Found]]:
    """Readings by an ordered pattern list."""
    return find_instants(df, read, list(dict.fromkeys(patterns)))


def instants_by_sourcetype(
    df: DataFrame, read: FieldReader, sourcetype: Column
) -> tuple[DataFrame, list[Found]]:
    """The generic set, preceded on each row by the registered patterns of its sourcetype.

    The whole registry is a constant of the library. A sourcetype (any letter case) is looked up once
    for its number; the first, second and further pattern of that number fill as many places, so a row
    holds no more values than its sourcetype has patterns, next to those of the generic set. One
    expression reads those that are there.
    """
    df = drop_helpers(df)
    original = df.columns
    registry = {name.lower(): [p._replace(is_base=False) for p in patterns] for name, patterns in REGISTRY.items()}
    generic = [p._replace(is_base=False) for p in GENERIC]
    patterns = list(dict.fromkeys([p for own in registry.values() for p in own] + generic))
    values = {p.field: read(p.field) for p in patterns}
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(registry) for x in (name, i)])
    df = computed_once(df, {"_registered": F.try_element_at(numbers, F.lower(sourcetype))})

    def registered(test: Callable[[list[Pattern]], bool]) -> Column:
        return F.col("_registered").isin([i for i, own in enumerate(registry.values()) if test(own)])

    with_regex = [p for p in patterns if p.regex is not None]
    matched = [F.when(registered(lambda own: p in own), _regex_text(values[p.field].text, p.regex)) for p in with_regex]
    df = computed_once(df, {MATCHED: F.array(*matched)})
    hits = {p: F.get(F.col(MATCHED), F.lit(i)) for i, p in enumerate(with_regex)}

    fields = list(values)
    slots = []
    for at in range(max(map(len, registry.values()))):
        slot = None
        for p in dict.fromkeys(own[at] for own in registry.values() if len(own) > at):
            mine = registered(lambda own: own[at : at + 1] == [p])
            value = _candidate(values[p.field], p, fields.index(p.field), hits.get(p))
            slot = F.when(mine, value) if slot is None else slot.when(mine, value)
        slots.append(slot)
    slots += [_candidate(values[p.field], p, fields.index(p.field), None) for p in generic]
    # the last pattern first: of several readings of a field it counts
    held = F.filter(F.array(*reversed(slots)), _is_held)
    readings = F.filter(F.transform(held, _read_candidate(list(dict.fromkeys(p.format for p in patterns)))), lambda r: r["us"].isNotNull())
    df = computed_once(df, {"_read": readings})
    first = F.filter("_read", lambda r, i: F.array_position(F.col("_read.field"), r["field"]) == i + 1)
    df = computed_once(df, {INSTANTS: F.map_from_entries(F.array_sort(first))})
    df = df.select(*[f"`{c}`" for c in original], MATCHED, INSTANTS)
    places = [F.try_element_at(F.col(INSTANTS), F.lit(i)) for i in range(len(fields))]
    return df, _fields_found(patterns, places, hits)


def timestamp_map(found: Sequence[Found]) -> Column:
    """``map<string, timestamp>`` of the fields that were read."""
    names, us = F.array(*[F.lit(f.field) for f in found]), F.array(*[f.us for f in found])
    read = F.filter(F.arrays_zip(names.alias("key"), us.alias("value")), lambda e: e["value"].isNotNull())
    return F.map_from_entries(
        F.transform(read, lambda e: F.struct(e["key"].alias("key"), F.timestamp_micros(e["value"]).alias("value")))
    )


def extract(df: DataFrame, read: FieldReader, patterns: Iterable[Pattern]) -> DataFrame:
    """Add ``timestamps``: the instants of each record by field."""
    staged, found = instants(df, read, patterns)
    return drop_helpers(staged.withColumn("timestamps", timestamp_map(found)))


def extract_by_sourcetype(df: DataFrame, read: FieldReader, sourcetype: Column) -> DataFrame:
    """Add ``timestamps`` as :func:`extract` does, by the patterns of each row's sourcetype."""
    staged, found = instants_by_sourcetype(df, read, sourcetype)
    names = F.array(*[F.lit(f.field) for f in found])
    entries = F.transform(
        F.map_entries(INSTANTS),
        lambda e: F.struct(F.get(names, e["key"]).alias("key"), F.timestamp_micros(e["value"]).alias("value")),
    )
    return drop_helpers(staged.withColumn("timestamps", F.map_from_entries(entries)))


def base_instant(
    timestamps: Column, patterns: Iterable[Pattern], prefer: str | None = None
) -> Column:
    """The instant other deltas of a record refer to: a base field, a preferred one, the earliest."""
    names = [p.field for p in patterns if p.is_base] + ([prefer] if prefer else [])
    chosen = [F.try_element_at(timestamps, F.lit(n)) for n in dict.fromkeys(names)]
    return F.coalesce(*chosen, F.array_min(F.map_values(timestamps)))


def record_metadata(data: Column, schema: str) -> Column:
    """The fields a schema keeps as metadata."""
    kept = list(METADATA[schema])
    return F.map_filter(data, lambda k, _: k.isin(kept) if kept else F.lit(False))


def is_valid(data: Column, schema: str) -> Column:
    """Whether a record has one of the fields its schema requires."""
    required = REQUIRED_ANY[schema]
    if not required:
        return F.lit(True)
    present = [F.map_contains_key(data, F.lit(f)) for f in required]
    condition = present[0]
    for p in present[1:]:
        condition = condition | p
    return condition


# ---------------------------------------------------------------------------------------------
# instants anywhere in text

# ISO text, ten-digit epoch, RFC 3339 text.
TEXT_EXPRESSIONS = (
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "iso8601"),
    (r"(?U)\b[0-9]{10}\b", "unix_seconds"),
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})", "rfc3339"),
)


def instants_in_text(
    text: Column, expressions: Sequence[tuple[str, str]] = TEXT_EXPRESSIONS
) -> Column:
    """``array<timestamp>`` of all readable matches, expression by expression."""

    def matches(regex: str, fmt: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        read = F.transform(hits, lambda h: read_instant(Value(text=h), fmt))
        return F.transform(F.filter(read, lambda u: u.isNotNull()), F.timestamp_micros)

    return F.concat(*[matches(regex, fmt) for regex, fmt in expressions])


def regex_field(text: Column, regex: str) -> Column:
    """Group 1 of the first match, NULL where nothing matched."""
    return blank_to_null(F.regexp_extract(text, regex, 1))


def iso_of(text: Column) -> Column:
    return F.timestamp_micros(I.iso_micros(text))
