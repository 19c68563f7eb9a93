"""Moving the timestamps inside raw text, each in the notation it was written in.

Families of notations are tried in order of priority; a match that overlaps a claimed one is skipped, and one
that cannot be read claims nothing. All of it is one expression of Spark's own functions, without a shuffle:

1. A family is looked for only in text that has its literal markers, and in rows whose sourcetype can have it.
2. The text is cut at the matches of each family that has any; a match becomes its moved text by position.
3. If one family has matches, as in most lines, the pieces are put together again. Otherwise matches get
   their positions and are claimed by priority.

Digits and blanks in the expressions are the ASCII ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.affine import Affine
from tidemark.functions.bind import let
from tidemark.functions.rawmoves import PUT, Move, quoted
from tidemark.functions.rawmoves import let as let_sql
from tidemark.plans.text_families import (
    ALL_FAMILIES,
    DEFAULT_FAMILIES,
    FAMILY_ANY,
    FAMILY_MARKERS,
    FAMILY_REGEX,
    PREFIX_FAMILIES,
    SOURCETYPE_FAMILIES,
)

_HIT = "struct<start:int,stop:int,new:string>"
_MARK = quoted("\ue000")


def _matches(text: Column, family: str, wanted: Column | None) -> Column:
    """The matches of a family in a text, NULL where its sourcetype or a missing marker rules them out.

    """
    tests = [] if wanted is None else [F.array_contains(wanted, family)]
    tests += [text.contains(marker) for marker in FAMILY_MARKERS[family]]
    if one_of := FAMILY_ANY.get(family):
        tests.append(reduce(or_, [text.contains(marker) for marker in one_of]))
    return F.when(reduce(and_, tests), F.regexp_extract_all(text, F.lit(FAMILY_REGEX[family]), F.lit(0)))


def _cut(family: str, row: str, move: Move) -> str:
    """The cut text of a family with matches: matches, new texts (NULL if unreadable), gaps; NULL without any."""
    hits = f"{row}.{family}"
    regex = quoted(FAMILY_REGEX[family])
    # a lone match that stands once in the text is cut out by its place; looking for it again as a pattern is far dearer
    around = f"array(substring_index({row}.text, {hits}[0], 1), substring_index({row}.text, {hits}[0], -1))"
    once = let_sql(around, lambda g: f"if(octet_length({g}[0]) + octet_length({hits}[0]) + octet_length({g}[1]) = octet_length({row}.text), {g}, null)")
    # split compiles its expression for every text, regexp_replace once a task; a text with the mark in it is rare
    gaps = f"if(instr({row}.text, {_MARK}) > 0, split({row}.text, {regex}, -1), split(regexp_replace({row}.text, {regex}, {_MARK}), {_MARK}, -1))"
    gaps = f"coalesce(if(size({hits}) = 1, {once}, null), {gaps})"
    cut = (
        f"struct({quoted(family)} as family, {hits} as hits, transform({hits}, h -> {PUT[family]('h', move)}) as news, {gaps} as gaps)"
    )
    return f"if(size({hits}) > 0, {cut}, null)"


_TOGETHER = "concat({p}.gaps[0], array_join(transform({p}.hits, (h, i) -> concat(coalesce({p}.news[i], h), {p}.gaps[i + 1])), ''))"


def _claimed(cuts: str, row: str) -> str:
    """The text with the matches of several families claimed by priority."""
    places = (
        "aggregate(sequence(0, size(p.hits) - 1), "
        f"named_struct('at', 1, 'hits', cast(array() as array<{_HIT}>)), "
        "(acc, i) -> array_max(transform(array(acc.at + length(p.gaps[i])), start -> named_struct("
        "'at', start + length(p.hits[i]), 'hits', concat(acc.hits, array(named_struct("
        "'start', start, 'stop', start + length(p.hits[i]), 'new', p.news[i])))))), acc -> acc.hits)"
    )
    readable = f"filter(flatten(transform({cuts}, p -> {places})), h -> h.new is not null)"
    taken = (
        f"array_sort(aggregate({readable}, cast(array() as array<{_HIT}>), (acc, h) -> "
        "if(exists(acc, t -> h.start < t.stop and h.stop > t.start), acc, concat(acc, array(h)))))"
    )
    return let_sql(taken, lambda c: (
        f"if(size({c}) = 0, {row}.text, concat(array_join(transform({c}, (h, i) -> array_max(transform(array(if(i = 0, 1, {c}[greatest(i - 1, 0)].stop)), "
        f"before -> concat(substring({row}.text, before, h.start - before), h.new)))), ''), substring({row}.text, {c}[size({c}) - 1].stop)))"
    ))


def shift_text(
    text: Column,
    plan: Affine,
    families: Sequence[str] = DEFAULT_FAMILIES,
    sourcetype: Column | None = None,
) -> Column:
    """The text with every recognised instant moved by ``plan``.

    ``families`` is the order of priority; with a ``sourcetype`` column each row has the families of
    its own. A row without a plan keeps its text.
    """
    if not families and sourcetype is None:
        return text
    by_row = sourcetype is not None
    tried = [f for f in ALL_FAMILIES if any(f in own for own in (DEFAULT_FAMILIES, *SOURCETYPE_FAMILIES.values()))] if by_row else list(families)
    fixed = not isinstance(plan.factor, Column)
    # the text and the families of the row are used many times, and what is used in a lambda is computed at each use
    held = [text.alias("text")]
    if by_row:
        held.append(F.when(text.isNotNull(), families_by_sourcetype(sourcetype)).alias("families"))
    return let(F.struct(*held), lambda t: _moved(t, plan, tried, by_row, fixed))


def _moved(held: Column, plan: Affine, tried: Sequence[str], by_row: bool, fixed: bool) -> Column:
    """The moved text of ``held``, a struct of the ``text`` and, if they differ by row, its ``families``."""
    text = held["text"]
    wanted = held["families"] if by_row else None
    fields = [
        text.alias("text"), plan.base.alias("base"), plan.new_base.alias("new_base"),
        (F.lit(None).cast("double") if fixed else plan.factor.cast("double")).alias("factor"),
        (F.lit(None).cast("bigint") if plan.ceiling is None else plan.ceiling).alias("ceiling"),
        *[_matches(text, f, wanted).alias(f) for f in tried],
    ]
    move = Move("r", plan.factor if fixed else None)
    cuts = f"array_compact(array({', '.join(_cut(f, 'r', move) for f in tried)}))"
    ordered = "c"
    if by_row:
        # the row's own order of priority
        fields.append(wanted.alias("families"))
        order = "cast(array_position(r.families, x.family) - array_position(r.families, y.family) as int)"
        ordered = f"array_sort(c, (x, y) -> {order})"
    together = let_sql("c[0]", lambda p: _TOGETHER.format(p=p))
    body = f"c -> case size(c) when 0 then r.text when 1 then {together} else {_claimed(ordered, 'r')} end"
    whole = F.expr(f"r -> if(r.text is null or r.base is null, r.text, array_max(transform(array({cuts}), {body})))")
    return F.array_max(F.call_function("transform", F.array(F.struct(*fields)), whole))


def families_by_sourcetype(sourcetype: Column) -> Column:
    """Array of families of a sourcetype column: exact name, else name prefix, else the default.

    The table is a constant of the library (fewer than 200 short entries), held as a map literal.
    """

    def names(families: Sequence[str]) -> str:
        return f"cast(array({', '.join(map(quoted, families))}) as array<string>)"

    exact = ", ".join(f"{quoted(name)}, {names(families)}" for name, families in SOURCETYPE_FAMILIES.items())
    prefixed = " ".join(f"when startswith(s, {quoted(prefix)}) then {names(families)}" for prefix, families in PREFIX_FAMILIES.items())
    chosen = F.expr(f"s -> coalesce(try_element_at(map({exact}), s), case {prefixed} end, {names(DEFAULT_FAMILIES)})")
    return F.array_max(F.call_function("transform", F.array(sourcetype), chosen))


def shift_raw(
    df: DataFrame, text: str, plan: Affine, sourcetype: str | None = None, new: str | None = None
) -> DataFrame:
    """Move the instants in a text column; families follow each row's sourcetype column."""
    kind = None if sourcetype is None else F.col(sourcetype)
    return df.withColumn(new or text, shift_text(F.col(text), plan, DEFAULT_FAMILIES, kind))
