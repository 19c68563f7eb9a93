"""Instants as microseconds since the epoch: reading text and numbers, printing back.

Everything here works on ``bigint`` microseconds. A value that cannot be read gives NULL, never an
error, so that a bad record can be counted instead of failing the job. The session time zone must
be UTC (see :func:`tidemark.session.require_utc`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.bind import let, whole_div

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
# 0001-01-01T00:00:00 and 9999-12-31T23:59:59.999999
FIRST_MICRO = -62_135_596_800 * SECOND
LAST_MICRO = 253_402_300_800 * SECOND - 1

_PLAIN_ISO = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-](?:0\d|1[0-7]):?[0-5]\d)?\z"
)
# 1 year 2 dash 3 month 4 day 5 hour 6 colon 7 minute 8 second 9 fraction 10 zone
_FULL_ISO = (
    r"^((?!0000)\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:(?s:.)(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?(Z|z|[+-]\d{2}(?::?\d{2})?)?)?\z"
)
# 1 year 2 week 3 day 4 time; 1 year 2 day of the year 3 time
_WEEK_ISO = r"^((?!0000)\d{4})-?W(\d{2})(?:-?(\d))?((?s:.)\d{2}.*)?\z"
_ORDINAL_ISO = r"^((?!0000)\d{4})-?(\d{3})((?s:\D)\d{2}.*)?\z"
_PARTIAL_ISO = r"^(?!0000)\d{4}(?:-\d{2})?\z"
_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*\z"


def in_calendar(us: Column) -> Column:
    """NULL outside the years 1 to 9999."""
    return F.when(us.between(F.lit(FIRST_MICRO), F.lit(LAST_MICRO)), us)


def to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def wall_micros(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.f]`` read as UTC."""
    return let(F.unix_micros(F.concat(text, F.lit("Z")).try_cast("timestamp")), in_calendar)


def offset_micros(zone: Column) -> Column:
    """``Z``, ``+HH``, ``+HHMM`` or ``+HH:MM`` as microseconds; empty or NULL is UTC."""

    def size(digits: Column) -> Column:
        hours = F.left(digits, F.lit(2)).try_cast("bigint")
        minutes = F.right(digits, F.lit(2)).try_cast("bigint")
        return F.when(
            (hours <= 23) & (minutes <= 59), (hours * 60 + minutes) * F.lit(60 * SECOND)
        )

    digits = F.rpad(F.translate(zone, "+-:", ""), 4, "0")
    return F.when(zone.isNull() | zone.isin("", "Z", "z"), F.lit(0).cast("bigint")).otherwise(
        let(digits, size) * F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    )


def _full_iso_micros(text: Column) -> Column:
    # date | hour | minute | second | fraction | zone, parts that are absent are empty
    parts = F.split(F.regexp_replace(text, _FULL_ISO, "$1-$3-$4|$5|$7|$8|$9|$10"), r"\|", -1)

    def read(p: Column) -> Column:
        hour, minute, second = (F.rpad(F.get(p, i), 2, "0") for i in (1, 2, 3))
        fraction = F.rpad(F.substring(F.get(p, 4), 1, 6), 6, "0")
        rest = F.concat(minute, second, F.get(p, 4))
        midnight = (hour == "24") & ~rest.rlike("[1-9]")
        wall = wall_micros(
            F.concat(
                F.get(p, 0), F.lit(" "), F.when(midnight, F.lit("00")).otherwise(hour), F.lit(":"),
                minute, F.lit(":"), second, F.lit("."), fraction,
            )
        )
        extra_day = F.when(midnight, F.lit(DAY)).otherwise(F.lit(0))
        return wall + extra_day - offset_micros(F.get(p, 5))

    return F.when(text.rlike(_FULL_ISO), let(parts, read))


def _week_iso_micros(text: Column) -> Column:
    """``2016-W34``, ``2016W347`` and the like: the day, then the time as in any other text."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _WEEK_ISO, i)

    fourth = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(4))
    week, day = part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(1))
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    valid = week.between(1, 53) & day.between(1, 7)
    return F.when(valid, _full_iso_micros(F.concat(F.date_format(date, "yyyy-MM-dd"), part(4))))


def _ordinal_iso_micros(text: Column) -> Column:
    """``2016-241`` and ``2016241``: the day of the year."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _ORDINAL_ISO, i)

    first = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(1))
    day = part(2).try_cast("int")
    date = F.date_add(first, day - 1)
    valid = (day >= 1) & (F.year(date) == F.year(first))
    return F.when(valid, _full_iso_micros(F.concat(F.date_format(date, "yyyy-MM-dd"), part(3))))


def iso_micros(text: Column) -> Column:
    """ISO 8601 / RFC 3339 text to an instant; a value without a zone is UTC.

    Accepts extended and compact dates, a bare year or year-month, hours alone, any single
    character between date and time, ``24:00`` and any fraction length (cut to microseconds).
    Week dates (``2016-W34-7``) and days of the year (``2016-241``) are read too.
    """

    def read(t: Column) -> Column:
        plain = F.when(t.rlike(_PLAIN_ISO), F.unix_micros(t.try_cast("timestamp")))
        partial = F.when(
            t.rlike(_PARTIAL_ISO),
            wall_micros(F.concat(F.rpad(t, 7, "-01"), F.lit("-01 00:00:00"))),
        )
        week = F.when(t.rlike(_WEEK_ISO), _week_iso_micros(t))
        ordinal = F.when(t.rlike(_ORDINAL_ISO), _ordinal_iso_micros(t))
        return F.coalesce(plain, _full_iso_micros(t), partial, week, ordinal)

    return let(text, read)


def number_in_text(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(_NUMBER), F.trim(t).try_cast("double")))


def epoch_micros(seconds: Column) -> Column:
    """Fractional epoch seconds (double) to microseconds, fraction rounded half to even."""
    limit = F.lit(float(LAST_MICRO // SECOND))
    low = F.lit(float(FIRST_MICRO // SECOND))

    def split(s: Column) -> Column:
        whole = F.when(s < 0, F.ceil(s)).otherwise(F.floor(s))
        return whole * F.lit(SECOND) + F.rint((s - whole) * F.lit(1e6)).cast("bigint")

    return let(seconds, lambda s: F.when(s.between(low, limit), split(s)))


def epoch_millis_micros(millis: Column) -> Column:
    return epoch_micros(millis / F.lit(1000.0))


# ---------------------------------------------------------------------------------------------
# strftime patterns

# Directive -> date pattern letters (first where a digit follows, else second).
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"), "m": ("MM", "M"), "d": ("dd", "d"), "H": ("HH", "H"), "I": ("hh", "h"),
    "M": ("mm", "m"), "S": ("ss", "s"), "f": ("SSSSSS", "SSSSSS"), "j": ("DDD", "D"),
    "y": ("yy", "yy"), "b": ("MMM", "MMM"), "h": ("MMM", "MMM"), "B": ("MMMM", "MMMM"),
    "a": ("EEE", "EEE"), "A": ("EEEE", "EEEE"), "p": ("a", "a"),
}
_SHORTHAND = {"T": "%H:%M:%S", "D": "%m/%d/%y", "F": "%Y-%m-%d", "R": "%H:%M"}
_NUMERIC = set("YmdHIMSfjy")


def date_pattern(strftime: str, for_parsing: bool = False) -> str:
    """Translate a strftime pattern once, on the driver."""
    for short, longer in _SHORTHAND.items():
        strftime = strftime.replace(f"%{short}", longer)
    tokens: list[tuple[str, str]] = []
    i = 0
    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            tokens.append(("%", strftime[i + 1]))
            i += 2
        else:
            tokens.append(("", strftime[i]))
            i += 1
    out: list[str] = []
    literal = ""

    def flush() -> None:
        nonlocal literal
        if literal:
            plain = not re.search(r"[A-Za-z\[\]{}#']", literal)
            out.append(literal if plain else "'" + literal.replace("'", "''") + "'")
        literal = ""

    for pos, (kind, char) in enumerate(tokens):
        if not kind or char == "%":
            literal += char
            continue
        flush()
        if char == "z":
            out.append("[XXX][XX]" if for_parsing else "xx")
            continue
        if char not in _DIRECTIVES:
            raise ValueError(f"unsupported directive %{char} in {strftime!r}")
        if for_parsing and char in "aA":
            continue
        fixed, free = _DIRECTIVES[char]
        neighbours = tokens[max(pos - 1, 0):pos] + tokens[pos + 1:pos + 2]
        tight = any(k and c in _NUMERIC for k, c in neighbours)
        out.append(free if for_parsing and not tight else fixed)
    flush()
    return "".join(out)


_DAY_NAME = r"(?i)\b(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b"


def strptime_micros(text: Column, strftime: str) -> Column:
    """Text to an instant by a strftime pattern; names of days are passed over."""
    pattern = date_pattern(strftime, for_parsing=True)
    if "%a" in strftime or "%A" in strftime:
        text = F.regexp_replace(text, _DAY_NAME, "")
    squeezed = F.regexp_replace(text, r"\s+", " ")
    return let(F.unix_micros(F.try_to_timestamp(squeezed, F.lit(pattern))), in_calendar)


# Layouts tried, in order, for free-form date text that is not ISO.
AUTO_LAYOUTS = (
    "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M:%S.%f", "%Y/%m/%d",
    "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S.%f", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y",
    "%d/%b/%Y:%H:%M:%S %z", "%d/%b/%Y %H:%M:%S",
    "%d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S %z", "%b %d %Y %H:%M:%S", "%b %d, %Y %H:%M:%S",
    "%b %d, %Y %I:%M:%S %p", "%d %B %Y %H:%M:%S", "%B %d, %Y %H:%M:%S", "%B %d, %Y", "%d %b %Y",
    "%Y-%m-%d %H:%M:%S %z",
)


def auto_micros(text: Column) -> Column:
    """Free-form date text: ISO first, then a declared list of layouts.

    A leading weekday and a trailing ``GMT`` / ``UTC`` are ignored; ``ctime`` text is reordered.
    """
    bare = F.regexp_replace(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    bare = F.regexp_replace(bare, r"\s+(?:GMT|UTC|Z)\z", "")
    bare = F.regexp_replace(
        bare, r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})\z", "$1 $2 $4 $3"
    )
    free = let(bare, lambda t: F.coalesce(*[strptime_micros(t, f) for f in AUTO_LAYOUTS]))
    return F.coalesce(iso_micros(F.trim(text)), F.when(text.isNotNull(), free))


# ---------------------------------------------------------------------------------------------
# printing

# Format names and their synonyms.
EPOCH_SECONDS = {"unix_seconds", "unix_s"}
EPOCH_MILLIS = {"unix_millis", "unix_ms"}
ISO_NAMES = {"iso8601", "rfc3339"}


def fraction_digits(us: Column) -> Column:
    """The six digits after the second."""
    return F.lpad(F.pmod(us, F.lit(SECOND)).cast("string"), 6, "0")


def iso_text(us: Column, zone_offset: int = 0) -> Column:
    """ISO text with ``+HH:MM``; the fraction is printed only when it is not zero."""
    local = us + F.lit(zone_offset)
    sign = "+" if zone_offset >= 0 else "-"
    minutes = abs(zone_offset) // (60 * SECOND)
    zone = f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"
    return F.concat(
        F.date_format(F.timestamp_micros(local), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.pmod(us, F.lit(SECOND)) == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), fraction_digits(us))
        ),
        F.lit(zone),
    )


def epoch_seconds_text(us: Column) -> Column:
    return whole_div(us, F.lit(SECOND)).cast("string")


def epoch_millis(us: Column) -> Column:
    """Whole milliseconds as printed from a double of seconds (truncated)."""
    return (us.cast("double") / F.lit(1e6) * F.lit(1000.0)).cast("bigint")


def format_micros(us: Column, fmt: str = "iso8601") -> Column:
    if fmt in ISO_NAMES or fmt == "auto":
        return iso_text(us)
    if fmt in EPOCH_SECONDS:
        return epoch_seconds_text(us)
    if fmt in EPOCH_MILLIS:
        return epoch_millis(us).cast("string")
    return F.date_format(F.timestamp_micros(us), date_pattern(fmt))
