"""Instants inside raw text: one query per notation, and the rules that choose between them.

Each line is written from ``ts`` in Spark, moved by the library, and must equal the line that SQL
writes from the moved ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import instants as I
from tidemark.operators.rawtext import shift_raw, shift_text
from tidemark.plans.text_families import ALL_FAMILIES
from tidemark.queries.registry import (
    BOUNDS_SQL, MILLI_SQL, SECOND_SQL, clock, events, milli, move, moved_sql, query, second, spread, table,
)


def _seconds(us: Column) -> Column:
    return (us / I.SECOND).cast("bigint").cast("string")


def _millis(us: Column) -> Column:
    return (us / 1000).cast("bigint").cast("string")


def _day(us: Column) -> Column:
    return F.lpad(clock(us, "d"), 2, " ")


def _f(us: str, fmt: str) -> str:
    return f"strftime(make_timestamp({us}), '{fmt}')"


_DAY_SQL = "lpad(day(make_timestamp({us}))::VARCHAR, 2, ' ')"
_SEC_SQL = "(({us}) // 1000000)"
_MS_SQL = "trunc(({us}) / 1e6 * 1000.0)::BIGINT"

# family -> (cut before writing, line in Spark, line in SQL)
_LINES = {
    "iso8601": (
        None,
        lambda us: F.concat(clock(us + 19_800 * I.SECOND, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000+0530")),
        lambda us: _f(f"({us}) + 19800000000", "%Y-%m-%dT%H:%M:%S.%f") + " || '000+0530'",
    ),
    "fortigate": (
        second, lambda us: clock(us, "'date='yyyy-MM-dd' time='HH:mm:ss"),
        lambda us: _f(us, "date=%Y-%m-%d time=%H:%M:%S"),
    ),
    "audit": (
        milli,
        lambda us: F.concat(F.lit("audit("), _seconds(us), F.lit("."), clock(us, "SSS"), F.lit(":9407)")),
        lambda us: f"'audit(' || {_SEC_SQL.format(us=us)} || '.' || {_f(us, '%g')} || ':9407)'",
    ),
    "syslog": (
        second, lambda us: F.concat(clock(us, "MMM "), _day(us), clock(us, " HH:mm:ss")),
        lambda us: f"{_f(us, '%b ')} || {_DAY_SQL.format(us=us)} || {_f(us, ' %H:%M:%S')}",
    ),
    "us_date": (
        milli, lambda us: clock(us, "MM/dd/yyyy hh:mm:ss.SSS a"),
        lambda us: _f(us, "%m/%d/%Y %I:%M:%S.%g %p"),
    ),
    "clf": (
        second, lambda us: F.concat(clock(us - 6 * I.HOUR, "'['dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0600]")),
        lambda us: _f(f"({us}) - 21600000000", "[%d/%b/%Y:%H:%M:%S -0600]"),
    ),
    "apache_error": (
        None, lambda us: clock(us, "'['EEE MMM dd HH:mm:ss.SSSSSS yyyy']'"),
        lambda us: _f(us, "[%a %b %d %H:%M:%S.%f %Y]"),
    ),
    "ctime": (
        second, lambda us: F.concat(clock(us, "EEE MMM "), _day(us), clock(us, " HH:mm:ss yyyy"), F.lit(" UTC")),
        lambda us: f"{_f(us, '%a %b ')} || {_DAY_SQL.format(us=us)} || {_f(us, ' %H:%M:%S %Y UTC')}",
    ),
    "panos": (
        second, lambda us: clock(us, "yyyy/MM/dd HH:mm:ss"), lambda us: _f(us, "%Y/%m/%d %H:%M:%S"),
    ),
    "datetime": (
        second, lambda us: clock(us, "yyyy-MM-dd HH:mm:ss"), lambda us: _f(us, "%Y-%m-%d %H:%M:%S"),
    ),
    "compact": (
        second, lambda us: clock(us, "yyyyMMdd HH:mm:ss"), lambda us: _f(us, "%Y%m%d %H:%M:%S"),
    ),
    "epoch_ms": (
        milli, lambda us: F.concat(F.lit('"createdTime": '), _millis(us)),
        lambda us: f"""'"createdTime": ' || {_MS_SQL.format(us=us)}""",
    ),
    "dotnet": (
        milli, lambda us: F.concat(F.lit("/Date("), _millis(us), F.lit(")/")),
        lambda us: f"'/Date(' || {_MS_SQL.format(us=us)} || ')/'",
    ),
    "epoch": (
        second, lambda us: F.concat(F.lit('"timestamp": '), _seconds(us)),
        lambda us: f"""'"timestamp": ' || {_SEC_SQL.format(us=us)}""",
    ),
}
_CUT_SQL = {None: "epoch_us(ts)", second: SECOND_SQL, milli: MILLI_SQL}


def _line(family: str) -> Column:
    cut, write, _ = _LINES[family]
    return write(F.col("us") if cut is None else cut(F.col("us")))


def _moved_line(family: str) -> str:
    cut, _, write = _LINES[family]
    return write(moved_sql(_CUT_SQL[cut]))


def _plain_line(family: str) -> str:
    cut, _, write = _LINES[family]
    return write(_CUT_SQL[cut])


def _register(family: str) -> None:
    sql = f"""
WITH {BOUNDS_SQL}
SELECT event_id, {_moved_line(family)} || ' user ' || user_id || ' {{"k": 1472056400}} ' || {_tail(family)} AS line
FROM events, b"""

    @query(f"raw_text_{family}", sql)
    def build(spark, sf_dir):
        line = F.concat(
            _line(family), F.lit(" user "), F.col("user_id"), F.lit(' {"k": 1472056400} '),
            F.lit("end") if family == "syslog" else _line(family),
        )
        rows = spread(events(spark, sf_dir).select("event_id", "user_id", "us")).select("event_id", line.alias("line"))
        moved = shift_text(F.col("line"), move(spark, sf_dir), ALL_FAMILIES)
        return rows.select("event_id", moved.alias("line"))

    build.__doc__ = f"Lines with instants in the {family} notation, tried against all families."


def _tail(family: str) -> str:
    return "'end'" if family == "syslog" else _moved_line(family)


for _family in ALL_FAMILIES:
    _register(_family)


# what is moved, by sourcetype: a listed one, one found by prefix, one without instants, an unlisted one
_MOVED_BY = {
    "WinEventLog:Custom": ("us_date",),
    "aws:s3:accesslogs": ("clf",),
    "Perfmon:Disk": (),
    "pan:traffic": ("syslog", "panos"),
    "unlisted": ("iso8601", "fortigate", "syslog", "us_date", "epoch", "datetime"),
}
_MIXED = ("syslog", "iso8601", "us_date", "clf", "panos", "datetime", "epoch")


def _mixed_sql() -> str:
    cases = []
    for i, moved in enumerate(_MOVED_BY.values()):
        parts = [_moved_line(f) if f in moved else _plain_line(f) for f in _MIXED]
        cases.append(f"WHEN {i} THEN " + " || ' | ' || ".join(parts))
    return f"WITH {BOUNDS_SQL} SELECT event_id, CASE event_id % {len(_MOVED_BY)} {' '.join(cases)} END AS line FROM events, b"


@query("raw_text_by_sourcetype", _mixed_sql())
def raw_text_by_sourcetype(spark, sf_dir):
    """Only the notations a sourcetype can contain are moved."""
    names = F.array(*[F.lit(n) for n in _MOVED_BY])
    rows = spread(events(spark, sf_dir).select("event_id", "us")).select(
        "event_id",
        F.get(names, F.pmod("event_id", F.lit(len(_MOVED_BY))).cast("int")).alias("sourcetype"),
        F.concat_ws(" | ", *[_line(f) for f in _MIXED]).alias("line"),
    )
    return shift_raw(rows, "line", move(spark, sf_dir), "sourcetype").select("event_id", "line")


@query("raw_text_overlap", f"""
WITH {BOUNDS_SQL} SELECT event_id, 'a ' || {_moved_line('apache_error')} || ' b [Fri Feb 31 10:00:00 2024] c '
  || {_moved_line('fortigate')} || ' d 2024-02-30T10:00:00Z e 99/99/2024 10:00:00 f ' || {_moved_line('datetime')}
  || ' g ' || {_plain_line('epoch').replace('"timestamp": ', '')} AS line FROM events, b""")
def raw_text_overlap(spark, sf_dir):
    """A match inside a claimed one is skipped; one that is not a real instant claims nothing."""
    line = F.concat(
        F.lit("a "), _line("apache_error"), F.lit(" b [Fri Feb 31 10:00:00 2024] c "), _line("fortigate"),
        F.lit(" d 2024-02-30T10:00:00Z e 99/99/2024 10:00:00 f "), _line("datetime"),
        F.lit(" g "), _seconds(second(F.col("us"))),
    )
    rows = spread(events(spark, sf_dir).select("event_id", "us")).select("event_id", line.alias("line"))
    moved = shift_text(F.col("line"), move(spark, sf_dir), ALL_FAMILIES)
    return rows.select("event_id", moved.alias("line"))


_NO_INSTANTS = r"""
SELECT doc_id, md5(text) AS digest FROM documents
"""


@query("raw_text_documents", _NO_INSTANTS)
def raw_text_documents(spark, sf_dir):
    """Whole documents, which hold no instants, come back as they were."""
    moved = shift_text(F.col("text"), move(spark, sf_dir))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(moved).alias("digest"))


@query("raw_text_multi_line", f"""
WITH {BOUNDS_SQL}, l AS (SELECT event_id, {_moved_line('syslog')} || ' id ' || event_id AS line FROM events, b)
SELECT event_id // 50 AS part, string_agg(line, chr(10) ORDER BY event_id) AS text FROM l GROUP BY event_id // 50""")
def raw_text_multi_line(spark, sf_dir):
    """A line-start notation is found at the start of every line of a text (here: of fifty lines)."""
    line = F.concat(_line("syslog"), F.lit(" id "), F.col("event_id"))
    part = F.floor(F.col("event_id") / 50).alias("part")
    rows = events(spark, sf_dir).select(part, F.struct("event_id", line.alias("line")).alias("l"))
    texts = rows.groupBy("part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text")
    )
    return texts.select("part", shift_text(F.col("text"), move(spark, sf_dir), ("syslog",)).alias("text"))
