"""Reading, printing and moving the instants of structured records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import instants as I
from tidemark.functions.paths import output_path
from tidemark.functions.values import Value, epoch_of, read_instant
from tidemark.operators import extract as X
from tidemark.operators.errors import split_errors
from tidemark.operators.writeback import (
    as_json, as_line, json_array_lines, put_instants, put_matched, shift_records,
)
from tidemark.plans.pattern_sets import BRONZE, GENERIC, Pattern, ocsf
from tidemark.queries.registry import (
    BOUNDS_SQL, MILLI_SQL, RUN_TIME, SECOND_SQL, clock, events, milli, move, moved_sql,
    query, second, table,
)

def _id(n: int):
    return F.pmod("event_id", F.lit(n))


def _text(col) -> Value:
    return Value(text=col)


@query("parse_iso", f"""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN make_timestamp({MILLI_SQL})
  WHEN 3 THEN make_timestamp({SECOND_SQL}) WHEN 4 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('day', ts)
  WHEN 7 THEN make_timestamp({SECOND_SQL}) ELSE NULL END AS parsed FROM events""")
def parse_iso(spark, sf_dir):
    """ISO text with and without zone, fractions of any length, compact, week and ordinal dates, and junk."""
    us = F.col("us")
    day = F.timestamp_micros(us)
    # the year of the week is that of its Thursday
    week_year = F.year(F.date_add(day.cast("date"), 3 - F.weekday(day)))
    week = F.concat(week_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), F.weekday(day) + 1)
    text = (
        F.when(_id(8) == 0, clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(_id(8) == 1, F.concat(clock(us - 6 * I.HOUR, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000-0600")))
        .when(_id(8) == 2, F.concat(clock(us + 5 * I.HOUR, "yyyyMMdd'T'HHmmss.SSS"), F.lit("+05")))
        .when(_id(8) == 3, clock(us, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(_id(8) == 4, clock(us, "yyyyMMdd"))
        .when(_id(8) == 6, week)
        .when(_id(8) == 7, clock(us, "yyyy-DDD'T'HH:mm:ss'Z'"))
        .otherwise(F.concat(F.lit("at "), clock(us, "yyyy-MM-dd HH:mm:ss")))
    )
    return events(spark, sf_dir).select("event_id", X.iso_of(text).alias("parsed"))


@query("parse_epoch_seconds", f"""
SELECT event_id, ts AS from_number, make_timestamp({SECOND_SQL}) AS from_text, NULL::TIMESTAMP AS from_junk
FROM events""")
def parse_epoch_seconds(spark, sf_dir):
    seconds = F.col("us") / F.lit(1e6)
    number = Value(number=seconds)
    text = _text((second(F.col("us")) / 1_000_000).cast("bigint").cast("string"))
    junk = _text(F.concat(F.col("us").cast("string"), F.lit("d")))
    return events(spark, sf_dir).select(
        "event_id",
        *[F.timestamp_micros(read_instant(v, "unix_seconds")).alias(n)
          for n, v in (("from_number", number), ("from_text", text), ("from_junk", junk))],
    )


@query("parse_epoch_millis", f"""
SELECT event_id, make_timestamp({MILLI_SQL}) AS from_number, make_timestamp({MILLI_SQL}) AS from_text FROM events""")
def parse_epoch_millis(spark, sf_dir):
    ms = (milli(F.col("us")) / 1000).cast("bigint")
    number = Value(number=ms.cast("double"))
    return events(spark, sf_dir).select(
        "event_id",
        F.timestamp_micros(read_instant(number, "unix_ms")).alias("from_number"),
        F.timestamp_micros(read_instant(_text(ms.cast("string")), "unix_millis")).alias("from_text"),
    )


@query("parse_strptime", f"""
SELECT event_id, make_timestamp({SECOND_SQL}) AS us_style, ts AS dotted, make_timestamp({SECOND_SQL}) AS zoned,
       NULL::TIMESTAMP AS wrong FROM events""")
def parse_strptime(spark, sf_dir):
    us = F.col("us")
    return events(spark, sf_dir).select(
        "event_id",
        F.timestamp_micros(I.strptime_micros(clock(us, "MM/dd/yyyy hh:mm:ss a"), "%m/%d/%Y %I:%M:%S %p")).alias("us_style"),
        F.timestamp_micros(I.strptime_micros(clock(us, "dd.MM.yyyy HH:mm:ss.SSSSSS"), "%d.%m.%Y %H:%M:%S.%f")).alias("dotted"),
        F.timestamp_micros(I.strptime_micros(clock(us, "dd/MMM/yyyy:HH:mm:ss' +0000'"), "%d/%b/%Y:%H:%M:%S %z")).alias("zoned"),
        F.timestamp_micros(I.strptime_micros(clock(us, "yyyy-MM-dd"), "%d/%m/%Y")).alias("wrong"),
    )


@query("parse_auto", f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts ELSE make_timestamp({SECOND_SQL}) END AS parsed FROM events""")
def parse_auto(spark, sf_dir):
    """Free-form date text in the declared layouts."""
    us = F.col("us")
    text = (
        F.when(_id(5) == 0, clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
        .when(_id(5) == 1, clock(us, "yyyy/MM/dd HH:mm:ss"))
        .when(_id(5) == 2, clock(us, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(_id(5) == 3, clock(us, "EEE MMM d HH:mm:ss yyyy"))
        .otherwise(clock(us, "MM/dd/yyyy hh:mm:ss a"))
    )
    return events(spark, sf_dir).select("event_id", F.timestamp_micros(I.auto_micros(text)).alias("parsed"))


_ISO_SQL = """(strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN ''
  ELSE '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') END || '+00:00')"""


def iso_sql(us: str) -> str:
    return _ISO_SQL.format(f"make_timestamp({us})")


@query("format_instants", f"""
SELECT event_id, {iso_sql('epoch_us(ts)')} AS iso, {iso_sql(SECOND_SQL)} AS iso_whole,
       (epoch_us(ts) // 1000000)::VARCHAR AS seconds,
       trunc(epoch_us(ts) / 1e6 * 1000.0)::BIGINT::VARCHAR AS millis,
       strftime(ts, '%d/%b/%Y %I:%M:%S %p') AS custom FROM events""")
def format_instants(spark, sf_dir):
    us = F.col("us")
    return events(spark, sf_dir).select(
        "event_id", I.iso_text(us).alias("iso"), I.iso_text(second(us)).alias("iso_whole"),
        I.format_micros(us, "unix_seconds").alias("seconds"),
        I.format_micros(us, "unix_millis").alias("millis"),
        I.format_micros(us, "%d/%b/%Y %I:%M:%S %p").alias("custom"),
    )


@query("to_epoch", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN ({SECOND_SQL} // 1000000)::DOUBLE
  WHEN 2 THEN {MILLI_SQL} / 1e6 ELSE NULL END AS epoch FROM events""")
def to_epoch(spark, sf_dir):
    """Epoch seconds of a number, numeric text, ISO text, or nothing."""
    us = F.col("us")
    number = F.when(_id(4) == 0, us / F.lit(1e6))
    text = (
        F.when(_id(4) == 1, (second(us) / 1_000_000).cast("bigint").cast("string"))
        .when(_id(4) == 2, clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(_id(4) == 3, F.lit("soon"))
    )
    return events(spark, sf_dir).select(
        "event_id", epoch_of(Value(text, number)).alias("epoch")
    )


# ---------------------------------------------------------------------------------------------
# records as JSON text


def json_events(spark, sf_dir):
    """Events as JSON text: four notations of ``_time``, a nested instant, a raw line, a number.

    Every 97th text is cut in half.
    """
    us = F.col("us")
    time = (
        F.when(_id(4) == 0, clock(us, "'\"'yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z\"'"))
        .when(_id(4) == 1, clock(us + 2 * I.HOUR, "'\"'yyyy-MM-dd'T'HH:mm:ss'+02:00\"'"))
        .when(_id(4) == 2, (second(us) / 1_000_000).cast("bigint").cast("string"))
        .otherwise(F.concat(F.lit('"'), (second(us) / 1_000_000).cast("bigint").cast("string"), F.lit('"')))
    )
    text = F.concat(
        F.lit('{"event_id":'), F.col("event_id"), F.lit(',"_time":'), time,
        F.lit(',"meta":{"created":"'), clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit('","tags":[1,"x"]},"type":"'), F.col("event_type"),
        F.lit('","_raw":"'), clock(us, "yyyy-MM-dd HH:mm:ss"), F.lit(" user "), F.col("user_id"),
        F.lit(' in"}'),
    )
    cut = F.when(_id(97) == 96, F.left(text, (F.length(text) / 2).cast("int"))).otherwise(text)
    return events(spark, sf_dir).withColumn("raw", cut)


_PATTERNS = (*BRONZE, Pattern("meta.created"))
# the instant that ``_time`` holds
_TIME_SQL = f"CASE event_id % 4 WHEN 0 THEN epoch_us(ts) ELSE {SECOND_SQL} END"


def records(spark, sf_dir):
    rows = json_events(spark, sf_dir)
    parsed = F.explode(F.array_compact(F.array(X.json_object(F.col("raw")))))
    return rows.withColumn("data", parsed)


@query("nested_field", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::VARCHAR AS absent, event_type AS type FROM events
WHERE event_id % 97 <> 96""")
def nested_field(spark, sf_dir):
    """Fields by dotted path; a step that is missing gives NULL."""
    props = X.map_reader(X.json_object(F.col("props")))
    read = X.map_reader(F.col("data"))
    return records(spark, sf_dir).select(
        "event_id", props("k").number.cast("bigint").alias("k"),
        read("meta.created.deeper").text.alias("absent"), read("type").text.alias("type"),
    )


@query("extract_fields", f"""
SELECT event_id, make_timestamp({_TIME_SQL}) AS time, make_timestamp({MILLI_SQL}) AS created,
       2::INT AS fields FROM events WHERE event_id % 97 <> 96""")
def extract_fields(spark, sf_dir):
    """Instants by an ordered pattern list, parsed from the named fields only."""
    rows, read = X.json_fields(json_events(spark, sf_dir), "raw", _PATTERNS)
    found = X.extract(rows.filter("is_object"), read, _PATTERNS)
    stamps = F.col("timestamps")
    return found.select(
        "event_id", stamps["_time"].alias("time"), stamps["meta.created"].alias("created"),
        F.size(stamps).alias("fields"),
    )


@query("extract_generic", f"""
SELECT event_id, make_timestamp({_TIME_SQL}) AS time, 1::INT AS fields FROM events WHERE event_id % 97 <> 96""")
def extract_generic(spark, sf_dir):
    """The generic set; the last reading of a field that succeeds counts."""
    found = X.extract(records(spark, sf_dir), X.map_reader(F.col("data")), GENERIC)
    return found.select(
        "event_id", F.col("timestamps")["_time"].alias("time"), F.size("timestamps").alias("fields")
    )


@query("extract_bronze", f"""
SELECT event_id, make_timestamp({_TIME_SQL}) AS time, event_type AS source FROM events""")
def extract_bronze(spark, sf_dir):
    rows = json_events(spark, sf_dir).withColumn("data", F.create_map(
        F.lit("_time"), F.when(_id(4) == 0, clock(F.col("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").cast("variant"))
        .otherwise((second(F.col("us")) / 1_000_000).cast("bigint").cast("variant")),
        F.lit("_source"), F.col("event_type").cast("variant"), F.lit("other"), F.lit(1).cast("variant"),
    ))
    found = X.extract(rows, X.map_reader(F.col("data")), BRONZE)
    meta = X.record_metadata(F.col("data"), "lakehouse_bronze")
    return found.select(
        "event_id", F.col("timestamps")["_time"].alias("time"),
        F.try_variant_get(F.element_at(F.map_values(meta), 1), "$", "string").alias("source"),
    )


@query("extract_ocsf", f"""
SELECT event_id, make_timestamp({MILLI_SQL}) AS time, make_timestamp({MILLI_SQL} + 1000000) AS end_time,
       'class_uid,severity' AS metadata FROM events""")
def extract_ocsf(spark, sf_dir):
    ms = (milli(F.col("us")) / 1000).cast("bigint")
    rows = events(spark, sf_dir).withColumn("data", F.create_map(
        F.lit("time"), ms.cast("variant"), F.lit("end_time"), (ms + 1000).cast("string").cast("variant"),
        F.lit("class_uid"), F.lit(1001).cast("variant"), F.lit("severity"), F.lit("Low").cast("variant"),
        F.lit("start_time"), F.lit("soon").cast("variant"),
    ))
    found = X.extract(rows, X.map_reader(F.col("data")), ocsf())
    meta = F.array_join(F.array_sort(F.map_keys(X.record_metadata(F.col("data"), "ocsf"))), ",")
    return found.select(
        "event_id", F.col("timestamps")["time"].alias("time"),
        F.col("timestamps")["end_time"].alias("end_time"), meta.alias("metadata"),
    )


_SOURCETYPES = ("aws:cloudtrail", "OSQUERY:Results", "auditd", "unlisted")


@query("extract_by_sourcetype", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'eventTime' WHEN 1 THEN 'unixTime' WHEN 2 THEN 'line' ELSE 'eventTime' END AS field,
  CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN make_timestamp({SECOND_SQL}) WHEN 2 THEN make_timestamp({MILLI_SQL})
    ELSE ts END AS found FROM events""")
def extract_by_sourcetype(spark, sf_dir):
    """Registered patterns are tried only on rows of their sourcetype, before the generic set."""
    us = F.col("us")
    line = F.concat(F.lit("type=X msg=audit("), F.format_string("%.3f", milli(us) / F.lit(1e6)), F.lit(":77)"))
    rows = events(spark, sf_dir).select(
        "event_id",
        F.element_at(F.array(*map(F.lit, _SOURCETYPES)), _id(4).cast("int") + 1).alias("sourcetype"),
        F.create_map(
            F.lit("eventTime"), F.when(_id(4).isin(0, 3), clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).cast("variant"),
            F.lit("unixTime"), (second(us) / 1_000_000).cast("bigint").cast("variant"),
            F.lit("line"), line.cast("variant"),
        ).alias("data"),
    )
    read = X.extract_by_sourcetype(rows, X.map_reader(F.col("data")), F.col("sourcetype"))
    entries = F.map_entries("timestamps")
    return read.select(
        "event_id", F.get(entries, 0)["key"].alias("field"), F.get(entries, 0)["value"].alias("found")
    )


@query("base_instant", f"""
SELECT event_id, make_timestamp(CASE WHEN event_id % 3 = 0 THEN {MILLI_SQL} ELSE epoch_us(ts) END) AS base,
       make_timestamp({MILLI_SQL} - 60000000) AS earliest FROM events""")
def base_instant(spark, sf_dir):
    """A base field if it has a value, else a preferred one, else the earliest."""
    us = F.col("us")
    stamps = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("a").alias("k"), F.when(_id(3) == 0, F.timestamp_micros(milli(us))).alias("v")),
        F.struct(F.lit("b").alias("k"), F.col("ts").alias("v")),
        F.struct(F.lit("c").alias("k"), F.timestamp_micros(milli(us) - 60_000_000).alias("v")),
    ), lambda e: e["v"].isNotNull()))
    return events(spark, sf_dir).select(
        "event_id", X.base_instant(stamps, [Pattern("a", is_base=True)], "b").alias("base"),
        X.base_instant(stamps, [Pattern("z", is_base=True)]).alias("earliest"),
    )


@query("regex_field", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ({SECOND_SQL} // 1000000)::VARCHAR END AS matched
FROM events""")
def regex_field(spark, sf_dir):
    line = F.when(_id(5) == 0, F.lit("nothing here")).otherwise(
        F.concat(F.lit("msg=audit("), (second(F.col("us")) / 1_000_000).cast("bigint").cast("string"), F.lit(":1)"))
    )
    return events(spark, sf_dir).select("event_id", X.regex_field(line, r"audit\((\d+):").alias("matched"))


@query("instants_in_text", f"""
SELECT event_id, 3::INT AS n, ts AS first, make_timestamp({SECOND_SQL}) AS second, ts AS third FROM events""")
def instants_in_text(spark, sf_dir):
    """All instants in free text: ISO, ten-digit epoch, RFC 3339; unreadable matches are left out."""
    us = F.col("us")
    text = F.concat(
        F.lit("at "), clock(us, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" and 2024-13-45 10:00:00 id "),
        (second(us) / 1_000_000).cast("bigint").cast("string"), F.lit(" 12345678901 end"),
    )
    found = X.instants_in_text(text)
    return events(spark, sf_dir).select("event_id", found.alias("f")).select(
        "event_id", F.size("f").alias("n"), F.get("f", 0).alias("first"),
        F.get("f", 1).alias("second"), F.get("f", 2).alias("third"),
    )


_DOC_ISO = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"


@query("instants_in_documents", """
SELECT doc_id, len(regexp_extract_all(text, '\\b\\d{10}\\b'))::INT AS n_epoch, n_chars FROM documents""")
def instants_in_documents(spark, sf_dir):
    """Ten-digit epochs in whole documents."""
    found = X.instants_in_text(F.col("text"), X.TEXT_EXPRESSIONS[1:2])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_epoch"), "n_chars")


@query("valid_records", """
SELECT event_type, count(*) FILTER (event_id % 4 < 2) AS bronze, count(*) FILTER (event_id % 3 = 0) AS ocsf,
       count(*) AS raw FROM events GROUP BY event_type""")
def valid_records(spark, sf_dir):
    """Records that have a field their schema requires."""
    names = F.when(_id(4) == 0, "_time").when(_id(4) == 1, "_event_time").otherwise("other")
    uid = F.when(_id(3) == 0, "class_uid").otherwise("none")
    data = F.create_map(names, F.lit(1).cast("variant"), uid, F.lit(2).cast("variant"))
    rows = events(spark, sf_dir).withColumn("data", data)
    return rows.groupBy("event_type").agg(
        F.count_if(X.is_valid(F.col("data"), "lakehouse_bronze")).alias("bronze"),
        F.count_if(X.is_valid(F.col("data"), "ocsf")).alias("ocsf"),
        F.count_if(X.is_valid(F.col("data"), "raw")).alias("raw"),
    )


@query("bad_records", """
SELECT event_type, count(*) FILTER (event_id % 97 <> 96) AS good, count(*) FILTER (event_id % 97 = 96) AS bad
FROM events GROUP BY event_type""")
def bad_records(spark, sf_dir):
    """Malformed JSON is marked, counted and kept apart."""
    marked = split_errors(json_events(spark, sf_dir), "raw")
    return marked.groupBy("event_type").agg(
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count_if(F.col("error").isNotNull()).alias("bad"),
    )


# ---------------------------------------------------------------------------------------------
# writing back

_NEW_TIME = moved_sql(_TIME_SQL)
_NEW_CREATED = moved_sql(MILLI_SQL)
_REPLAYED_SQL = f"""
'{{"event_id":' || event_id || ',"_time":"' || {iso_sql(_NEW_TIME)} || '","meta":{{"created":"'
|| {iso_sql(_NEW_CREATED)} || '","tags":[1,"x"]}},"type":"' || event_type || '","_raw":"'
|| strftime(make_timestamp({moved_sql(SECOND_SQL)}), '%Y-%m-%d %H:%M:%S') || ' user ' || user_id || ' in"}}'"""


@query("replay_json", f"""
WITH {BOUNDS_SQL} SELECT event_id, {_REPLAYED_SQL} AS line FROM events, b WHERE event_id % 97 <> 96""")
def replay_json(spark, sf_dir):
    """JSON records end to end: parse, find instants, move, write back fields and raw text, print."""
    moved = shift_records(
        records(spark, sf_dir), X.map_reader(F.col("data")), _PATTERNS, move(spark, sf_dir)
    )
    # keys of an object inside the record are printed in their sorted order
    return moved.select("event_id", as_json(F.col("data")).alias("line"))


@query("replay_json_numbers", f"""
WITH {BOUNDS_SQL} SELECT event_id, CASE WHEN event_id % 2 = 0
  THEN '{{"ts":' || ({moved_sql(MILLI_SQL)} // 1000) || ',"n":7}}'
  ELSE '{{"ts":"' || {iso_sql(moved_sql(MILLI_SQL))} || '","n":7}}' END AS line FROM events, b""")
def replay_json_numbers(spark, sf_dir):
    """Numbers stay numbers with ``keep_encoding``; text becomes ISO text."""
    ms = (milli(F.col("us")) / 1000).cast("bigint")
    value = F.when(_id(2) == 0, ms.cast("variant")).otherwise(ms.cast("string").cast("variant"))
    rows = events(spark, sf_dir).withColumn(
        "data", F.create_map(F.lit("ts"), value, F.lit("n"), F.lit(7).cast("variant"))
    )
    moved = shift_records(
        rows, X.map_reader(F.col("data")), [Pattern("ts", "unix_millis")], move(spark, sf_dir),
        keep_encoding=True,
    )
    return moved.select("event_id", as_json(F.col("data")).alias("line"))


@query("put_missing_parent", f"""
SELECT event_id, '{{"a":1,"x":{{"y":"' || {iso_sql('epoch_us(ts)')} || '"}}}}' AS line FROM events""")
def put_missing_parent(spark, sf_dir):
    """A field may be written to another path, whose parents are created."""
    data = F.create_map(F.lit("a"), F.lit(1).cast("variant"))
    found = [X.Found("t", F.col("us"))]
    put = put_instants(F.col("data"), found, paths={"t": "x.y"})
    rows = events(spark, sf_dir).withColumn("data", data)
    return rows.select("event_id", as_json(put).alias("line"))


@query("replay_regex_field", f"""
WITH {BOUNDS_SQL}, x AS (SELECT event_id, {moved_sql(MILLI_SQL)} AS us FROM events, b),
m AS (SELECT event_id, us // 1000 + CASE WHEN us % 1000 > 500 OR (us % 1000 = 500 AND us // 1000 % 2 = 1)
  THEN 1 ELSE 0 END AS ms FROM x)
SELECT event_id, 'type=X msg=audit(' || (ms // 1000) || '.' || lpad((ms % 1000)::VARCHAR, 3, '0')
  || ':9) and msg=audit(1.000:9)' AS line FROM m""")
def replay_regex_field(spark, sf_dir):
    """Only the first occurrence of the match is replaced; decimals of the epoch are kept."""
    us = F.col("us")
    old = F.format_string("%.3f", milli(us) / F.lit(1e6))
    line = F.concat(F.lit("type=X msg=audit("), old, F.lit(":9) and msg=audit(1.000:9)"))
    new = move(spark, sf_dir)(milli(us))
    return events(spark, sf_dir).select(
        "event_id", put_matched(line, new, "unix_seconds", old).alias("line")
    )


@query("records_as_lines", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'line ' || event_id WHEN 1 THEN 'raw ' || event_id
  ELSE '{"a":' || event_id || '}' END AS line FROM events""")
def records_as_lines(spark, sf_dir):
    """Text output: the line field, else the text as read, else the object."""
    key = F.when(_id(3) == 0, "line").otherwise("a")
    value = F.when(_id(3) == 0, F.concat(F.lit("line "), "event_id").cast("variant")).otherwise(
        F.col("event_id").cast("variant")
    )
    raw = F.when(_id(3) == 1, F.concat(F.lit("raw "), "event_id"))
    rows = events(spark, sf_dir).select("event_id", F.create_map(key, value).alias("data"), raw.alias("raw"))
    return rows.select("event_id", as_line(F.col("data"), F.col("raw")).alias("line"))


@query("json_array_per_file", """
SELECT event_id // 100 AS file, row_number() OVER w - 1 AS place,
  CASE WHEN row_number() OVER w = 1 THEN '[' ELSE '' END || '{"id":' || event_id || '}'
  || CASE WHEN lead(event_id) OVER w IS NULL THEN ']' ELSE ',' END AS line
FROM events WINDOW w AS (PARTITION BY event_id // 100 ORDER BY event_id)""")
def json_arrays(spark, sf_dir):
    """Batch JSON: the lines of one array per file (here: a hundred events)."""
    rows = events(spark, sf_dir).select(
        F.floor(F.col("event_id") / 100).alias("file"), "event_id",
        F.to_json(F.struct(F.col("event_id").alias("id"))).alias("r"),
    )
    return json_array_lines(rows, "file", "event_id", "r")


@query("output_paths", r"""
SELECT event_id, 'out/' || CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'win-log-' || event_type ELSE 'a-b-c' END
  || '/2025/06/01/12-00/part-' || user_id || '.jsonl.gz' AS path FROM events""")
def output_paths(spark, sf_dir):
    sourcetype = F.when(_id(3) == 1, F.concat(F.lit("win:log/"), "event_type")).when(_id(3) == 2, F.lit("a\\b:c"))
    name = F.concat(F.lit("/in/dir/part-"), "user_id", F.lit(".jsonl"))
    template = "out/{sourcetype}/{year}/{month}/{day}/{hour}-{minute}/{filename}"
    return events(spark, sf_dir).select(
        "event_id", output_path(template, name, sourcetype, RUN_TIME, "gzip").alias("path")
    )
