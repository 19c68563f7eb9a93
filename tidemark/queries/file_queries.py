"""Sources and sinks: the tables are written as files of every format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import manifests as M
from tidemark.functions.timeexpr import moment
from tidemark.plans.pattern_sets import Pattern
from tidemark.queries.field_queries import json_events
from tidemark.queries.registry import (
    BOUNDS_SQL, RUN_TIME, TARGET, TARGET_SQL, clock, events, moved_sql, plan, query, scratch, second, table,
)
from tidemark.replay import Replay, run_profile
from tidemark.sinks.files import write_lines
from tidemark.sources import listing, readers


def _write(df, folder, **options):
    """One folder per event type; rows are written where they are."""
    df.write.partitionBy("event_type").options(**options).text(folder)
    return folder


@query("scan_text", """
SELECT event_id, 'event ' || event_id || ' by ' || user_id || ' é' AS line FROM events WHERE event_id % 10 <> 0""")
def scan_text(spark, sf_dir):
    """Text lines of gzip files; blank lines are left out."""
    line = F.when(F.pmod("event_id", F.lit(10)) == 0, "  ").otherwise(
        F.concat(F.lit("event "), "event_id", F.lit(" by "), "user_id", F.lit(" é"))
    )
    folder = _write(events(spark, sf_dir).select("event_type", line.alias("value")), scratch(spark), compression="gzip")
    rows = readers.read_text(spark, folder, xml_lines="off")
    return rows.select(
        F.regexp_extract("raw", r"^event (\d+)", 1).cast("bigint").alias("event_id"),
        F.try_variant_get(F.col("data")["line"], "$", "string").alias("line"),
    )


@query("scan_json_lines", "SELECT event_id, event_type AS type, 'ok' AS format FROM events WHERE event_id % 97 <> 96")
def scan_json_lines(spark, sf_dir):
    """JSON lines; malformed and non-object lines are dropped."""
    rows = json_events(spark, sf_dir).select("event_type", F.col("raw").alias("value"))
    extra = rows.select("event_type", F.lit("[1,2]").alias("value"))
    folder = _write(rows.unionByName(extra), scratch(spark), compression="bzip2")
    read = readers.read_json_lines(spark, folder)
    return read.select(
        F.try_variant_get(F.col("data")["event_id"], "$", "bigint").alias("event_id"),
        F.try_variant_get(F.col("data")["type"], "$", "string").alias("type"), F.lit("ok").alias("format"),
    )


@query("quarantined_lines", "SELECT event_id FROM events WHERE event_id % 97 = 96")
def quarantined_lines(spark, sf_dir):
    """The lines a reader of JSON lines leaves out: here those cut in half."""
    rows = json_events(spark, sf_dir).select("event_type", F.col("raw").alias("value"))
    bad = readers.quarantine(spark, _write(rows, scratch(spark)))
    return bad.select(F.regexp_extract("raw", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"))


@query("scan_padded_lines", """
SELECT event_id, user_id FROM events""")
def scan_padded_lines(spark, sf_dir):
    """JSON lines with white space of all kinds around them are records like any other."""
    pads = F.array(*map(F.lit, ("", "\t", " \t ", "\u00a0", "\x0b", "\u2003\t")))
    pad = F.element_at(pads, (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    text = F.concat(pad, F.to_json(F.struct("event_id", "user_id")), pad)
    rows = events(spark, sf_dir).select("event_type", text.alias("value"))
    read = readers.read_json_lines(spark, _write(rows, scratch(spark)))
    return read.select(*[F.try_variant_get(F.col("data")[c], "$", "bigint").alias(c) for c in ("event_id", "user_id")])


def _write_documents(documents, folder):
    """A file per row. They lie side by side: a folder for each would have to be made, moved and listed as well."""
    documents.write.option("maxRecordsPerFile", 1).text(folder)


@query("scan_json_documents", "SELECT event_id, user_id FROM events")
def scan_json_documents(spark, sf_dir):
    """Whole-file JSON: arrays (with items that are not objects) and single objects."""
    item = F.to_json(F.struct("event_id", "user_id"))
    # a document holds a hundred events, so that no group grows with the data
    document = F.floor(F.col("event_id") / 100).alias("document")
    grouped = events(spark, sf_dir).groupBy(document).agg(F.collect_list(item).alias("items"))
    several = F.concat(F.lit("[7,"), F.array_join("items", ",\n"), F.lit("]"))
    text = F.when(F.size("items") == 1, F.get("items", 0)).otherwise(several)
    folder = scratch(spark)
    _write_documents(grouped.select(text.alias("value")), folder)
    read = readers.read_json_documents(spark, folder)
    return read.select(*[F.try_variant_get(F.col("data")[c], "$", "bigint").alias(c) for c in ("event_id", "user_id")])


@query("scan_csv", """
SELECT event_id::VARCHAR AS id, 'says "' || event_type || '",' || chr(10) || 'twice' AS note,
       CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS flag FROM events""")
def scan_csv(spark, sf_dir):
    """CSV with quotes, commas and line breaks inside values, and empty values."""
    folder = scratch(spark)
    note = F.concat(F.lit('says "'), "event_type", F.lit('",\ntwice'))
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), note.alias("note"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "").otherwise("x").alias("flag"),
    )
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    data = readers.read_csv(spark, folder, "*.csv")
    return data.select(*[F.try_variant_get(F.col("data")[c], "$", "string").alias(c) for c in ("id", "note", "flag")])


@query("scan_csv_headers", """
SELECT event_id::VARCHAR AS id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS "user",
       CASE WHEN event_id % 2 = 1 THEN 'n' || event_id END AS note FROM events""")
def scan_csv_headers(spark, sf_dir):
    """Files with different headers in one folder, each read by its own."""
    folder = scratch(spark)
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"),
        F.col("user_id").cast("string").alias("user"), F.concat(F.lit("n"), "event_id").alias("note"),
        F.pmod("event_id", F.lit(2)).alias("odd"),
    )
    rows.filter("odd = 0").select("id", "kind", "user").write.option("header", True).csv(f"{folder}/a")
    rows.filter("odd = 1").select("note", "id", "kind").write.option("header", True).csv(f"{folder}/b")
    data = F.col("data")
    read = readers.read_csv(spark, folder, "*.csv")
    return read.select(*[F.try_variant_get(F.try_element_at(data, F.lit(c)), "$", "string").alias(c) for c in ("id", "kind", "user", "note")])


@query("scan_xml", """
SELECT event_id::VARCHAR AS id, event_type AS kind, '["a","b' || user_id || '"]' AS tags FROM events""")
def scan_xml(spark, sf_dir):
    """XML documents: attributes, child text, repeated children as lists."""
    element = F.concat(
        F.lit('<event id="'), "event_id", F.lit('"><kind>'), "event_type",
        F.lit("</kind><tag>a</tag><tag>b"), "user_id", F.lit("</tag></event>"),
    )
    document = F.floor(F.col("event_id") / 100).alias("document")
    grouped = events(spark, sf_dir).groupBy(document).agg(F.collect_list(element).alias("e"))
    text = F.concat(F.lit("<log>\n"), F.array_join("e", "\n"), F.lit("</log>"))
    folder = scratch(spark)
    _write_documents(grouped.select(text.alias("value")), folder)
    read = readers.read_xml(spark, folder, schema="id string, kind string, tag array<string>")
    return read.select(
        *[F.try_variant_get(F.col("data")[c], "$", "string").alias(c) for c in ("id", "kind")],
        F.to_json(F.col("data")["tag"]).alias("tags"),
    )


def _windows_line():
    return F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/>'
              '<EventID>0044</EventID><TimeCreated SystemTime="'),
        clock(F.col("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit('"/><Computer>h'), F.col("user_id"), F.lit('</Computer></System><EventData><Data Name="Id">'),
        F.col("event_id"), F.lit('</Data><Data Name="Empty"></Data><Data Name="Computer">no</Data></EventData></Event>'),
    )


_WINDOWS_SQL = """
SELECT event_id::VARCHAR AS "Id", '0044' AS "EventID", strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
       'h' || user_id AS "Computer", '' AS "Empty", '{"Name":"P"}' AS provider FROM events"""


def _windows(rows):
    names = ("Id", "EventID", "timestamp", "Computer", "Empty")
    return rows.select(
        *[F.try_variant_get(F.col("data")[c], "$", "string").alias(c) for c in names],
        F.to_json(F.col("data")["Provider"]).alias("provider"),
    )


@query("scan_windows_events", _WINDOWS_SQL)
def scan_windows_events(spark, sf_dir):
    """Windows events, one XML line each, flattened in the JVM."""
    rows = events(spark, sf_dir).select("event_type", _windows_line().alias("value"))
    read = readers.read_text(spark, _write(rows, scratch(spark)), xml_lines="windows")
    return _windows(read)


@query("scan_xml_lines", _WINDOWS_SQL)
def scan_xml_lines(spark, sf_dir):
    """The same through the function for free-form XML."""
    rows = events(spark, sf_dir).select("event_type", _windows_line().alias("value"))
    return _windows(readers.read_text(spark, _write(rows, scratch(spark))))


@query("scan_auto", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'jsonl' WHEN 1 THEN 'xml' ELSE 'text' END AS format,
       CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS id FROM events""")
def scan_auto(spark, sf_dir):
    """Format by line."""
    i = F.pmod("event_id", F.lit(3))
    value = (
        F.when(i == 0, F.concat(F.lit('{"id":"'), "event_id", F.lit('"}')))
        .when(i == 1, F.concat(F.lit('<e id="'), "event_id", F.lit('"/>')))
        .otherwise(F.concat(F.lit("{broken "), "event_id"))
    )
    rows = events(spark, sf_dir).select("event_type", value.alias("value"))
    read = readers.read_auto(spark, _write(rows, scratch(spark)))
    return read.select(
        F.regexp_extract("raw", r"(\d+)", 1).cast("bigint").alias("event_id"), "format",
        F.try_variant_get(F.col("data")["id"], "$", "string").alias("id"),
    )


@query("line_numbers", """
SELECT event_id, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) AS line_number FROM events""")
def line_numbers(spark, sf_dir):
    """Line numbers follow the order inside each file; a file has 2,500 events here."""
    folder = scratch(spark)
    part = F.floor(F.col("event_id") / 2500).alias("part")
    rows = events(spark, sf_dir).select(part, "event_id", F.col("event_id").cast("string").alias("value"))
    ordered = rows.repartitionByRange(4, "part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(folder)
    numbered = readers.number_lines(readers.read_lines(spark, folder))
    return numbered.select(F.col("line").cast("bigint").alias("event_id"), "line_number")


@query("file_preview", """
SELECT event_id // 2500 AS part, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) AS line_number,
       left('a long line ' || event_id, 14) AS line FROM events QUALIFY line_number <= 5""")
def file_preview(spark, sf_dir):
    """The first lines of every file, cut to a width."""
    folder = scratch(spark)
    part = F.floor(F.col("event_id") / 2500).alias("part")
    rows = events(spark, sf_dir).select(part, "event_id", F.concat(F.lit("a long line "), "event_id").alias("value"))
    ordered = rows.repartitionByRange(4, "part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(folder)
    shown = readers.preview(spark, folder, 5, 14)
    return shown.select(F.regexp_extract("file_path", r"part=(\d+)", 1).cast("bigint").alias("part"), "line_number", "line")


@query("file_listing", """
SELECT event_id // 2500 AS part, count(*) AS lines, sum(length(event_id::VARCHAR) + 1)::BIGINT AS size,
       event_id // 2500 % 2 = 0 AS ok FROM events GROUP BY event_id // 2500""")
def file_listing(spark, sf_dir):
    """Names, sizes and checksums of files; the digests come from the rows, every other one is wrong."""
    folder = scratch(spark)
    part = F.floor(F.col("event_id") / 2500).alias("part")
    rows = events(spark, sf_dir).select(part, "event_id", F.col("event_id").cast("string").alias("value"))
    ordered = rows.repartitionByRange(4, "part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(folder)
    place = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part")
    files = listing.list_files(spark, folder, "*.txt").select("path", "size", place)
    # a file has 2,500 lines at most
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), "\n"), F.lit("\n"))
    digests = rows.groupBy("part").agg(F.md5(text).alias("md5"), F.count(F.lit(1)).alias("lines"))
    right = F.pmod("part", F.lit(2)) == 0
    declared = F.concat(F.lit("md5:"), F.when(right, F.col("md5")).otherwise(F.reverse("md5")))
    manifest = files.join(digests, "part").select("path", "part", "lines", "size", declared.alias("checksum"))
    checked = listing.verify_checksums(spark, manifest, [folder]).select("path", "ok")
    return manifest.join(checked, "path").select("part", "lines", "size", "ok")


@query("write_by_template", """
SELECT event_id, 'web-' || event_type AS sourcetype, 2025 AS year, 6 AS month, event_type || '.log' AS filename FROM events""")
def write_by_template(spark, sf_dir):
    """Lines written in one folder level per template variable, compressed, and read back."""
    folder = scratch(spark)
    rows = events(spark, sf_dir)
    write_lines(
        rows, F.col("event_id").cast("string"), folder, "{sourcetype}/{year}/{month}/{filename}", RUN_TIME,
        F.concat(F.lit("/in/"), "event_type", F.lit(".log")), F.concat(F.lit("web:"), "event_type"), "gzip",
        files_per_path=2,
    )
    back = spark.read.text(folder)
    return back.select(
        F.col("value").cast("bigint").alias("event_id"), "sourcetype", F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"), "filename",
    )


@query("write_by_literal_template", """
SELECT event_id, 'logs/app-web-' || event_type || '/events-2025-06.jsonl' AS path FROM events""")
def write_by_literal_template(spark, sf_dir):
    """Literal text of a template is part of the path; here every path is one file."""
    folder = scratch(spark)
    rows = events(spark, sf_dir)
    write_lines(
        rows, F.col("event_id").cast("string"), folder, "logs/app-{sourcetype}/events-{year}-{month}.jsonl", RUN_TIME,
        F.lit("x"), F.concat(F.lit("web:"), "event_type"), files_per_path=1,
    )
    back = spark.read.option("recursiveFileLookup", True).text(folder)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(logs/.*)$", 1)
    return back.select(F.col("value").cast("bigint").alias("event_id"), path.alias("path"))


def _log_folder(spark, sf_dir):
    """The events as JSON lines, one folder per type."""
    text = F.to_json(F.struct(
        F.col("event_id").alias("id"), clock(F.col("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(clock(second(F.col("us")), "yyyy-MM-dd HH:mm:ss"), F.lit(" GET")).alias("_raw"),
    ))
    return _write(events(spark, sf_dir).select("event_type", text.alias("value")), scratch(spark))


@query("replay_files", f"""
WITH {BOUNDS_SQL}
SELECT event_id, make_timestamp({moved_sql('epoch_us(ts)')}) AS new_ts,
  strftime(make_timestamp({moved_sql('(epoch_us(ts) // 1000000 * 1000000)')}), '%Y-%m-%d %H:%M:%S') || ' GET' AS raw FROM events, b""")
def replay_files(spark, sf_dir):
    """Read, find the range, move, write, read back: the whole job through the fluent front."""
    out = scratch(spark)
    job = (
        Replay(spark, RUN_TIME).input_source(_log_folder(spark, sf_dir), "jsonl")
        .output_destination(out, "jsonl", "{sourcetype}/{year}")
        .set_timestamp_options(target_time="2025-01-01T06:00:00Z")
    )
    job.run()
    back = readers.read_json_lines(spark, out)
    field = F.col("data")
    return back.select(
        F.try_variant_get(field["id"], "$", "bigint").alias("event_id"),
        F.try_variant_get(field["timestamp"], "$", "string").cast("timestamp").alias("new_ts"),
        F.try_variant_get(field["_raw"], "$", "string").alias("raw"),
    )


@query("replay_statistics", f"""
WITH {BOUNDS_SQL}
SELECT count(*) AS events, count(*) AS events_modified, min(ts) AS original_earliest, max(ts) AS original_latest,
  make_timestamp(min({moved_sql('epoch_us(ts)')})) AS new_earliest, make_timestamp(max({moved_sql('epoch_us(ts)')})) AS new_latest,
  0::BIGINT AS instants_in_future, 0::BIGINT AS instants_at_ceiling FROM events, b""")
def replay_statistics(spark, sf_dir):
    """A dry run: all the work, no output, the numbers."""
    job = (
        Replay(spark, RUN_TIME).input_source(_log_folder(spark, sf_dir), "jsonl")
        .output_destination("unused").set_timestamp_options(target_time="2025-01-01T06:00:00Z")
    )
    return job.run(dry_run=True)


@query("replay_declared_range", f"""
WITH {BOUNDS_SQL}, d AS (SELECT lo + 86400000000 AS lo, hi FROM b)
SELECT event_id, make_timestamp({TARGET_SQL} + epoch_us(ts) - d.lo) AS new_ts FROM events, d""")
def replay_declared_range(spark, sf_dir):
    """A declared range replaces the first pass: here it begins a day after the events do."""
    fixed = plan(spark, sf_dir)
    ends = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    out = scratch(spark)
    job = (
        Replay(spark, RUN_TIME).input_source(_log_folder(spark, sf_dir), "auto", patterns=(Pattern("timestamp"),))
        .output_destination(out, "jsonl", "{sourcetype}").set_timestamp_options(target_time=TARGET)
        .declared_range(moment(fixed.base + 86_400_000_000), moment(ends))
    )
    job.run()
    data = F.col("data")
    return readers.read_json_lines(spark, out).select(
        F.try_variant_get(data["id"], "$", "bigint").alias("event_id"),
        F.try_variant_get(data["timestamp"], "$", "string").cast("timestamp").alias("new_ts"),
    )


@query("read_dataset", """
SELECT CASE event_type WHEN 'click' THEN 'csv' WHEN 'view' THEN 'text' ELSE 'jsonl' END AS format,
       'st:' || event_type AS sourcetype, event_id FROM events""")
def read_dataset(spark, sf_dir):
    """Files of several formats read as one dataset, each by its own reader."""
    folder = scratch(spark)
    rows = events(spark, sf_dir).select("event_type", "event_id", "user_id")
    kind = F.col("event_type")
    json = rows.filter(~kind.isin("click", "view")).select(kind, F.to_json(F.struct("event_id")).alias("value"))
    _write(json, f"{folder}/json")
    _write(rows.filter(kind == "view").select(kind, F.col("event_id").cast("string").alias("value")), f"{folder}/text")
    rows.filter(kind == "click").write.partitionBy("event_type").option("header", True).csv(f"{folder}/csv")
    files = None
    for fmt, sub, glob in (("jsonl", "json", "*.txt"), ("text", "text", "*.txt"), ("csv", "csv", "*.csv")):
        found = listing.list_files(spark, f"{folder}/{sub}", glob).select(
            "path", F.lit(fmt).alias("format"), F.lit("raw").alias("schema"),
            F.concat(F.lit("st:"), F.regexp_extract("path", r"event_type=(\w+)", 1)).alias("sourcetype"),
        )
        files = found if files is None else files.unionByName(found)
    data = F.col("data")
    value = F.coalesce(data["event_id"], data["line"])
    return readers.read_dataset(spark, files).select(
        "format", "sourcetype", F.try_variant_get(value, "$", "string").cast("bigint").alias("event_id")
    )


def _dataset(spark, sf_dir):
    """A folder of log files, a file per event type, and its manifest; returns the folder and the manifest."""
    folder = _log_folder(spark, sf_dir)
    named = listing.list_files(spark, folder, "*.txt").select(
        F.regexp_extract("path", r"(event_type=[^/]*/[^/]*)$", 1).alias("path"), F.lit("jsonl").alias("format"),
        F.concat(F.lit("st:"), F.regexp_extract("path", r"event_type=(\w+)", 1)).alias("sourcetype"),
    )
    # one entry per file, and a reference that a bundled file covers
    text = F.to_json(F.struct(
        F.struct(F.lit("logs").alias("name")).alias("metadata"),
        F.struct(
            F.collect_list(F.struct("path", "format", "sourcetype")).alias("bundled"),
            F.array(F.struct(F.lit("s3://nowhere/x").alias("uri"), F.lit("st:click").alias("sourcetype"))).alias("references"),
        ).alias("files"),
    ))
    place = scratch(spark)
    named.agg(text.alias("value")).coalesce(1).write.text(place)
    return folder, M.read_manifests(spark, place, "*.txt")


@query("dataset_run", f"""
WITH {BOUNDS_SQL}
SELECT event_id, 'st-' || event_type AS sourcetype, make_timestamp({moved_sql('epoch_us(ts)')}) AS new_ts FROM events, b""")
def dataset_run(spark, sf_dir):
    """From a manifest to replayed rows: bundled files are read, covered references are not."""
    folder, manifests = _dataset(spark, sf_dir)
    out = scratch(spark)
    Replay(spark, RUN_TIME).input_dataset(manifests, folder).output_destination(
        out, "jsonl", "{sourcetype}").set_timestamp_options(target_time=TARGET).run()
    data = F.col("data")
    return readers.read_json_lines(spark, out).select(
        F.try_variant_get(data["id"], "$", "bigint").alias("event_id"),
        F.regexp_extract("file_path", r"sourcetype=([^/]*)", 1).alias("sourcetype"),
        F.try_variant_get(data["timestamp"], "$", "string").cast("timestamp").alias("new_ts"),
    )


@query("profile_files", """
SELECT event_type AS dataset, count(*) AS events, count(*) AS events_modified, 2 * count(*) AS written, false AS failed FROM events GROUP BY event_type
UNION ALL SELECT 'missing', NULL, NULL, 0, true""")
def profile_files(spark, sf_dir):
    """A profile over files: two destinations, a plan per dataset, and one dataset that fails."""
    folder, out = _log_folder(spark, sf_dir), scratch(spark)
    kinds = [r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    inputs = {k: lambda job, k=k: job.input_source(f"{folder}/event_type={k}", "jsonl") for k in [*kinds, "missing"]}
    places = [lambda job, n=n: job.output_destination(f"{out}/{n}", "jsonl", "run-{filename}/x.jsonl") for n in ("a", "b")]
    result = run_profile(spark, inputs, places, {"click": {"delta_factor": 0.5}}, {"target_time": TARGET}, RUN_TIME)
    written = spark.read.option("recursiveFileLookup", True).text(out).select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"))
    counts = written.join(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset")), "event_id")
    counts = counts.groupBy("dataset").agg(F.count(F.lit(1)).alias("written"))
    return result.join(counts, "dataset", "left").select(
        "dataset", "events", "events_modified", F.coalesce("written", F.lit(0)).cast("long").alias("written"), F.col("error").isNotNull().alias("failed")
    )


@query("no_output_run", f"""
WITH {BOUNDS_SQL}
SELECT count(*) AS events, make_timestamp(min({moved_sql('epoch_us(ts)')})) AS new_earliest, true AS nothing_written
FROM events, b""")
def no_output_run(spark, sf_dir):
    """A dry run of the whole job: its numbers, and no file where it would have written."""
    out = scratch(spark)
    job = (
        Replay(spark, RUN_TIME).input_source(_log_folder(spark, sf_dir), "jsonl")
        .output_destination(out).set_timestamp_options(target_time=TARGET)
    )
    numbers = job.run(dry_run=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    absent = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return numbers.select("events", "new_earliest", F.lit(absent).alias("nothing_written"))


def _mounted(spark, folder: str) -> str:
    """``folder`` under a mount of Hadoop's view file system: a second scheme, without a server."""
    name = f"m{uuid.uuid4().hex[:8]}"
    spark.conf.set(f"fs.viewfs.mounttable.{name}.link./store", folder if ":" in folder else f"file://{folder}")
    return f"viewfs://{name}/store"


@query("mounted_store", """
SELECT event_type AS part, count(*) AS lines FROM events WHERE event_type <> 'view' GROUP BY event_type""")
def mounted_store(spark, sf_dir):
    """Files listed by a pattern on their names and read through another scheme of Hadoop's file systems."""
    folder = scratch(spark)
    rows = events(spark, sf_dir)
    write_lines(
        rows, F.col("event_id").cast("string"), folder, "in/{sourcetype}/part-{filename}", RUN_TIME,
        F.concat("event_type", F.lit(".log")), F.col("event_type"), files_per_path=2,
    )
    store = _mounted(spark, folder)
    files = listing.list_files(spark, f"{store}/in", "part-[!v]*")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-[!v]*").text(f"{store}/in")
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"))
    found = lines.join(files.select("path"), "path", "left_semi")
    return found.groupBy(F.regexp_extract("path", r"/in/([^/]*)/", 1).alias("part")).agg(F.count(F.lit(1)).alias("lines"))


@query("mounted_write", """
SELECT event_id, event_type AS sourcetype FROM events""")
def mounted_write(spark, sf_dir):
    """Lines written through another scheme, and read back from where it leads."""
    folder = scratch(spark)
    write_lines(
        events(spark, sf_dir), F.col("event_id").cast("string"), f"{_mounted(spark, folder)}/out", "{sourcetype}", RUN_TIME,
        F.lit("x"), F.col("event_type"), "gzip",
    )
    back = spark.read.text(f"{folder}/out")
    return back.select(F.col("value").cast("bigint").alias("event_id"), "sourcetype")
