"""Readers, sinks, the fluent front, catalog files and the stream, on files written here."""

import bz2
import gzip
import hashlib
import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import manifests as M
from tidemark.functions.paths import output_path
from tidemark.functions.timeexpr import micros
from tidemark.functions.xmltext import _SYSTEM_ATTRIBUTES, windows_event
from tidemark.operators.bounds import NoTimestampsError
from tidemark.operators.dependencies import dependency_closure
from tidemark.operators.lookups import merged_settings
from tidemark.plans.pattern_sets import Pattern
from tidemark.plans.shift_plan import ShiftPlan
from tidemark.replay import Replay
from tidemark.sinks import files
from tidemark.sinks.files import print_lines, write_lines
from tidemark.sources import blocks, listing, readers
from tidemark.streaming import replay_stream
from tidemark.streaming.replay_stream import shift_lines, stream_lines

RUN = datetime(2025, 6, 1, 12)


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want = set()
    for name in ("a.log", "b.log", "c.log"):
        lines = ["" if rng.random() < 0.2 else f"{name} {i} " + "x" * rng.randrange(60) for i in range(2000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, i + 1, line) for i, line in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = {(r.file_name, r.line_number, r.line) for r in readers.number_lines(lines).collect()}
        shown = readers.preview(spark, str(tmp_path), 3, 5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    assert {(r.file_name, r.line_number, r.line) for r in shown} == {(f, n, t[:5]) for f, n, t in want if n <= 3}


def test_line_numbers_never_lose_lines(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("".join(f"line {i} of {name}\n" for i in range(5000)))
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, "100000")
    try:
        numbered = readers.number_lines(readers.read_lines(spark, str(tmp_path)))
        spark.conf.set(conf, "7000")
        with pytest.raises(Exception, match="split differently"):
            numbered.collect()
        spark.conf.set(conf, "100000")
        numbered = readers.number_lines(readers.read_lines(spark, str(tmp_path)))
        assert numbered.count() == 10_000
        assert {int(r.line.split()[1]) - r.line_number for r in numbered.collect()} == {-1}
    finally:
        spark.conf.unset(conf)


def test_text_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\n  \n<Event><System><X>1</X></System></Event>\n<Event><bad\n\xff\xfe bad\ntwo\n")
    rows = readers.read_text(spark, str(tmp_path), line_numbers=True).orderBy("line_number").collect()
    data = [{k: json.loads(str(v.toJson())) for k, v in r.data.items()} for r in rows]
    assert data == [
        {"line": "one", "line_number": 1}, {"X": "1", "line_number": 4},
        {"line": "<Event><bad", "line_number": 5}, {"line": "two", "line_number": 7},
    ]
    assert [r.format for r in rows] == ["text", "xml", "text", "text"]


def test_compressed_and_patterns(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"a":1}\n') + gzip.compress(b'{"a":2}\n'))
    (tmp_path / "sub" / "b.jsonl.bz2").write_bytes(bz2.compress(b'{"a":3}\n'))
    (tmp_path / "c.other").write_text('{"a":4}\n')
    assert readers.read_json_lines(spark, str(tmp_path)).count() == 4
    assert readers.read_json_lines(spark, str(tmp_path), "*.gz").count() == 2
    files = listing.list_files(spark, str(tmp_path))
    keep = files.filter(F.col("file_name") == "c.other").select("path")
    assert listing.list_files(spark, str(tmp_path), allow=keep).count() == 1
    assert files.filter(files.size > 0).count() == 3


def test_csv_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""q"", y"\n2\n,\n')
    (tmp_path / "b.csv").write_text('b,c\r\n1,2,9\r\n\r\n"3\n4",5\r\n')
    want = [{"a": "", "b": ""}, {"a": "1", "b": 'x "q", y'}, {"a": "2", "b": ""}, {"b": "1", "c": "2"}, {"b": "3\n4", "c": "5"}]
    rows = readers.read_csv(spark, str(tmp_path)).collect()
    assert sorted((json.loads(r.raw) for r in rows), key=str) == sorted(want, key=str)
    (tmp_path / "b.csv").write_text("c,b\n" + "".join(f"{i},x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = readers.read_csv(spark, str(tmp_path), multi_line=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(json.loads(r.raw)["c"]) for r in rows if "c" in json.loads(r.raw)) == list(range(5000))
    assert sum("a" in json.loads(r.raw) for r in rows) == 3
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path), one_header=True).collect()


def test_attributes_of_a_windows_event_are_printed_once(spark):
    """They were printed again for each element that they were compared with."""
    assert str(windows_event(F.col("line"))).count("to_json") == len(_SYSTEM_ATTRIBUTES) + 1


def test_repeated_data_of_a_windows_event(spark):
    line = (
        '<Event><System><EventID>7</EventID><Computer>c</Computer></System><EventData><Data Name="a">1</Data><Data Name="Computer">no</Data>'
        '<Data Name="b">2</Data><Data Name="a">3</Data><Data>unnamed</Data></EventData></Event>'
    )
    row = spark.createDataFrame([(line,)], "line string").select(F.to_json(windows_event(F.col("line"))).alias("j")).first()
    assert json.loads(row.j) == {"EventID": "7", "Computer": "c", "a": "1", "b": "2"}


def test_windows_events_outside_the_layout(spark, tmp_path):
    event = "<Event><System><EventID>1</EventID>{system}</System><EventData><Data Name='a'>x</Data></EventData>{more}</Event>"
    lines = [event.format(system="", more=""), event.format(system="<Odd>7</Odd>", more=""),
             event.format(system="", more="<UserData><U><V>9</V></U></UserData>"),
             event.format(system="", more="<RenderingInfo><Message>m</Message></RenderingInfo>"), "plain"]
    (tmp_path / "e.log").write_text("\n".join(lines) + "\n")
    by_mode = [
        sorted(json.dumps(json.loads(r.d), sort_keys=True) for r in readers.read_text(spark, str(tmp_path), xml_lines=m).select(F.to_json("data").alias("d")).collect())
        for m in ("windows", "any")
    ]
    assert by_mode[0] == by_mode[1] and any("Odd" in d for d in by_mode[0]) and any('"V": "9"' in d for d in by_mode[0])


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    for name, text in (("small", "abc"), ("large", "abcdef"), ("wrong", "abcdeg"), ("free", "abcdef"), ("odd", "abcdef")):
        (tmp_path / name).write_text(text)
    files = listing.list_files(spark, str(tmp_path))
    name = F.col("file_name")
    declared = (
        F.when(name == "small", F.concat(F.lit("md5:"), F.md5(F.lit("abc")))).when(name == "odd", "crc:1")
        .when(name != "free", F.concat(F.lit("sha512:"), F.upper(F.sha2(F.lit("abcdef"), 512))))
    )
    manifest = files.select("path", "file_name", declared.alias("checksum"))
    rows = listing.verify_checksums(spark, manifest, [str(tmp_path)], max_bytes=4).join(manifest.select("path", "file_name"), "path")
    assert {r.file_name: (r.ok, r.error) for r in rows.collect()} == {
        "small": (True, None), "large": (True, None), "wrong": (False, None), "free": (True, None), "odd": (False, None)}


def test_a_file_is_digested_in_blocks(tmp_path):
    data = bytes(range(256)) * 999
    (tmp_path / "a b.bin").write_bytes(data)
    for uri in (str(tmp_path / "a b.bin"), f"file:{tmp_path}/a b.bin", f"file://{tmp_path}/a b.bin"):
        assert blocks.digest_file(uri, "sha256", block=1000) == hashlib.sha256(data).hexdigest()
    with pytest.raises(ValueError, match="nowhere"):
        blocks.digest_file("nowhere://x/y", "md5")


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n 5, {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 3}')
    (tmp_path / "c.json").write_text('{"a": ')
    (tmp_path / "d.json").write_text('"text"')
    rows = readers.read_json_documents(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r.raw)["a"] for r in rows) == [1, 2, 3]


def test_addresses():
    assert listing.hadoop_uri("s3://b/p") == "s3a://b/p" and listing.hadoop_uri("/x") == "/x"


@pytest.mark.parametrize("compression,suffix", [("gzip", ".gz"), ("bzip2", ".bz2"), (None, "")])
def test_sink_appends(spark, tmp_path, compression, suffix):
    rows = spark.range(10).withColumn("st", F.concat(F.lit("a:b/"), F.pmod("id", F.lit(2))))
    for _ in range(2):
        write_lines(rows, F.col("id").cast("string"), str(tmp_path), "{sourcetype}/{year}/{filename}", RUN,
                    F.lit("/in/x.log"), F.col("st"), compression)
    files = [p for p in tmp_path.rglob("part-*") if not p.name.startswith(".")]
    assert files and all(p.name.endswith(suffix or ".txt") for p in files)
    back = spark.read.text(str(tmp_path))
    assert back.count() == 20 and {r.sourcetype for r in back.select("sourcetype").collect()} == {"a-b-0", "a-b-1"}


def test_sink_keeps_literal_text(spark, tmp_path):
    rows = spark.range(10).withColumn("st", F.concat(F.lit("a:"), F.pmod("id", F.lit(2))))
    for _ in range(2):
        write_lines(rows, F.col("id").cast("string"), str(tmp_path), "logs/app-{sourcetype}/e-{year}.jsonl", RUN,
                    F.lit("x"), F.col("st"), "gzip", files_per_path=1)
    names = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert names == {f"logs/app-a-{i}/e-2025{n}.jsonl.gz" for i in (0, 1) for n in ("", "-00001")}
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).count() == 20


def _lines_by_path(spark, tmp_path, mode="append"):
    rows = spark.range(40).withColumn("st", F.concat(F.lit("a:"), F.pmod("id", F.lit(4))))
    write_lines(rows, F.col("id").cast("string"), str(tmp_path / "out"), "x+y/app {sourcetype}.jsonl", RUN, F.lit("x"), F.col("st"),
                mode=mode, files_per_path=1)


def _files(tmp_path):
    return {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_overwritten_paths_make_way(spark, tmp_path):
    _lines_by_path(spark, tmp_path)
    _lines_by_path(spark, tmp_path)
    (tmp_path / "out" / "x+y" / "other.jsonl").write_text("stays")
    assert len(_files(tmp_path)) == 9
    (tmp_path / "out" / "x+y" / "out").mkdir()
    (tmp_path / "out" / "x+y" / "out" / "app a-1.jsonl").write_text("stays too")
    _lines_by_path(spark, tmp_path, "overwrite")
    assert set(_files(tmp_path)) == {f"x+y/app a-{i}.jsonl" for i in range(4)} | {"x+y/other.jsonl", "x+y/out/app a-1.jsonl"}


def test_failed_moves_leave_nothing(spark, tmp_path, monkeypatch):
    _lines_by_path(spark, tmp_path)
    before = _files(tmp_path)
    whole = blocks.move_file

    def breaks(source, target):
        if "a-2" in target:
            raise OSError("lost")
        whole(source, target)

    monkeypatch.setattr(files, "move_file", breaks)
    with pytest.raises(Exception, match="lost"):
        _lines_by_path(spark, tmp_path)
    assert _files(tmp_path) == before and not list((tmp_path / "out").glob("_staging*"))
    monkeypatch.undo()
    _lines_by_path(spark, tmp_path)
    assert len(_files(tmp_path)) == 8


def test_a_move_done_again_changes_nothing(tmp_path):
    (tmp_path / "a").write_text("x")
    for _ in range(2):
        blocks.move_file(str(tmp_path / "a"), f"file:{tmp_path}/deep/er/b")
    assert (tmp_path / "deep/er/b").read_text() == "x" and not (tmp_path / "a").exists()
    with pytest.raises(OSError):
        blocks.move_file(str(tmp_path / "none"), str(tmp_path / "c"))


def test_paths(spark):
    def path(template, st, compression=None):
        out = output_path(template, F.lit("/d/f.log.gz"), F.lit(st).cast("string"), RUN, compression)
        return spark.range(1).select(out).first()[0]

    assert path("{sourcetype}/{year}{month}{day}/{filename}", "a:b\\c/d", "gzip") == "a-b-c-d/20250601/f.log.gz"
    assert path("x-{hour}{minute}", None, "bzip2") == "x-1200.bz2"
    with pytest.raises(ValueError):
        path("{profile}", "x")


def _logs(path):
    (path / "auth.jsonl").write_text(
        '{"timestamp":"2024-01-15T10:00:00Z","user":"a","_raw":"2024-01-15 10:00:00 in"}\n'
        '{"timestamp":"2024-01-15T10:05:00Z","user":"b"}\nbroken\n'
    )
    (path / "net.jsonl").write_text('{"timestamp":"2024-01-15T11:00:00Z","src":"1.1.1.1"}\n')


def test_replay_job(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _logs(src)
    job = Replay(spark, RUN).input_source(str(src), "jsonl").output_destination(str(out)).set_timestamp_options(
        delta_factor=2.0, target_time="now")
    stats = job.output_destination(str(tmp_path / "second"), "text").run().first()
    assert spark.read.text(str(tmp_path / "second")).count() == 3
    assert (stats.events, stats.events_modified, str(stats.new_latest)) == (3, 3, "2025-06-01 12:00:00")
    back = {r.value for r in spark.read.text(str(out)).select("value").collect()}
    assert '{"timestamp":"2025-06-01T12:00:00+00:00","src":"1.1.1.1"}' in back
    assert '{"timestamp":"2025-06-01T10:00:00+00:00","user":"a","_raw":"2025-06-01 10:00:00 in"}' in back


def test_passthrough_and_dry_run(spark, tmp_path):
    _logs(tmp_path)
    text = io.StringIO()
    job = Replay(spark, RUN).input_source(str(tmp_path), "jsonl").no_shift()
    assert job.run().first().events == 3
    print_lines(job.records().orderBy("raw"), F.col("raw"), out=text)
    assert text.getvalue().splitlines()[0].startswith('{"timestamp":"2024-01-15T10:00:00Z"')
    shifted = Replay(spark, RUN).input_source(str(tmp_path), "auto").output_destination("unused")
    assert shifted.run(dry_run=True).first().events == 4


def test_sourcetypes_choose_patterns(spark, tmp_path):
    (tmp_path / "a.log").write_text("type=X msg=audit(1705312800.5:1)\n")
    files = spark.createDataFrame([("a.log", "AUDITD", 0)], "file_name string, sourcetype string, position int")
    job = Replay(spark, RUN).input_source(str(tmp_path), "text").sourcetypes(files).set_timestamp_options(
        target_time="2024-01-16T10:00:00Z")
    assert json.loads(job.shifted().select(F.to_json("data")).first()[0])["line"] == "type=X msg=audit(1705399200.0:1)"


def test_nothing_to_shift_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n')
    with pytest.raises(NoTimestampsError):
        Replay(spark, RUN).input_source(str(tmp_path), "jsonl").run()


def test_validate(spark):
    job = Replay(spark).input_source("x", "parquet", "odd").output_destination("y", "csv", "{date}", "zip")
    assert len(job.set_timestamp_options(delta_factor=-1, target_time="soon").validate()) == 7


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.log").write_text("".join(f"2024-01-{d:02d} 10:00:00 file {i}\n" for d in range(1, 29)))
    plan = ShiftPlan(micros(datetime(2024, 1, 1)), micros(datetime(2025, 1, 1)), 0.5).affine()
    query = shift_lines(stream_lines(spark, str(src), files_per_batch=1), plan).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    batch = shift_lines(spark.read.text(str(src)).select(F.col("value").alias("line")), plan)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.line for r in streamed.collect()) == sorted(r.line for r in batch.collect())


def test_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "dataset.yaml").write_text(
        "metadata:\n  name: org/a\n  version: 1.0.0\n  description: d\n  tags: [x, y]\n"
        "  mitre_attack:\n    techniques:\n      - {id: T1, name: n, tactics: [t]}\n"
        "files:\n  bundled:\n    - {path: logs/a.jsonl, format: jsonl, sourcetype: s}\n"
        "  references:\n    - {uri: 's3://b/x', checksum: 'md5:00'}\n"
        "dependencies:\n  - {dataset: org/b}\ndefaults:\n  replay: {delta_factor: 2.0}\n"
    )
    (tmp_path / "b" / "dataset.yaml").write_text("metadata: [")
    manifests = M.read_manifests(spark, str(tmp_path))
    row = M.datasets(manifests).first()
    assert (row.name, row.tags, list(row.replay_defaults)) == ("org/a", ["x", "y"], ["delta_factor"])
    assert [(r.kind, r.path, r.format) for r in M.files(manifests).collect()] == [
        ("bundled", "logs/a.jsonl", "jsonl"), ("references", "s3://b/x", "auto")]
    assert [tuple(r) for r in M.dependencies(manifests).collect()] == [("org/a", 0, "org/b", "*")]
    assert M.techniques(manifests).first().technique == "T1"


def test_closure_and_merge(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")], "dataset string, dependency string")
    got = {tuple(r) for r in dependency_closure(edges).collect()}
    assert {(d, n) for root, d, n in got if root == "d"} == {("d", 0), ("b", 1), ("c", 2), ("a", 3)}
    entries = spark.createDataFrame(
        [("r", "a.b", "1", 1), ("r", "a", "2", 2), ("r", "x", "3", 1), ("r", "x.y", "4", 2), ("r", "x.y", "5", 3), ("r", "k", "6", 0)],
        "root string, path string, value string, priority int")
    assert {(r.path, r.value) for r in merged_settings(entries, ["root"]).collect()} == {("a", "2"), ("x.y", "5"), ("k", "6")}


def test_numbers_of_each_batch(spark, tmp_path):
    """Observed per batch they add up to those of the whole, the instants at the ceiling among them."""
    (tmp_path / "in").mkdir()
    for at in range(3):
        rows = [{"timestamp": f"2024-01-0{at + 1}T0{i}:00:00Z"} for i in range(4)]
        (tmp_path / "in" / f"{at}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    plan = ShiftPlan(micros(datetime(2024, 1, 1)), micros(RUN), 1.0, micros(datetime(2025, 6, 3, 13)))
    moved = replay_stream.shift_json_lines(stream_lines(spark, str(tmp_path / "in"), files_per_batch=1), plan.affine(), [Pattern("timestamp")])
    seen = replay_stream.batch_statistics(moved, plan.affine(), micros(datetime(2025, 6, 2, 14)))
    numbers = replay_stream.BatchNumbers()
    spark.streams.addListener(numbers)
    try:
        job = seen.select("line").writeStream.format("text").option("checkpointLocation", str(tmp_path / "state"))
        job.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(numbers)
    assert len(numbers.batches) == 3
    assert sum(b["events"] for b in numbers.batches) == 12
    assert sum(b["instants_in_future"] for b in numbers.batches) == 1 + 4
    assert sum(b["instants_at_ceiling"] for b in numbers.batches) == 2
    assert max(b["new_latest"] for b in numbers.batches) == datetime(2025, 6, 3, 13)


@pytest.mark.parametrize("name", ["scan_json_documents", "scan_xml"])
def test_documents_lie_side_by_side(spark, monkeypatch, tmp_path, name):
    from tidemark.queries import file_queries, load

    monkeypatch.setattr(file_queries, "scratch", lambda spark: f"file:{tmp_path}/documents")
    found = load()[0][name](spark, "/root/testdata/sf0.001")
    events = found.count()
    inside = [p for p in (tmp_path / "documents").iterdir() if p.name.startswith("part-")]
    # a file per hundred events, and no folder that has to be made, moved and listed
    assert events == 1000 and len(inside) == 10 and all(p.is_file() for p in inside)


def test_instants_without_records_equal_those_of_the_shift(spark):
    plan = ShiftPlan(0, 86_400_000_000, 2.0, None).affine()
    lines = ['{"timestamp":"2024-01-01T00:00:00Z","_raw":"2024-01-01 00:00:00","type":"a"}', '{"type":"b"}', '{"timestamp":"no"}', "broken", "", '{"timestamp":1704067200}']
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    light = replay_stream.json_line_instants(rows, plan, [Pattern("timestamp")])
    whole = replay_stream.shift_json_lines(rows, plan, [Pattern("timestamp")])

    def found(df):
        return sorted((str(r.timestamps), str(r.new_timestamps)) for r in df.select("timestamps", "new_timestamps").collect())

    assert found(light) == found(whole) and len(found(light)) == 4
    # the record is left as it was read
    kept = light.select(F.try_variant_get(F.col("data")["_raw"], "$", "string")).collect()
    assert "2024-01-01 00:00:00" in {r[0] for r in kept}
