"""Fields, write-back, change sets and collector records against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timeexpr import micros
from tidemark.operators import changes as C
from tidemark.operators import collector as K
from tidemark.operators import extract as X
from tidemark.operators.bounds import NoTimestampsError, require_range
from tidemark.operators.writeback import put_matched, replace_first, shift_records
from tidemark.plans.pattern_sets import GENERIC, REGISTRY, Pattern, ocsf, patterns_for, registered
from tidemark.plans.shift_plan import ShiftPlan
from tidemark.replay import Replay
from tidemark.sinks.delivery import deliver, wait_seconds
from datetime import datetime

PLAN = ShiftPlan(micros(datetime(2024, 1, 15, 10)), micros(datetime(2025, 1, 15, 10)))


def records(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return rows.withColumn("data", X.json_object(F.col("raw")))


def replayed(spark, texts, patterns, **options):
    rows = records(spark, texts).filter("data IS NOT NULL")
    out = shift_records(rows, X.map_reader(F.col("data")), patterns, PLAN.affine(), **options)
    return [json.loads(r.j) for r in out.orderBy("i").select(F.to_json("data").alias("j")).collect()]


def test_patterns_by_source():
    assert registered("AUDITD") == REGISTRY["auditd"] and registered(None) is None and registered("x") is None
    assert patterns_for("raw", "stash")[0].field == "@timestamp" and patterns_for("raw", "x") == GENERIC
    mine = (Pattern("when"),)
    assert patterns_for("raw", "stash", mine) == mine
    assert patterns_for("ocsf", None, mine) == mine + ocsf()
    assert len(REGISTRY) == 43


def test_generic_records(spark):
    got = replayed(spark, [
        '{"timestamp": "2024-01-15T10:00:00Z", "message": "a", "severity": "INFO"}',
        '{"_time": "2024-01-15T10:05:00+00:00", "_raw": "01/15/2024 10:05:00 AM x", "n": null}',
        '{"_time": 1705313400, "list": [1, {"a": 2}]}',
        '{"time": "1705313400000", "ts": "later"}',
        '{"message": "none", "_raw": "2024-01-15 10:00:00"}',
    ], GENERIC)
    assert got == [
        {"timestamp": "2025-01-15T10:00:00+00:00", "message": "a", "severity": "INFO"},
        {"_time": "2025-01-15T10:05:00+00:00", "_raw": "01/15/2025 10:05:00 AM x", "n": None},
        {"_time": "2025-01-15T10:10:00+00:00", "list": [1, {"a": 2}]},
        {"time": "2025-01-15T10:10:00+00:00", "ts": "later"},
        {"message": "none", "_raw": "2024-01-15 10:00:00"},
    ]


def test_nested_and_regex_fields(spark):
    patterns = [Pattern("metadata.ts"), Pattern("line", "unix_seconds", True, r"audit\((\d+\.\d+):\d+\)"), Pattern("a.b.c", "unix_ms")]
    got = replayed(spark, [
        '{"metadata": {"ts": "2024-01-15T10:00:00Z", "k": 1}}',
        '{"line": "audit(1705312800.950:6845) audit(1705312800.950:6845)"}',
        '{"a": {"b": {"c": 1705312800000, "d": "x"}}, "metadata": "text"}',
    ], patterns)
    assert got == [
        {"metadata": {"ts": "2025-01-15T10:00:00+00:00", "k": 1}},
        {"line": "audit(1736935200.950:6845) audit(1705312800.950:6845)"},
        {"a": {"b": {"c": "2025-01-15T10:00:00+00:00", "d": "x"}}, "metadata": "text"},
    ]


def test_last_success_counts(spark):
    rows = records(spark, ['{"t": "2024-01-15", "u": "5"}', '{"t": "x", "u": 7}'])
    patterns = [Pattern("t"), Pattern("t", "%Y-%d"), Pattern("u", "unix_seconds"), Pattern("u", "unix_millis")]
    out = X.extract(rows, X.map_reader(F.col("data")), patterns).orderBy("i").collect()
    assert [{k: str(v) for k, v in r.timestamps.items()} for r in out] == [
        {"t": "2024-01-15 00:00:00", "u": "1970-01-01 00:00:00.005000"}, {"u": "1970-01-01 00:00:00.007000"},
    ]


def test_struct_columns(spark):
    rows = spark.createDataFrame([("2024-01-15T10:00:00Z", (1705312800.5,))], "t string, s struct<u:double>")
    out = X.extract(rows, X.struct_reader(rows), [Pattern("t"), Pattern("s.u", "unix_seconds"), Pattern("s.x")])
    assert sorted(out.first().timestamps) == ["s.u", "t"]


def test_bad_json(spark):
    texts = ["", "[1]", '{"a":', "{'a':1}", '{"a":1} x', '{"a":1} \t', '"s"', "null", '{"a":tru}']
    rows = records(spark, texts)
    assert [r.i for r in rows.filter("data IS NOT NULL").collect()] == [5]
    flat, _ = X.json_fields(rows, "raw", [Pattern("a"), Pattern("A")])
    assert [r.i for r in flat.filter("is_object").collect()] == [5]


def test_white_space_around_records(spark):
    good = ['{"a":1}', '\t{"a":1}', '{"a":1}\t \r', '\u00a0{"a":1}\x0b', " {\"a\":1} "]
    assert records(spark, good).filter("data IS NOT NULL").count() == len(good)


def test_groups_without_key_or_settings(spark):
    from tidemark.operators import shift
    from tidemark.plans.shift_plan import SETTING_FIELDS

    rows = spark.sql(
        "SELECT k, timestamp_micros(t) AS ts, map('x', parse_json('1')) AS data "
        "FROM VALUES ('a', 5000000), (NULL, 7000000), ('b', 9000000), ('c', NULL) AS t(k, t)"
    )
    settings = spark.createDataFrame([("a", 1.0, "auto", "2020-01-01T00:00:00Z", True, "now")], "k string, delta_factor double, base_time string, target_time string, prevent_future boolean, ceiling_time string")
    assert set(SETTING_FIELDS) < set(settings.columns)
    run = 1_700_000_000_000_000
    plans = shift.plan_by_group(rows, [F.col("ts")], "k", settings, run)
    moved = {r.k: r.new for r in shift.shift_by_group(rows, plans, "k", {"ts": "new"}).selectExpr("k", "unix_micros(new) AS new").collect()}
    assert moved == {"a": 1_577_836_800_000_000, None: run, "b": run, "c": None}
    results = {r.k: r.error for r in shift.group_results(rows, [F.col("ts")], plans, "k").collect()}
    assert results == {"a": None, None: None, "b": None, "c": "no readable timestamp"}


def test_no_timestamps(spark):
    with pytest.raises(NoTimestampsError):
        require_range(spark.createDataFrame([(None,)], "t timestamp"), [F.col("t")])


def test_replace_first_and_decimals(spark):
    out = spark.range(1).select(
        replace_first(F.lit("a-b-b"), F.lit("b"), F.lit("X")), replace_first(F.lit("a"), F.lit("z"), F.lit("X")),
        put_matched(F.lit("t=1.5;"), F.lit(2_250_000), "unix_seconds", F.lit("1.5")),
        put_matched(F.lit("t=1.50000000;"), F.lit(2_250_001), "unix_seconds", F.lit("1.50000000")),
        put_matched(F.lit("gone"), F.lit(-250_000), "unix_seconds", F.lit("1.50")),
    )
    assert tuple(out.first()) == ("a-X-b", None, "t=2.2;", "t=2.25000100;", "-0.25")


# ---------------------------------------------------------------------------------------------


def brute_changes(text, changes):
    found = []
    for old, new in changes:
        at = text.find(old) if old else -1
        while at >= 0:
            found.append((at, old, new))
            at = text.find(old, at + len(old))
    starts = {}
    for at, old, new in found:
        starts.setdefault(at, (old, new))
    for at in sorted(starts, reverse=True):
        old, new = starts[at]
        if text[at:at + len(old)] == old:
            text = text[:at] + new + text[at + len(old):]
    return text


@pytest.mark.parametrize("changes", [
    [("ab", "X"), ("b", "YY"), ("abc", "Z")], [("aa", "b"), ("a", "cc")], [("a.b", "Q"), ("\\E", "e"), ("", "n")],
    [("é", "ee"), ("c", "")], [("ab", "ab"), ("ba", "BA")], [("c", "1"), ("c", "2")], [("abc", "cab"), ("ca", "z")],
])
def test_changes(spark, changes):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc.é\\E") for _ in range(rng.randrange(25))) for _ in range(300)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = rows.select(
        "t", C.apply_changes(F.col("t"), C.change_list(changes)).alias("a"), C.apply_change_list(F.col("t"), changes).alias("b")
    )
    for r in out.collect():
        want = None if r.t is None else brute_changes(r.t, changes)
        assert (r.a, r.b) == (want, want), r.t


def test_json_changes(spark):
    rows = records(spark, ['{"a":{"n":5,"x":1.5},"s":"old"}', '{"a":7}', '{"a":{"n":"5"}}', "broken"])
    table = {"a.n": {"5": "6"}, "a.x": {"1.5": "2.5"}, "s": {"old": "new"}, "no.where": {"1": "2"}}
    out = rows.select("i", C.change_json_text(F.col("raw"), F.col("data"), table).alias("t")).orderBy("i")
    assert [r.t for r in out.collect()] == ['{"a":{"n":6,"x":2.5},"s":"new"}', '{"a":7}', '{"a":{"n":"6"}}', "broken"]


# ---------------------------------------------------------------------------------------------


def test_envelopes(spark):
    texts = [
        '{"_time":"2024-01-15T10:00:00Z","_raw":"line","host":"h","source":"s","sourcetype":"st"}',
        '{"_time":1705312800.5,"a":1}', "plain text", '{"_raw":"","_time":"no","host":0}', '{"_raw":null,"sourcetype":""}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", F.lit("file"))
    made = K.envelopes(rows, "t", K.EnvelopeOptions(index="ix", source="fixed"), "f").orderBy("i")
    got = [json.loads(r.envelope) for r in made.collect()]
    common = {"source": "fixed", "index": "ix"}
    assert got == [
        {"event": "line", "time": 1705312800, "host": "h", "sourcetype": "st", **common},
        {"event": {"_time": 1705312800.5, "a": 1}, "time": 1705312800.5, "sourcetype": "file", **common},
        {"event": "plain text", "sourcetype": "file", **common},
        {"event": {"_raw": "", "_time": "no", "host": 0}, "sourcetype": "file", **common},
        {"event": {"_raw": None, "sourcetype": ""}, "sourcetype": "file", **common},
    ]


def test_pack_keeps_order_and_limits(spark):
    lines = ["x" * (i % 40) for i in range(500)]
    rows = spark.createDataFrame([(t,) for t in lines], "line string").coalesce(1)
    bodies = K.pack(rows, "line", max_events=20, max_bytes=200).collect()
    assert "\n".join(b.body for b in bodies).split("\n") == lines
    assert all(b.events <= 20 and b.bytes <= 200 for b in bodies)
    big = K.pack(spark.createDataFrame([("y" * 500,), ("z",)], "line string").coalesce(1), "line", 20, 200).collect()
    assert [b.events for b in big] == [1, 1]


def test_delivery(spark):
    answers = spark.sparkContext.accumulator(0)

    def transport(url, body, headers):
        answers.add(1)
        assert url == "http://c/services/collector/raw?index=i" and headers["Content-Encoding"] == "gzip"
        return 200, None

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "body string, events long").repartition(2)
    url = K.endpoint("http://c/", raw=True)
    done = deliver(rows, url, "token", K.request_params(K.EnvelopeOptions(index="i")), transport=transport)
    assert (done.events_sent, done.requests_sent, answers.value) == (3, 2, 2)
    assert K.endpoint("http://c/services/collector/event") == "http://c/services/collector/event"
    assert (wait_seconds(3, None), wait_seconds(9, None), wait_seconds(1, 500.0)) == (8.0, 60.0, 120.0)


def _collector(folder, fails_at=None):
    """A collector that keeps each body it accepts as a file, and breaks down once at a body."""

    def transport(url, body, headers):
        import gzip as gz
        import os
        import uuid

        text = gz.decompress(body).decode()
        broken = os.path.join(folder, "broken")
        if fails_at is not None and fails_at in text.split("\n") and not os.path.exists(broken):
            open(broken, "w").close()
            return 400, None
        with open(os.path.join(folder, f"{headers.get('X-Request-ID', 'none')}.{uuid.uuid4().hex}"), "w") as out:
            out.write(text)
        return 200, None

    return transport


def _accepted(folder):
    return sorted(p.read_text() for p in folder.iterdir() if p.name != "broken")


def test_a_broken_delivery_goes_on_where_it_stopped(spark, tmp_path):
    """A task fails after half its batches; the next call sends each of the others, once."""
    got = tmp_path / "got"
    got.mkdir()
    bodies = spark.createDataFrame([(f"body {i % 18}", 1) for i in range(20)], "body string, events long").coalesce(1)
    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception, match="refused"):
        deliver(bodies, "http://c", "t", transport=_collector(str(got), "body 9"), ledger=ledger)
    assert 0 < len(_accepted(got)) < 20
    before = len(_accepted(got))
    done = deliver(bodies, "http://c", "t", transport=_collector(str(got)), ledger=ledger, parallelism=3)
    assert (done.requests_sent, done.bodies_skipped) == (20 - before, before)
    assert _accepted(got) == sorted(f"body {i % 18}" for i in range(20))
    again = deliver(bodies, "http://c", "t", transport=_collector(str(got)), ledger=ledger)
    assert (again.requests_sent, again.bodies_skipped) == (0, 20) and len(_accepted(got)) == 20


def test_bodies_of_a_file_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}", i, f"line {i}") for i in range(300)], "file string, at int, line string").repartition(7)
    bodies = K.pack_by_file(rows, "line", "file", "at", max_events=10, max_bytes=10_000)
    packed = sorted((b.file, b.place, b.body) for b in bodies.collect())
    assert [b for _, _, body in packed for b in body.split("\n")] == [f"line {i}" for f in range(3) for i in range(f, 300, 3)]
    order = str(tmp_path / "order")

    def transport(url, body, headers):
        import gzip as gz

        with open(order, "a") as out:
            out.write(gz.decompress(body).decode() + "\n")
        return 200, None

    deliver(bodies, "http://c", "t", transport=transport, parallelism=1, ledger=str(tmp_path / "ledger"))
    lines = [int(x.split()[1]) for x in open(order).read().split("\n") if x]
    assert sorted(lines) == list(range(300))
    assert all([x for x in lines if x % 3 == f] == list(range(f, 300, 3)) for f in range(3))


def test_collector_as_destination_of_a_replay(spark, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"_time": "2024-01-15T10:00:00Z", "host": "h", "_raw": "2024-01-15 10:00:00 in"}\n{"_time": "2024-01-15T10:05:00Z"}\n')

    def job():
        replay = Replay(spark, datetime(2025, 6, 1, 12)).input_source(str(tmp_path / "in"), "jsonl")
        return replay.set_timestamp_options(target_time="2025-01-01T00:00:00Z")

    options = K.EnvelopeOptions(index="i")
    stats = job().output_collector("http://c", "t", options, transport=_collector(str(got)), ledger=str(tmp_path / "l1")).run().first()
    assert stats.events == 2
    events = [json.loads(line) for text in _accepted(got) for line in text.split("\n")]
    assert sorted(events, key=lambda e: e["time"]) == [
        {"event": "2025-01-01 00:00:00 in", "time": 1735689600, "host": "h", "index": "i"},
        {"event": {"_time": "2025-01-01T00:05:00+00:00"}, "time": 1735689900, "index": "i"},
    ]
    raw = tmp_path / "raw"
    raw.mkdir()
    job().output_collector("http://c", "t", options, raw=True, transport=_collector(str(raw))).run()
    assert "2025-01-01 00:00:00 in" in "\n".join(_accepted(raw)).split("\n")


@pytest.mark.parametrize("status,attempts", [(503, 3), (0, 3), (400, 1)])
def test_refused(spark, status, attempts):
    tries = spark.sparkContext.accumulator(0)

    def transport(url, body, headers):
        tries.add(1)
        return status, None

    rows = spark.createDataFrame([("a", 1)], "body string, events long").coalesce(1)
    with pytest.raises(Exception):
        deliver(rows, "http://c", "t", max_retries=2, transport=transport, pause=lambda s: None)


def test_sourcetype_dispatch_equals_the_pattern_list_of_each_sourcetype(spark):
    """Rows of all sourcetypes read at once; eight of them (any letter case) against their own ordered lists."""
    fields = sorted({p.field for ps in REGISTRY.values() for p in ps} | {"timestamp", "time", "ts", "_time"})
    names = [n for s in REGISTRY for n in (s, s.upper())] + ["none such", "", None]
    rows = []
    for i, name in enumerate(names):
        value = {}
        for k, f in enumerate(fields):
            text = [f'"2024-01-02T03:04:{k % 60:02d}Z"', str(1704164640 + k), f'"{1704164640000 + k}"', "null"][(i + k) % 4]
            if f == "line":
                text = '"x 2024-05-06T07:08:09Z msg=audit(1704164640.250:7)"'
            value[f.split(".")[0]] = text if "." not in f else "{" + "".join(f'"{s}":{{' for s in f.split(".")[1:-1]) + f'"{f.split(".")[-1]}":{text}' + "}" * (f.count("."))
        rows.append((name, "{" + ",".join(f'"{t}":{v}' for t, v in value.items()) + "}"))
    df = spark.createDataFrame(rows, "st string, raw string").withColumn("data", X.json_object(F.col("raw")))
    got = {r.st: r.timestamps for r in X.extract_by_sourcetype(df, X.map_reader(F.col("data")), F.col("st")).collect()}
    assert len(got) == len(set(names))
    for name in ["osquery:results", "AWS:CLOUDTRAIL", "auditd", "circleci", "gws:reports:login", "azure:monitor:aad", "none such", None]:
        name = next((n for n in names if n and name and n.lower() == name.lower()), name)
        own = [p._replace(is_base=False) for p in patterns_for("raw", name)]
        one = df.filter(F.col("st").eqNullSafe(F.lit(name)))
        assert X.extract(one, X.map_reader(F.col("data")), own).first().timestamps == got[name], name
