"""Closures, versions and merged defaults against plain Python on small graphs."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import versions as V
from tidemark.functions.bind import computed_once
from tidemark.operators import dependencies as D
from tidemark.operators import rounds as R

EDGES = "dataset string, dependency string"
PLACED = "dataset string, dependency string, position int"
ENTRIES = "dataset string, path string, value string"


def reach(edges, root):
    found, level, depth = {root: 0}, [root], 0
    while level:
        depth += 1
        level = sorted({b for a, b in edges if a in level} - set(found))
        found |= dict.fromkeys(level, depth)
    return found


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    edges = {(f"d{rng.randrange(40)}", f"d{rng.randrange(40)}") for _ in range(60)}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(37)} | {("c37", "c5")}
    df = spark.createDataFrame([*edges, ("d1", None), (None, "d1")], EDGES)
    want = {(a, d, n) for a in {a for a, b in edges if a != b} for d, n in reach(edges, a).items()}
    assert {tuple(r) for r in D.dependency_closure(df).collect()} == want
    roots = ["c3", "d2", "alone"]
    got = D.dependency_closure(df, spark.createDataFrame([(r,) for r in [*roots, "c3", None]], "dataset string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((a, d, n) for a in roots for d, n in reach(edges, a).items())


def test_closure_of_nothing(spark):
    empty = spark.createDataFrame([], EDGES)
    assert D.dependency_closure(empty).collect() == []
    assert D.dependency_closure(empty, spark.createDataFrame([], "dataset string")).collect() == []


def resolve(spark, releases, needs, roots):
    resolution = D.resolve_versions(
        spark.createDataFrame(releases, "dataset string, version string"),
        spark.createDataFrame(needs, "dataset string, version string, dependency string, constraint string"),
        spark.createDataFrame(roots, "dataset string, constraint string"),
    )
    rows = {(r.root, r.dataset): (r.version, r.problem) for r in resolution.datasets.collect()}
    return rows, {tuple(r) for r in resolution.conflicts().collect()}


def test_diamond_takes_the_release_both_sides_accept(spark):
    releases = [("app", "1.0.0"), ("left", "1.0.0"), ("right", "2.0.0"), *[("base", v) for v in ("1.0.0", "1.9.0", "1.10.0", "2.0.0", "2.1.0-rc")]]
    needs = [("app", "1.0.0", "left", "*"), ("app", "1.0.0", "right", None), ("left", "1.0.0", "base", "^1.0.0"), ("right", "2.0.0", "base", "<2.0.0")]
    rows, conflicts = resolve(spark, releases, needs, [("app", "*"), ("right", None)])
    assert rows[("app", "base")] == ("1.10.0", None) and rows[("right", "base")] == ("1.10.0", None) and not conflicts
    assert set(rows) == {("app", x) for x in ("app", "left", "right", "base")} | {("right", "right"), ("right", "base")}


def test_conflicting_ranges_and_missing_datasets_are_rows(spark):
    releases = [("app", "1.0.0"), ("left", "1.0.0"), ("base", "1.5.0"), ("base", "2.5.0")]
    needs = [("app", "1.0.0", "left", "*"), ("app", "1.0.0", "base", ">=2.0.0"), ("left", "1.0.0", "base", "1.x"),
             ("left", "1.0.0", "gone", "~1.0.0"), ("app", "1.0.0", "odd", "about 1")]
    rows, conflicts = resolve(spark, [*releases, ("odd", "1.0.0")], needs, [("app", "*")])
    assert rows[("app", "base")] == (None, "conflict") and rows[("app", "gone")] == (None, "missing") and rows[("app", "odd")] == (None, "conflict")
    assert conflicts == {("app", "base", ">=2.0.0", "conflict"), ("app", "base", "1.x", "conflict"),
                         ("app", "gone", "~1.0.0", "missing"), ("app", "odd", "about 1", "conflict")}


def test_a_lower_choice_brings_its_own_needs(spark):
    """A late constraint takes the first choice away; the next one needs something else."""
    releases = [("app", "1.0.0"), ("lib", "1.0.0"), ("lib", "2.0.0"), ("far", "1.0.0"), ("old", "0.1.0"), ("new", "3.0.0")]
    needs = [("app", "1.0.0", "lib", "*"), ("app", "1.0.0", "far", "*"), ("far", "1.0.0", "lib", "<2.0.0"),
             ("lib", "1.0.0", "old", "*"), ("lib", "2.0.0", "new", "*")]
    rows, _ = resolve(spark, releases, needs, [("app", "*")])
    assert rows[("app", "lib")] == ("1.0.0", None) and rows[("app", "old")] == ("0.1.0", None) and rows[("app", "new")] == ("3.0.0", None)


def test_cycles_end(spark):
    releases = [(d, v) for d in "abc" for v in ("1.0.0", "2.0.0")]
    needs = [("a", "2.0.0", "b", "*"), ("b", "2.0.0", "c", "*"), ("c", "2.0.0", "a", "<=1.0.0"), ("c", "1.0.0", "b", "<2.0.0")]
    rows, conflicts = resolve(spark, releases, needs, [("a", "*")])
    assert rows == {("a", "a"): ("1.0.0", None), ("a", "b"): ("2.0.0", None), ("a", "c"): ("2.0.0", None)} and not conflicts


def test_random_graphs_like_a_plain_resolution_by_rounds(spark):
    """Many roots that meet the same sets of constraints, sets that grow late, cycles; numbers beside a text order."""
    rng = random.Random(5)
    names = [f"d{i:02d}" for i in range(25)]
    texts = {n: rng.sample(["1.0.0", "1.9.0", "1.10.0", "2.0.0", "2.1.0", "10.0.0"], rng.randrange(4)) for n in names}
    fits = {"*": lambda v: True, ">=1.9.0": lambda v: v >= (1, 9, 0), "<10.0.0": lambda v: v < (10, 0, 0), "<=2.0.0": lambda v: v <= (2, 0, 0)}
    needs = [(n, v, rng.choice(names), rng.choice([*fits])) for n in names for v in texts[n] for _ in range(rng.randrange(4))]
    want, conflicts = {}, set()
    for root in names:
        met, new = set(), {(root, "*")}
        while new:
            met |= new
            chosen = {}
            for name in {d for d, _ in met}:
                allowed = [v for v in texts[name] if all(fits[c](tuple(map(int, v.split(".")))) for d, c in met if d == name)]
                chosen[name] = max(allowed, key=lambda v: tuple(map(int, v.split("."))), default=None)
            touched = {d for d, _ in new}
            new = {(d, c) for n, v, d, c in needs if n in touched and chosen[n] == v} - met
        for name, version in chosen.items():
            problem = None if version else "conflict" if texts[name] else "missing"
            want[root, name] = (version, problem)
            conflicts |= {(root, d, c, problem) for d, c in met if d == name and problem}
    assert resolve(spark, [(n, v) for n in names for v in texts[n]], needs, [(n, None) for n in names]) == (want, conflicts)
    assert {p for _, p in want.values()} == {None, "conflict", "missing"}


def test_nothing_to_resolve(spark):
    assert resolve(spark, [], [], []) == ({}, set())
    assert resolve(spark, [], [], [("a", "*"), (None, "*")]) == ({("a", "a"): (None, "missing")}, {("a", "a", "*", "missing")})


FITS = {"*": lambda v: True, ">=1.9.0": lambda v: v >= (1, 9, 0), "<10.0.0": lambda v: v < (10, 0, 0), "<=2.0.0": lambda v: v <= (2, 0, 0)}


def by_number(text):
    return tuple(map(int, text.split(".")))


def random_catalog(seed, n=25):
    rng = random.Random(seed)
    names = [f"d{i:02d}" for i in range(n)]
    texts = {d: sorted(rng.sample(["1.0.0", "1.9.0", "1.10.0", "2.0.0", "2.1.0", "10.0.0"], rng.randrange(4)), key=by_number) for d in names}
    needs = [(d, v, rng.choice(names), rng.choice([*FITS])) for d in names for v in texts[d] for _ in range(rng.randrange(4))]
    return texts, needs


def plain_rounds(texts, needs, root, start=("*",)):
    """Constraints with the round that met them, and the release of each dataset."""
    met, new, level = {}, {(root, c) for c in start}, 0
    while new:
        met |= dict.fromkeys(new, level)
        chosen = {}
        for name in {d for d, _ in met}:
            allowed = [v for v in texts.get(name, ()) if all(FITS[c](by_number(v)) for d, c in met if d == name)]
            chosen[name] = max(allowed, key=by_number, default=None)
        new, level = {(d, c) for n, v, d, c in needs if chosen.get(n) == v} - set(met), level + 1
    return met, chosen


def test_small_blocks_settle_like_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    texts, needs = random_catalog(11)
    roots = [*texts, *texts, "alone"]
    starts = {root: ["<10.0.0", ">=1.9.0"] if i % 4 == 0 else ["*"] for i, root in enumerate(texts)} | {"alone": ["*"]}
    resolution = D.resolve_versions(
        spark.createDataFrame([(d, v) for d in texts for v in texts[d]] * 2, "dataset string, version string"),
        spark.createDataFrame(needs * 2, "dataset string, version string, dependency string, constraint string"),
        spark.createDataFrame([(r, c) for r in roots for c in starts[r]], "dataset string, constraint string"),
    )
    assert resolution.blocks.select("block").distinct().count() >= 9
    datasets, constraints, conflicts = [], [], []
    for root in starts:
        met, chosen = plain_rounds(texts, needs, root, starts[root])
        constraints += [(root, d, c, level) for (d, c), level in met.items()]
        for d, version in chosen.items():
            problem = None if version else "conflict" if texts.get(d) else "missing"
            datasets.append((root, d, version, sum(d == e for e, _ in met), problem))
            conflicts += [(root, d, c, problem) for e, c in met if d == e and problem]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(resolution.datasets.collect()) == order(datasets)
    assert order(resolution.constraints.collect()) == order(constraints)
    assert order(resolution.conflicts().collect()) == order(conflicts)


def test_rounds_are_no_jobs(spark, monkeypatch):
    """A chain of 40 takes 40 rounds; what a block can meet is brought together without following them."""
    written, appended, levels = D.cut_lineage, D._Levels.append, []
    monkeypatch.setattr(D, "cut_lineage", lambda df: (levels.append(1), written(df))[1])
    monkeypatch.setattr(D._Levels, "append", lambda self, df: (levels.append(1), appended(self, df))[1])
    releases = [(f"c{i:02d}", "1.0.0") for i in range(41)]
    needs = [(f"c{i:02d}", "1.0.0", f"c{i + 1:02d}", "*") for i in range(40)]
    rows, _ = resolve(spark, releases, needs, [(d, "*") for d, _ in releases])
    assert len(rows) == 41 * 42 // 2 and {*rows.values()} == {("1.0.0", None)}
    assert len(levels) < 20


def test_roots_that_meet_too_much_are_taken_in_parts(monkeypatch):
    texts, needs = random_catalog(3)
    asked = {(d, c) for *_, d, c in needs} | {(d, "*") for d in texts}

    def ranks(d, c):
        fit = [i + 1 for i, v in enumerate(texts[d]) if FITS[c](by_number(v))]
        return {"constraint": c, "low": min(fit, default=1), "high": max(fit, default=0)}

    rows = [
        {"dataset": d, "versions": texts[d], "asked": ["*"], "asks": [ranks(d, c) for e, c in sorted(asked) if d == e],
         "needs": [{"rank": texts[d].index(v) + 1, "dependency": e, "constraint": c} for n, v, e, c in needs if n == d] or None}
        for d in texts
    ]
    need = pa.struct([("rank", pa.int32()), ("dependency", pa.string()), ("constraint", pa.string())])
    ask = pa.struct([("constraint", pa.string()), ("low", pa.int32()), ("high", pa.int32())])
    lists = {"versions": pa.string(), "needs": need, "asks": ask, "asked": pa.string()}
    schema = pa.schema([("dataset", pa.string()), *((n, pa.list_(t)) for n, t in lists.items())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    parts = {}
    for held in (1000, 1):
        monkeypatch.setattr(R, "HELD", held)
        block = R.Block(iter([batch.slice(0, 9), batch.slice(9)]))
        found = [*block.settled(0, len(block.roots))]
        parts[held] = [sorted((row for s in found for row in zip(*(c.to_pylist() for c in getattr(s, part)()))), key=str) for part in ("datasets", "constraints", "conflicts")]
        assert len(found) == (1 if held > 1 else len(texts))
    assert parts[1] == parts[1000]
    assert {(r, d, v) for r, d, v, *_ in parts[1][0]} == {(r, d, v) for r in texts for d, v in plain_rounds(texts, needs, r)[1].items()}


def test_numbers_read_once_satisfy_the_same_side_by_side(spark):
    big = "99999999999999999999"
    texts = ["1.0.0", "v1.2.3", "vv1.2.3", "V1.2.3", "1.2", "1.2.3-rc1", "1.2.3-", "1.2.3-x", "1.2.3\n", f"{big}.0.0", f"1.{big}.0", "", "x", " 1.2.3",
             "01.02.03", "1.x", "1.X", "1.2.x", f"{big}.x", "1.x.x", "1.10.0", "1.9.0", "2.0.0", "*", "about 1"]
    operators = ["", "^", "~", ">=", "<=", ">", "<", "=", "==", "=>", "v", " >"]
    pairs = [(v, o + c) for v, o, c in itertools.product(texts, operators, texts)] + [(None, "*"), ("1.0.0", None)]
    df = spark.createDataFrame(pairs, "version string, constraint string")
    df = computed_once(df, {"v": V.number_text(F.col("version")), "c": V.bound_text(F.col("constraint"))})
    df = D.cut_lineage(df.select("version", "constraint", V.numbers(F.col("v")).alias("v"), V.numbers(F.col("c")).alias("c")))
    assert df.filter(~F.col("v").eqNullSafe(V.semver(F.col("version")))).isEmpty()
    fits = V.meets(F.col("v"), F.col("constraint"), F.col("c"))
    rows = D.cut_lineage(df.withColumn("fits", fits))
    assert rows.filter(~F.col("fits").eqNullSafe(V.satisfies(F.col("version"), F.col("constraint")))).isEmpty()
    place = {r.version: i for i, r in enumerate(rows.select("v", "version").distinct().filter("version IS NOT NULL").orderBy("v", "version").collect())}
    allowed = {}
    for row in rows.filter("fits").collect():
        if row.version is not None:
            allowed.setdefault(row.constraint, set()).add(place[row.version])
    assert len(allowed) > 50 and all(max(found) - min(found) + 1 == len(found) for found in allowed.values())


def deep(base, override):
    out = dict(base)
    for key, value in override.items():
        out[key] = deep(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def flat(tree, prefix=""):
    for key, value in tree.items():
        yield from flat(value, f"{prefix}{key}.") if isinstance(value, dict) else [(prefix + key, value)]


def nested(paths):
    tree = {}
    for path, value in paths:
        *branch, leaf = path.split(".")
        at = tree
        for step in branch:
            at = at.setdefault(step, {})
        at[leaf] = value
    return tree


def test_defaults_like_a_recursive_merge(spark):
    rng = random.Random(2)
    names = [f"n{i:02d}" for i in range(30)]
    own = {}
    for n in names:
        tree = {"v": n}
        for key in rng.sample("abc", 2):
            tree[key] = n if rng.random() < 0.4 else {k: n if rng.random() < 0.6 else {"z": n} for k in rng.sample("xyw", 2)}
        own[n] = tree
    edges = [(n, d, i) for at, n in enumerate(names) for i, d in enumerate(rng.sample(names[:at], min(at, rng.randrange(4))))]

    def merged(n):
        out = {}
        for _, d, _ in sorted((e for e in edges if e[0] == n), key=lambda e: e[2]):
            out = deep(out, merged(d))
        return deep(out, own[n])

    entries = [(n, p, v) for n, tree in own.items() for p, v in flat(tree)]
    got = D.merged_defaults(spark.createDataFrame(edges, PLACED), spark.createDataFrame(entries, ENTRIES)).collect()
    for n in names:
        assert {(r.path, r.value) for r in got if r.dataset == n} == set(flat(merged(n))), n
    assert nested(flat(merged(names[-1]))) == merged(names[-1])


def test_stacked_diamonds_stay_linear(spark):
    edges, entries = [], [("top0", "v", "0")]
    for i in range(20):
        edges += [(f"top{i + 1}", f"left{i}", 0), (f"top{i + 1}", f"right{i}", 1), (f"left{i}", f"top{i}", 0), (f"right{i}", f"top{i}", 0)]
        entries += [(f"left{i}", "side", "left"), (f"right{i}", "side", f"right{i}"), (f"top{i + 1}", f"own{i % 3}", str(i))]
    got = D.merged_defaults(spark.createDataFrame(edges, PLACED), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {(r.path, r.value) for r in got if r.dataset == "top20"} == {("v", "0"), ("side", "right19"), ("own0", "18"), ("own1", "19"), ("own2", "17")}
    assert len(got) <= 5 * 61


def test_defaults_around_a_cycle(spark):
    edges = [("a", "b", 0), ("b", "a", 0), ("c", "a", 0), ("b", "leaf", 1)]
    entries = [(d, p, d) for d in ("a", "b", "c", "leaf") for p in (d, "who")]
    got = D.merged_defaults(spark.createDataFrame(edges, PLACED), spark.createDataFrame(entries, ENTRIES)).collect()
    rows = {d: {(r.path, r.value) for r in got if r.dataset == d} for d in ("a", "b", "c")}
    assert rows["a"] == {("a", "a"), ("who", "a")}
    assert rows["b"] == {("a", "a"), ("leaf", "leaf"), ("b", "b"), ("who", "b")}
    assert rows["c"] == {("a", "a"), ("c", "c"), ("who", "c")}
    none = spark.createDataFrame([], PLACED)
    assert len(D.merged_defaults(none, spark.createDataFrame(entries, ENTRIES)).collect()) == 8


def test_tables_of_datasets_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, written = [], D.cut_lineage
    appended = D._Levels.append

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(D, "cut_lineage", lambda df: written(seen(df)))
    monkeypatch.setattr(D._Levels, "append", lambda self, df: appended(self, seen(df)))
    monkeypatch.setattr(D, "merged_settings", lambda entries, keys: entries.select(*keys, "path", "value"))
    edges = spark.createDataFrame([(i, i // 3, 0) for i in range(1, 40)], "dataset long, dependency long, position int")
    own = spark.createDataFrame([(i, "a", str(i)) for i in range(40)], "dataset long, path string, value string")
    assert D.merged_defaults(edges, own).count() > 0
    joins = [p for p in plans if "Join" in p]
    assert joins and not [p for p in joins if "BroadcastHashJoin" in p]
