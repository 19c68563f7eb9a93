"""Jump consistent hashing against the published algorithm."""

import zlib

from pyspark.sql import functions as F

from tidemark.llm import sharding


def jump(key, shards):
    key &= 2**64 - 1
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 10**12, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 24, 25, 300):
        rows = df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
        assert all(r.s == jump(r.k, shards) for r in rows)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24}
    assert 0.5 * 5000 / 25 < len(moved) < 2 * 5000 / 25


def test_slots_are_gapless_over_many_ranges(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    numbered = sharding.gapless(rows, "g", ["id"], "slot", rows_per_range=50).collect()
    for group in range(3):
        assert sorted(r.slot for r in numbered if r.g == group) == list(range(1000))


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "é" * 100_000, 7), (3, "é" * 100_000, 7), (None, "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    found = sharding.shard_documents(docs).collect()
    assert len(found) == 5
    by_text = {(i, t): None for i, t, _ in rows}
    for r in found:
        text = next(t or "" for i, t in by_text if i == r.doc_id)
        assert (r["size"], r.text_crc32, r.law) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "key")
        assert r.shard == jump(r.doc_id or 0, 24)
    twice = [r for r in found if r.doc_id == 3]
    assert twice[0].shard == twice[1].shard and twice[0].slot != twice[1].slot
    assert sharding.shard_documents(docs.limit(0)).collect() == []
