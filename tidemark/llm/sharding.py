"""Shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

A row's shard follows from its key and the number of shards. There is no table of the ring: the
generator is seeded with the key and jumps forward until it leaves the range, so with one more shard
a row either stays or moves into the new one, and only a share of 1/(n+1) moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: multiplier of the 64-bit linear generator in the published algorithm.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
ROWS_PER_RANGE = 50_000


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * MULTIPLIER + 1`` modulo 2^64 on 32-bit halves; no product passes 2^63."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    m0, m1 = m_low & 0xFFFF, m_low >> 16
    p0, p1 = low * F.lit(m0), low * F.lit(m1)
    mask = F.lit(LOW).cast("long")
    half = F.lit(0xFFFF).cast("long")
    lower = p0 + F.shiftleft(p1.bitwiseAND(half), 16) + F.lit(1)
    cross = high * F.lit(m0) + F.shiftleft((high * F.lit(m1)).bitwiseAND(half), 16)
    upper = F.shiftright(lower, 32) + F.shiftright(p1, 16) + cross.bitwiseAND(mask) + (low * F.lit(m_high)).bitwiseAND(mask)
    return upper.bitwiseAND(mask), lower.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key among ``shards``; null for a null key.

    The paths for ``shards`` and ``shards + 1`` agree up to the last jump, so one more shard takes
    rows only into itself. A jump moves forward by one at least: ``shards`` steps always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(LOW).cast("long")).alias("low"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("to"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        scale = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        to = F.floor((state["to"] + F.lit(1)).cast("double") * scale)
        moved = F.struct(high.alias("high"), low.alias("low"), state["to"].alias("at"), to.alias("to"))
        return F.when(state["to"] < F.lit(shards), moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(shards))
    jumped = F.aggregate(steps, start, step, lambda state: state["at"].cast("int"))
    return F.when(key.isNotNull(), jumped)


def gapless(rows: DataFrame, group: str, order: list[str], name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without sorting a group in one task.

    A group is cut into ranges by a hash of its ordering columns, about ``rows_per_range`` rows each;
    the counts of ranges (one row each) are summed up, and rows are numbered within their range.
    """
    total = rows.count()
    ranges = max(1, -(-total // rows_per_range))
    cut = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)))
    counts = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(*order)
    numbered = cut.withColumn("_in", F.row_number().over(within) - 1)
    keyed = (numbered[group].eqNullSafe(starts[group])) & (numbered["_range"] == starts["_range"])
    kept = [numbered[c] for c in rows.columns]
    return numbered.join(starts, keyed, "left").select(*kept, (F.col("_start") + F.col("_in")).alias(name))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard, slot and size of every document; the law is ``key``.

    Result: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row per input row. ``size``
    is the UTF-8 length of the text plus 8. A null or empty text has size 8 and checksum 0. The shard
    depends on ``doc_id`` alone, so repeated rows share a shard and take slots of their own; a null
    ``doc_id`` counts as key 0. Other columns of the input are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    slots = gapless(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
