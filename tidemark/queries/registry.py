"""The registry, the tables, and the constants the queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.affine import Affine
from tidemark.functions.timeexpr import micros
from tidemark.operators.bounds import require_range
from tidemark.plans.shift_plan import ShiftPlan, TimeSettings, plan_shift
from tidemark.session import require_utc, shared_path

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

RUN_TIME = datetime(2025, 6, 1, 12, 0, 0)
RUN_US = micros(RUN_TIME)
RUN_SQL = "epoch_us(TIMESTAMP '2025-06-01 12:00:00')"
TARGET = "2025-01-01T06:00:00Z"
TARGET_SQL = "epoch_us(TIMESTAMP '2025-01-01 06:00:00')"
# base of every plan over events: the earliest ts; the target lies far below the ceiling
SETTINGS = TimeSettings(target_time=TARGET, ceiling_time="now")
BOUNDS_SQL = "b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)"


def moved_sql(us: str, target: str = TARGET_SQL) -> str:
    """The move at factor 1; needs the CTE of :data:`BOUNDS_SQL`."""
    return f"({target} + ({us}) - b.lo)"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; timestamps leave it without a zone, as the SQL has them."""

    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_zone(build(require_utc(spark), sf_dir))

        run.__doc__ = build.__doc__
        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def without_zone(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant ``ts`` and its microseconds ``us``."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withColumn("us", F.unix_micros("ts"))


def spread(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows dealt evenly over the cores, for expressions that cost far more a row than an exchange of it.

    A scan has no more tasks than row groups, and a row group holds a million events.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return require_range(table(spark, sf_dir, "events"), [F.col("ts")])


def plan(spark: SparkSession, sf_dir: str, settings: TimeSettings = SETTINGS) -> ShiftPlan:
    return plan_shift(settings, *bounds(spark, sf_dir), RUN_US)


def move(spark: SparkSession, sf_dir: str, settings: TimeSettings = SETTINGS) -> Affine:
    return plan(spark, sf_dir, settings).affine()


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for queries that read back what they write."""
    return shared_path(spark, "tidemark")


def clock(us: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_micros(us), pattern)


def second(us: Column) -> Column:
    """Cut to whole seconds."""
    return us - F.pmod(us, F.lit(1_000_000))


def milli(us: Column) -> Column:
    return us - F.pmod(us, F.lit(1000))


SECOND_SQL = "(epoch_us(ts) // 1000000 * 1000000)"
MILLI_SQL = "(epoch_us(ts) // 1000 * 1000)"
