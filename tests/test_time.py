"""Time expressions, plans, the affine map, reading and printing of instants."""

from datetime import datetime, timezone
from fractions import Fraction
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import instants as I
from tidemark.functions.affine import scale_exactly, scaled, scaled_by
from tidemark.functions.timeexpr import micros, parse_time_expression, time_expression_micros
from tidemark.plans.shift_plan import TimeSettings, plan_shift

NOW = micros(datetime(2024, 6, 1, 12))
EARLY, LATE = micros(datetime(2024, 1, 1)), micros(datetime(2024, 1, 2))
H, D = 3600 * 10**6, 86400 * 10**6

EXPRESSIONS = {
    "now": NOW, "NOW-2h": NOW - 2 * H, "earliest+1d": EARLY + D, "EARLIEST+1d-30m": EARLY + D - H // 2,
    "latest-30m": LATE - H // 2, "now-1d-12h-30m": NOW - D - 12 * H - H // 2, "now+1w": NOW + 7 * D,
    "now+1mon": NOW + 30 * D, "now-1y": NOW - 365 * D, "now+90s": NOW + 90 * 10**6, "now+2MON": NOW + 60 * D,
    "2024-01-15T10:00:00Z": micros(datetime(2024, 1, 15, 10)), "2024-01-15": micros(datetime(2024, 1, 15)),
    "2024-01-15T10:00:00+02:00": micros(datetime(2024, 1, 15, 8)),
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expression_on_driver(text):
    assert parse_time_expression(text).resolve(NOW, EARLY, LATE) == EXPRESSIONS[text]


@pytest.mark.parametrize("text", ["", "tomorrow", "now-", "now-5x", "now*2", "now 1h", "2024-13-01T00:00:00Z"])
def test_bad_expression(text):
    with pytest.raises(ValueError):
        parse_time_expression(text)


def test_earliest_needs_a_range():
    with pytest.raises(ValueError):
        parse_time_expression("earliest").resolve(NOW)


def test_expression_in_columns(spark):
    rows = spark.createDataFrame([(t,) for t in [*EXPRESSIONS, "junk", "now-5x"]], "t string")
    us = time_expression_micros(F.col("t"), F.lit(NOW), F.lit(EARLY), F.lit(LATE))
    got = {r.t: r.us for r in rows.select("t", us.alias("us")).collect()}
    assert got == {**EXPRESSIONS, "junk": None, "now-5x": None}


def test_plan_rules():
    plan = plan_shift(TimeSettings(target_time="now-10d"), EARLY, LATE, NOW)
    assert (plan.base, plan.new_base, plan.ceiling) == (EARLY, NOW - 10 * D, NOW)
    pulled = plan_shift(TimeSettings(2.0, target_time="now"), EARLY, LATE, NOW)
    assert pulled.new_base == NOW - 2 * D
    free = plan_shift(TimeSettings(target_time="now", prevent_future=False), EARLY, LATE, NOW)
    assert (free.new_base, free.ceiling) == (NOW, None)
    latest = plan_shift(TimeSettings(base_time="latest-30m", target_time="now-10d"), EARLY, LATE, NOW)
    assert latest.base == LATE - H // 2
    with pytest.raises(ValueError):
        plan_shift(TimeSettings(delta_factor=0), EARLY, LATE, NOW)


@pytest.mark.parametrize("factor", [1.0, 0.1, 0.5, 2.0, 1 / 3, 1.5, 10.0, 1e-3, 7.25, 123.456])
def test_scaling_is_exact(spark, factor):
    rng = random.Random(factor)
    deltas = [rng.randrange(-10**16, 10**16) for _ in range(200)] + [0, 1, 5, -5, 15, 25, 35]
    rows = spark.createDataFrame([(d,) for d in deltas], "d long").select(
        "d", scaled(F.col("d"), factor).alias("a"),
        scaled_by(F.col("d"), F.lit(factor) + F.col("d") * 0).alias("b"),
    )
    for d, a, b in rows.collect():
        assert a == b == round(Fraction(factor) * d) == scale_exactly(d, factor)


ISO = {
    "2016": datetime(2016, 1, 1), "2016-08": datetime(2016, 8, 1), "20160828": datetime(2016, 8, 28),
    "2016-08-28T10": datetime(2016, 8, 28, 10), "2016-08-28 10:30": datetime(2016, 8, 28, 10, 30),
    "2016-08-28T1030+02": datetime(2016, 8, 28, 8, 30), "2016-08-28T24:00": datetime(2016, 8, 29),
    "2016-08-28T10:00:00.123456789Z": datetime(2016, 8, 28, 10, 0, 0, 123456),
    "20160828T103000,5-0330": datetime(2016, 8, 28, 14, 0, 0, 500000),
    "2016-08-28T10:00:00+19:00": datetime(2016, 8, 27, 15),
    "2016-W34-7": datetime(2016, 8, 28), "2016W347": datetime(2016, 8, 28), "2016-W34": datetime(2016, 8, 22),
    "2015-W53-5T10:30Z": datetime(2016, 1, 1, 10, 30), "2016W01": datetime(2016, 1, 4), "2009-W01-1": datetime(2008, 12, 29),
    "2016-241": datetime(2016, 8, 28), "2016241T103000+0200": datetime(2016, 8, 28, 8, 30), "2016-366": datetime(2016, 12, 31),
    "2015-366": None, "2016-000": None, "2016-W54": None, "2016-W00-1": None, "2016-W34-8": None, "0000-W01": None,
    "2016-02-30": None, "2016-8-28": None, "1472056400": None, "2016-08-28T24:01": None, "x": None, "": None,
    "2016-08-28T10:3000": None, "0000-01-01": None, "2016-08-28T10:00:60Z": None,
}


def test_iso(spark):
    rows = spark.createDataFrame([(t,) for t in ISO], "t string")
    got = {r.t: r.us for r in rows.select("t", I.iso_micros(F.col("t")).alias("us")).collect()}
    assert got == {t: None if v is None else micros(v) for t, v in ISO.items()}


def test_numbers(spark):
    rows = spark.createDataFrame([(t,) for t in ["1.5", " 2 ", "1e3", "1d", "nan", "-0.000001", "1_0"]], "t string")
    us = I.epoch_micros(I.number_in_text(F.col("t")))
    assert [r.us for r in rows.select(us.alias("us")).collect()] == [1500000, 2000000, 10**9, None, None, -1, None]
    out = spark.range(1).select(I.epoch_micros(F.lit(1e18)).alias("a"), I.epoch_micros(F.lit(1472056400.123456)).alias("b"))
    assert tuple(out.first()) == (None, 1472056400123456)


def test_strptime_round_trip(spark):
    moment = datetime(2016, 8, 28, 13, 2, 3, 250000, tzinfo=timezone.utc)
    for fmt in ("%Y-%m-%d %H:%M:%S.%f", "%d/%b/%Y:%H:%M:%S.%f %z", "%Y%m%d %H%M%S.%f", "%m/%d/%y %I:%M:%S.%f %p",
                "%A %d %B %Y at %H:%M:%S.%f", "it's %Y-%j %T.%f"):
        text = moment.strftime(fmt)
        row = spark.range(1).select(
            I.strptime_micros(F.lit(text), fmt).alias("us"),
            I.format_micros(F.lit(micros(moment)), fmt).alias("t"),
        ).first()
        assert (row.us, row.t) == (micros(moment), text), fmt


def test_unsupported_directive():
    with pytest.raises(ValueError):
        I.date_pattern("%Q")
