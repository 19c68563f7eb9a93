"""The raw text operator against a row-at-a-time shifter written for this test."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.affine import scale_exactly
from tidemark.functions.timeexpr import micros, moment
from tidemark.operators.rawtext import families_by_sourcetype, shift_raw, shift_text
from tidemark.plans.shift_plan import ShiftPlan
from tidemark.plans.text_families import (
    ALL_FAMILIES, DEFAULT_FAMILIES, FAMILY_REGEX, SOURCETYPE_FAMILIES, families_for,
)

UTC = timezone.utc
BASE, NEW = datetime(2016, 8, 10, tzinfo=UTC), datetime(2026, 8, 10, tzinfo=UTC)
PLAN = ShiftPlan(micros(BASE), micros(NEW))
PYTHON = {f: re.compile(r.replace("(?md)", "(?m)"), re.ASCII) for f, r in FAMILY_REGEX.items()}


class OnePerRow:
    """Reads a match with strptime and prints it with strftime; one branch per notation."""

    def __init__(self, plan):
        self.plan = plan

    def move(self, t):
        us = micros(t)
        new = self.plan.new_base + scale_exactly(us - self.plan.base, self.plan.factor)
        return moment(new if self.plan.ceiling is None else min(new, self.plan.ceiling))

    def by_format(self, text, fmt):
        return self.move(datetime.strptime(" ".join(text.split()), fmt).replace(tzinfo=UTC)).strftime(fmt)

    def iso8601(self, text):
        body, zone = re.fullmatch(r"(.*?)(Z|[+-]\d{2}:?\d{2})?", text[10:]).groups()
        digits = body.partition(".")[2]
        offset = timedelta(0)
        if zone and zone != "Z":
            hours, minutes = int(zone[1:3]), int(zone[-2:])
            if hours > 23 or minutes > 59:
                raise ValueError
            offset = timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
            zone = zone if offset else "+" + zone[1:]  # a zero offset is printed with a plus
        whole = datetime.strptime(text[:19], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC)
        t = whole + timedelta(microseconds=int(digits.ljust(6, "0")[:6] or 0)) - offset
        new = self.move(t) + offset
        shown = f"{new.microsecond:06d}".ljust(len(digits), "0")[:len(digits)]
        return new.strftime("%Y-%m-%dT%H:%M:%S") + ("." + shown if digits else "") + (zone or "")

    def fortigate(self, text):
        return self.by_format(text, "date=%Y-%m-%d time=%H:%M:%S")

    def datetime(self, text):
        return self.by_format(text, "%Y-%m-%d %H:%M:%S")

    def panos(self, text):
        return self.by_format(text, "%Y/%m/%d %H:%M:%S")

    def compact(self, text):
        return self.by_format(text, "%Y%m%d %H:%M:%S")

    def syslog(self, text):
        year = moment(self.plan.base).year
        new = self.move(datetime.strptime(f"{year} " + " ".join(text.split()), "%Y %b %d %H:%M:%S").replace(tzinfo=UTC))
        return new.strftime("%b ") + f"{new.day:2d}" + new.strftime(" %H:%M:%S")

    def us_date(self, text):
        date, time, *half = text.split()
        clock, _, digits = time.partition(".")
        if half and int(clock[:2]) <= 12 and clock[:2] != "00":
            t = datetime.strptime(f"{date} {clock} {half[0]}", "%m/%d/%Y %I:%M:%S %p")
        else:
            t = datetime.strptime(f"{date} {clock}", "%m/%d/%Y %H:%M:%S")
            if half == ["PM"] and t.hour == 0:
                t = t.replace(hour=12)
        new = self.move(t.replace(tzinfo=UTC, microsecond=int(digits.ljust(6, "0")[:6] or 0)))
        out = new.strftime("%m/%d/%Y %I:%M:%S" if half else "%m/%d/%Y %H:%M:%S")
        out += "." + f"{new.microsecond:06d}"[:len(digits)] if digits else ""
        return out + (new.strftime(" %p") if half else "")

    def clf(self, text):
        date, zone = text[1:-1].split()
        t = datetime.strptime(f"{date} {zone}", "%d/%b/%Y:%H:%M:%S %z")
        return self.move(t).astimezone(t.tzinfo).strftime("[%d/%b/%Y:%H:%M:%S ") + zone + "]"

    def apache_error(self, text):
        _, month, day, time, year = text[1:-1].split()
        clock, _, digits = time.partition(".")
        t = datetime.strptime(f"{year} {month} {day} {clock}", "%Y %b %d %H:%M:%S").replace(tzinfo=UTC)
        new = self.move(t.replace(microsecond=int(digits.ljust(6, "0")[:6] or 0)))
        shown = "." + f"{new.microsecond:06d}"[:len(digits)] if digits else ""
        return new.strftime("[%a %b %d %H:%M:%S") + shown + new.strftime(" %Y]")

    def ctime(self, text):
        words = text.split()
        zone = " " + words[5] if len(words) > 5 else ""
        if words[1].isdigit():
            new = self.move(datetime.strptime(" ".join(words[1:5]), "%d %b %Y %H:%M:%S").replace(tzinfo=UTC))
            comma = ", " if ", " in text[:5] else " "
            return new.strftime("%a") + comma + str(new.day) + new.strftime(" %b %Y %H:%M:%S") + zone
        new = self.move(datetime.strptime(" ".join(words[1:5]), "%b %d %H:%M:%S %Y").replace(tzinfo=UTC))
        return new.strftime("%a %b ") + f"{new.day:2d}" + new.strftime(" %H:%M:%S %Y") + zone

    def audit(self, text):
        seconds, ms = text[6:16], text[17:20]
        new = self.move(moment(int(seconds) * 10**6 + int(ms) * 1000))
        return f"audit({micros(new) // 10**6}.{new.microsecond // 1000:03d}{text[20:]}"

    def epoch(self, text):
        return text[:-10] + str(micros(self.move(moment(int(text[-10:]) * 10**6))) // 10**6)

    def _ms(self, digits):
        return str(int(self.move(moment(int(digits) * 1000)).timestamp() * 1000))

    def epoch_ms(self, text):
        return text[:-13] + self._ms(text[-13:])

    def dotnet(self, text):
        return "/Date(" + self._ms(text[6:19]) + ")/"

    def text(self, line, families):
        claimed = []
        for family in families:
            for m in PYTHON[family].finditer(line):
                if any(m.start() < e and m.end() > s for s, e, _ in claimed):
                    continue
                try:
                    claimed.append((m.start(), m.end(), getattr(self, family)(m[0])))
                except ValueError:
                    pass
        for start, end, new in sorted(claimed, reverse=True):
            line = line[:start] + new + line[end:]
        return line


def random_piece(rng):
    t = datetime(2016, 1, 1) + timedelta(microseconds=rng.randrange(366 * 86400 * 10**6))
    day = f"{t.day:2d}"
    zone = rng.choice(["", "Z", "+0530", "-06:00", "-0000", "+23:59", "+99:00"])
    fraction = rng.choice(["", ".5", ".123", f".{t.microsecond:06d}", ".123456789"])
    gap = rng.choice([" ", "  ", "\t"])
    epoch, ms = int(t.replace(tzinfo=UTC).timestamp()), rng.randrange(1000)
    return rng.choice([
        t.strftime("%Y-%m-%dT%H:%M:%S") + fraction + zone,
        t.strftime(f"date=%Y-%m-%d{gap}time=%H:%M:%S"),
        "\n" + t.strftime("%b ") + day + t.strftime(" %H:%M:%S"),
        t.strftime(f"%m/%d/%Y{gap}%H:%M:%S") + fraction,
        t.strftime(f"%m/%d/%Y{gap}%I:%M:%S") + fraction + t.strftime(f"{gap}%p"),
        t.strftime(f"%m/%d/%Y %H:%M:%S{gap}PM"), t.strftime(f"%Y-%m-%d{gap}%H:%M:%S"),
        t.strftime(f"%Y/%m/%d{gap}%H:%M:%S"), t.strftime(f"%Y%m%d{gap}%H:%M:%S"),
        t.strftime("[%d/%b/%Y:%H:%M:%S") + f"{gap}{rng.choice(['-0600', '+0000', '+2460'])}]",
        t.strftime(f"[%a{gap}%b %d %H:%M:%S") + fraction + t.strftime(" %Y]"),
        t.strftime(f"%a,{gap}{t.day} %b %Y{gap}%H:%M:%S") + rng.choice(["", " GMT", " ABCDEFG"]),
        t.strftime(f"%a %b{gap}%d %H:%M:%S %Y") + rng.choice(["", f"{gap}UTC"]),
        f"audit({epoch}.{ms:03d}:77)", f'"createdTime": {epoch}{ms:03d}', f"/Date({epoch}{ms:03d})/",
        f'"timestamp" : {epoch}', f'"_time":{epoch}', str(epoch), "2016-02-30T10:00:00Z", "02/30/2016 10:00:00",
        "[Wed Feb 31 10:00:00 2016]", "99999999 10:00:00", "éЖ 10:00", "Feb 29 10:00:00", "x", "\u0001", "\u0002y",
    ])


def random_lines(n, seed):
    rng = random.Random(seed)
    glue = [" ", "", " | ", "-", "T", "1", "\n", "[", "\""]
    return ["".join(random_piece(rng) + rng.choice(glue) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def moved(spark, lines, plan, families):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    out = rows.select("i", shift_text(F.col("line"), plan.affine(), families).alias("new")).collect()
    return [r.new for r in sorted(out)]


@pytest.mark.parametrize("plan", [
    PLAN, ShiftPlan(micros(BASE), micros(NEW), 0.5), ShiftPlan(micros(BASE), micros(NEW), 0.1, micros(NEW) + 10**12),
    ShiftPlan(micros(datetime(2015, 3, 1)), micros(datetime(2031, 5, 5, 1, 2, 3, 4)), 2.0),
], ids=["factor 1", "half", "tenth, ceiling", "double, other year"])
@pytest.mark.parametrize("families", [ALL_FAMILIES, DEFAULT_FAMILIES, ("syslog", "ctime"), ("datetime",)],
                         ids=["all", "default", "syslog", "one"])
def test_against_row_at_a_time(spark, plan, families):
    lines = random_lines(1500, seed=len(families))
    slow = OnePerRow(plan)
    for line, new in zip(lines, moved(spark, lines, plan, families)):
        assert new == slow.text(line, families), repr(line)


def test_there_and_back(spark):
    lines = [t.replace("\t", " ").replace("  ", " ") for t in random_lines(300, 5)]
    lines = [line for line in lines if not re.search(r"[AP]M|-0000|\.\d{7}|[A-Z][a-z]{2} +\d", line)]
    back = ShiftPlan(PLAN.new_base, PLAN.base)
    assert moved(spark, moved(spark, lines, PLAN, ALL_FAMILIES), back, ALL_FAMILIES) == lines


def test_known_lines(spark):
    cases = {
        "2016-08-28T23:58:59.931869-0600 x": "2026-08-28T23:58:59.931869-0600 x",
        "2016-08-28T23:58:59.123456789Z": "2026-08-28T23:58:59.123456000Z",
        "08/28/2016 11:54:31.123 PM": "08/28/2026 11:54:31.123 PM",
        "08/28/2016 12:00:00 AM": "08/28/2026 12:00:00 AM",
        "Sep  1 08:00:00 host\nAug 28 09:00:00 host": "Sep  1 08:00:00 host\nAug 28 09:00:00 host",
        "id 1472056400 stays": "id 1472056400 stays",
        "[Wed Aug 24 14:32:52.123456 2016] e": "[Mon Aug 24 14:32:52.123456 2026] e",
    }
    assert moved(spark, list(cases), PLAN, ALL_FAMILIES) == list(cases.values())


def test_no_families_and_null(spark):
    rows = spark.createDataFrame([("2016-08-28 10:00:00",), (None,)], "t string")
    out = rows.select(shift_text(F.col("t"), PLAN.affine(), ()).alias("a"), shift_text(F.col("t"), PLAN.affine()).alias("b"))
    assert [tuple(r) for r in out.collect()] == [("2016-08-28 10:00:00", "2026-08-28 10:00:00"), (None, None)]


def test_every_sourcetype(spark):
    names = [*SOURCETYPE_FAMILIES, None, "", "WinEventLog:X", "XmlWinEventLog:Y", "mysql:z", "ms:o365:q", "o365:z", "code42:n"]
    rows = spark.createDataFrame([(n,) for n in names], "st string")
    got = [tuple(r.f) for r in rows.select(families_by_sourcetype(F.col("st")).alias("f")).collect()]
    assert got == [families_for(n) for n in names]


def test_families_by_row(spark):
    rng = random.Random(3)
    names = ["code42:security", "syslog", "cpu", "aws:rds:audit", "pan:traffic", "other", None]
    lines = [(line, rng.choice(names)) for line in random_lines(600, 11)]
    rows = spark.createDataFrame([(i, *pair) for i, pair in enumerate(lines)], "i int, line string, st string")
    out = shift_raw(rows, "line", PLAN.affine(), "st").orderBy("i").collect()
    slow = OnePerRow(PLAN)
    for (line, name), row in zip(lines, out):
        assert row.line == slow.text(line, families_for(name)), (name, line)


def test_text_and_sourcetype_are_looked_at_once(spark):
    """What a lambda refers to is computed at each use: the lookup among all sourcetypes was made for each family."""
    built = str(shift_text(F.col("the_text"), PLAN.affine(), sourcetype=F.col("the_kind")))
    assert built.count("the_kind") == 1
    assert built.count("the_text") == 2


def test_private_mark_in_text_stays(spark):
    texts = ["a \ue000 2016-08-10T00:00:05Z b\ue000", "\ue000", "2016-08-10T00:00:05Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(shift_text(F.col("t"), PLAN.affine()).alias("t"))
    assert [r.t for r in rows.collect()] == [t.replace("2016", "2026") for t in texts]


def test_a_match_that_stands_twice_is_taken_where_it_matches(spark):
    plan = ShiftPlan(0, 86_400_000_000, 1.0, None).affine()
    lines = ["T2024-01-01 00:00:00 2024-01-01 00:00:00", "2024-01-01 00:00:00", "é 2024-01-01 00:00:00 é", "12024-01-01 00:00:00, 2024-01-01 00:00:00"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    found = [r[0] for r in rows.select(shift_text(F.col("line"), plan, ALL_FAMILIES)).collect()]
    assert found == ["T2024-01-01 00:00:00 2024-01-02 00:00:00", "2024-01-02 00:00:00", "é 2024-01-02 00:00:00 é", "12024-01-01 00:00:00, 2024-01-02 00:00:00"]


def test_what_is_no_day_is_told_before_the_cast(spark):
    from tidemark.functions.rawmoves import _NOWHEN

    clocks = [(f"{y}-{m:02}-{d:02}", "10:00:00") for y in (2023, 2024) for m in range(14) for d in range(34)]
    clocks += [("2024-01-01", f"{h:02}:{m:02}:{s:02}") for h in (0, 9, 19, 20, 23, 24, 25, 30) for m in (0, 59, 60, 99) for s in (0, 59, 60, 61)]
    rows = spark.createDataFrame([(f"{d}{t}{c}",) for d, c in clocks for t in " T"], "x string")
    rows = rows.select("x", F.col("x").rlike(_NOWHEN).alias("none"), F.concat("x", F.lit("Z")).try_cast("timestamp").isNull().alias("unread"))
    # left to the cast is only the 29th of February
    assert {r.x[:10] for r in rows.filter("none <> unread").collect()} == {"2023-02-29"}


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark):
    from tidemark.queries import load

    moved = load()[0]["raw_text_overlap"](spark, "/root/testdata/sf0.01")
    sizes = [r[1] for r in moved.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
