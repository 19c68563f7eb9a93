"""Time expressions: ``now``, ``earliest``, ``latest`` or an ISO instant, plus signed offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import instants as I

# Seconds per unit (a month is 30 days, a year 365).
UNIT_SECONDS = {
    "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mon": 2592000, "y": 31536000,
}
ANCHORS = ("now", "earliest", "latest")

_OFFSET = r"([-+])(\d+)(mon|[smhdwy])"
_RELATIVE = re.compile(rf"(now|earliest|latest)((?:[-+]\d+(?:mon|[smhdwy]))*)", re.IGNORECASE)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(moment: datetime) -> int:
    """Driver-side instant to microseconds; a naive one is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - _EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


@dataclass(frozen=True)
class TimeExpression:
    anchor: str  # one of ANCHORS, or ISO text
    offset_seconds: int = 0

    def resolve(self, now: int, earliest: int | None = None, latest: int | None = None) -> int:
        """Microseconds; ``now`` is passed in so that a run has one clock."""
        known = {"now": now, "earliest": earliest, "latest": latest}
        start = known[self.anchor] if self.anchor in known else micros(_iso(self.anchor))
        if start is None:
            raise ValueError(f"{self.anchor!r} needs the time range of the events")
        return start + self.offset_seconds * I.SECOND


def _iso(text: str) -> datetime:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not a time expression: {text!r}") from None


def parse_time_expression(text: str) -> TimeExpression:
    """Read an expression; keywords and units in any letter case."""
    relative = _RELATIVE.fullmatch(text.strip())
    if relative is None:
        _iso(text.strip())
        return TimeExpression(text.strip())
    total = sum(
        (1 if sign == "+" else -1) * int(count) * UNIT_SECONDS[unit.lower()]
        for sign, count, unit in re.findall(_OFFSET, relative[2], re.IGNORECASE)
    )
    return TimeExpression(relative[1].lower(), total)


def time_expression_micros(text: Column, now: Column, earliest: Column, latest: Column) -> Column:
    """The same language evaluated per row, NULL for text that is not an expression."""
    low = F.lower(F.trim(text))
    seconds = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    offsets = F.regexp_extract_all(low, F.lit(r"([-+]\d+(?:mon|[smhdwy]))"), F.lit(1))

    def one(offset: Column) -> Column:
        size = F.regexp_extract(offset, r"(\d+)", 1).try_cast("bigint")
        unit = F.regexp_extract(offset, r"([a-z]+)", 1)
        sign = F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        return sign * size * F.try_element_at(seconds, unit).cast("bigint")

    total = F.aggregate(F.transform(offsets, one), F.lit(0).cast("bigint"), lambda a, x: a + x)
    anchor = F.regexp_extract(low, r"^(now|earliest|latest)", 1)
    start = F.when(anchor == "now", now).when(anchor == "earliest", earliest).otherwise(latest)
    relative = low.rlike(r"^(?:now|earliest|latest)(?:[-+]\d+(?:mon|[smhdwy]))*\z")
    return F.when(relative, start + total * F.lit(I.SECOND)).otherwise(I.iso_micros(F.trim(text)))
