"""The replay map ``new_base + (t - base) * factor``, cut at a ceiling, in whole microseconds.

The factor is a double. Its product with a microsecond count is taken exactly, as a ratio of two
integers, and rounded half to even; no precision is lost to floating point.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.bind import let, whole_div
from tidemark.functions.instants import FIRST_MICRO, LAST_MICRO

_SPAN = LAST_MICRO - FIRST_MICRO
_LONG_MAX = 2**63 - 1
_DECIMAL_MAX = 10**38 - 1


def scale_exactly(delta: int, factor: float) -> int:
    """Driver-side twin of :func:`scaled`."""
    return round(Fraction(factor) * delta)


def _half_even(n: Column, d: Column) -> Column:
    q = whole_div(n, d)
    r = F.abs(n % d)
    up = (r > d - r) | ((r == d - r) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, F.signum(n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def scaled(delta: Column, factor: float) -> Column:
    """``delta * factor`` in microseconds for a factor known when the query is built."""
    num, den = float(factor).as_integer_ratio()
    if num > _DECIMAL_MAX or den > _DECIMAL_MAX:
        raise ValueError(f"factor out of range: {factor}")
    if (num, den) == (1, 1):
        return delta
    if den == 1:
        return F.try_multiply(delta, F.lit(num)) if num <= _LONG_MAX else F.lit(None).cast("bigint")
    if num * _SPAN <= _LONG_MAX:
        return let(delta * F.lit(num), lambda n: _half_even(n, F.lit(den)))
    product = delta.cast("decimal(19,0)") * F.lit(num).cast("decimal(18,0)")
    return let(product.cast("decimal(38,0)"), lambda n: _half_even(n, _decimal(den)))


def scaled_by(delta: Column, factor: Column) -> Column:
    """The same for a factor held in a column (one per dataset)."""
    two = F.lit(2.0)
    # factor = numerator / 2**power with a numerator that fits a bigint
    power = F.greatest(F.lit(0), F.lit(53) - F.floor(F.log2(factor)).cast("int"))
    half = F.floor(power / 2).cast("int")

    def ratio(p: Column) -> Column:
        numerator = (factor * F.pow(two, p)).cast("bigint").cast("decimal(19,0)")
        denominator = F.pow(two, half).cast("bigint").cast("decimal(19,0)") * F.pow(
            two, p - half
        ).cast("bigint").cast("decimal(18,0)")
        product = delta.cast("decimal(19,0)") * numerator
        return let(
            product.cast("decimal(38,0)"),
            lambda n: _half_even(n, denominator.cast("decimal(38,0)")),
        )

    return F.when(factor == 1.0, delta).otherwise(let(power, ratio))


@dataclass(frozen=True)
class Affine:
    """The map with its parameters as Columns; ``factor`` may be a number or a Column."""

    base: Column
    new_base: Column
    factor: float | Column
    ceiling: Column | None = None

    def scaled_delta(self, us: Column) -> Column:
        delta = us - self.base
        if isinstance(self.factor, Column):
            return scaled_by(delta, self.factor)
        return scaled(delta, self.factor)

    def _move(self, us: Column, finish) -> Column:
        """``finish`` of the moved instant; NULL when it falls outside the calendar."""
        if not isinstance(self.factor, Column) and self.factor == 1.0:
            step = self.new_base - self.base
            inside = us.between(F.lit(FIRST_MICRO) - step, F.lit(LAST_MICRO) - step)
            return F.when(inside, finish(us + step))
        inside = lambda m: m.between(F.lit(FIRST_MICRO), F.lit(LAST_MICRO))
        return let(
            self.new_base + self.scaled_delta(us), lambda m: F.when(inside(m), finish(m))
        )

    def uncapped(self, us: Column) -> Column:
        return self._move(us, lambda m: m)

    def __call__(self, us: Column) -> Column:
        if self.ceiling is None:
            return self.uncapped(us)
        return self._move(us, lambda m: F.least(m, self.ceiling))

    def timestamp(self, ts: Column) -> Column:
        return F.timestamp_micros(self(F.unix_micros(ts)))
