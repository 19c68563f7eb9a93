"""Values of dynamically typed fields: what a field holds, and reading an instant from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import instants as I


class Value:
    """Readings of one field; each is NULL where the reading does not apply.

    Given a variant, its text and number are read from it when they are asked for.
    """

    def __init__(
        self,
        text: Column | None = None,
        number: Column | None = None,
        instant: Column | None = None,
        variant: Column | None = None,
    ):
        self.variant = variant
        self._text, self._number, self._instant = text, number, instant

    @property
    def text(self) -> Column:
        if self._text is not None:
            return self._text
        if self.variant is None:
            return F.lit(None).cast("string")
        kind = F.schema_of_variant(self.variant)
        return F.when(kind == "STRING", F.try_variant_get(self.variant, "$", "string"))

    @property
    def number(self) -> Column:
        if self._number is not None:
            return self._number
        if self.variant is None:
            return F.lit(None).cast("double")
        kind = F.schema_of_variant(self.variant)
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        return F.when(numeric, F.try_variant_get(self.variant, "$", "double"))

    @property
    def instant(self) -> Column:
        return self._instant if self._instant is not None else F.lit(None).cast("bigint")


def variant_value(v: Column) -> Value:
    return Value(variant=v)


def typed_value(col: Column, dtype: T.DataType) -> Value:
    """A column of a declared schema."""
    if isinstance(dtype, T.VariantType):
        return Value(variant=col)
    if isinstance(dtype, T.StringType):
        return Value(text=col)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return Value(number=col.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return Value(instant=F.unix_micros(col.cast("timestamp")))
    return Value()


def read_instant(value: Value, fmt: str) -> Column:
    """Microseconds read from ``value`` by a format name or strftime pattern, else NULL.

    ISO, free-form and strftime formats need text; epoch formats take a number or numeric text.
    """
    if fmt in I.ISO_NAMES:
        parsed = I.iso_micros(value.text)
    elif fmt == "auto":
        parsed = I.auto_micros(value.text)
    elif fmt in I.EPOCH_SECONDS or fmt in I.EPOCH_MILLIS:
        number = F.coalesce(value.number, I.number_in_text(value.text))
        parsed = I.epoch_micros(number) if fmt in I.EPOCH_SECONDS else I.epoch_millis_micros(number)
    else:
        parsed = I.strptime_micros(value.text, fmt)
    return F.coalesce(value.instant, parsed)


def epoch_of(value: Value) -> Column:
    """Epoch seconds (double) of a number, numeric text or ISO text, else NULL."""
    return F.coalesce(
        value.number,
        I.number_in_text(F.trim(value.text)),
        I.iso_micros(F.trim(value.text)).cast("double") / F.lit(1e6),
        value.instant.cast("double") / F.lit(1e6),
    )
