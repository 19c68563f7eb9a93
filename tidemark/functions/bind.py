"""Small expression helpers shared by the Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``; the result must have an order.

    The one element is taken as the greatest: an element by its place asks the whole expression below for its
    type in every row, which costs more than most bodies do.
    """
    return F.array_max(F.transform(F.array(value), body))


def let_any(value: Column, body: Callable[[Column], Column]) -> Column:
    """The same for results without an order, such as maps and variants."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever uses them.

    The planner copies an expression into a lambda that refers to it, where it would be computed for
    every element; it does not reach through a generator of one row.
    """
    names = list(columns)
    whole = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array_repeat(whole, 1))).select(
        *[F.col(f"`{c}`") for c in df.columns if c in columns or c not in names],
        *[F.col(f"`{n}`") for n in names if n not in df.columns],
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def whole_div(n: Column, d: Column) -> Column:
    """Integer division truncating towards zero; exact for decimals too."""
    return F.call_function("div", n, d)
