"""Time range of all events, of each file, or of each group: one partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NoTimestampsError(ValueError):
    """A shift was asked for, but no record holds a readable instant."""


def earliest_of(instants: list[Column]) -> Column:
    return F.least(*instants) if len(instants) > 1 else instants[0]


def latest_of(instants: list[Column]) -> Column:
    return F.greatest(*instants) if len(instants) > 1 else instants[0]


def range_by(df: DataFrame, instants: list[Column], keys: list[Column]) -> DataFrame:
    """Events, earliest and latest instant (any field) for each key.

    Only counts and extremes are exchanged, at most one row per key and task, so a key that holds
    most of the rows costs no more than any other.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(earliest_of(instants)).alias("earliest"),
        F.max(latest_of(instants)).alias("latest"),
    )


def range_with_files(df: DataFrame, instants: list[Column], file: Column) -> DataFrame:
    """One row: the range and the (first by name) file that holds each end of it."""
    per_file = range_by(df, instants, [file.alias("file")])
    return per_file.agg(
        F.sum("events").alias("events"),
        F.min("earliest").alias("earliest"),
        F.max("latest").alias("latest"),
        F.min(F.when(F.col("earliest").isNotNull(), F.struct("earliest", "file"))).alias("_lo"),
        F.min_by("file", F.struct(-F.unix_micros(F.col("latest").cast("timestamp")), F.col("file")))
        .alias("latest_file"),
    ).select(
        "events", "earliest", "latest", F.col("_lo.file").alias("earliest_file"), "latest_file"
    )


def require_range(df: DataFrame, instants: list[Column]) -> tuple[int, int]:
    """Earliest and latest as microseconds; raises when nothing is readable."""
    row = df.agg(
        F.min(earliest_of(instants)).alias("lo"), F.max(latest_of(instants)).alias("hi")
    ).select(
        F.unix_micros(F.col("lo").cast("timestamp")).alias("lo"),
        F.unix_micros(F.col("hi").cast("timestamp")).alias("hi"),
    ).first()
    if row is None or row.lo is None:
        raise NoTimestampsError(
            "no readable timestamp in any record; check the field patterns, or replay unshifted"
        )
    return row.lo, row.hi


def span_hours(earliest: Column, latest: Column) -> Column:
    us = F.unix_micros(latest.cast("timestamp")) - F.unix_micros(earliest.cast("timestamp"))
    return us / F.lit(3.6e9)
