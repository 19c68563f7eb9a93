"""Records for an HTTP event collector: envelopes, raw lines and request batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import epoch_of, variant_value
from tidemark.operators.extract import json_object

# Limits of one request.
MAX_BODY_BYTES = 4 * 1024 * 1024
MAX_EVENTS = 1000


@dataclass(frozen=True)
class EnvelopeOptions:
    index: str | None = None
    default_host: str | None = None
    source: str | None = None
    sourcetype: str | None = None
    time_field: str = "_time"
    raw_field: str = "_raw"
    host_field: str = "host"
    source_field: str = "source"
    sourcetype_field: str = "sourcetype"


def _field(data: Column, name: str) -> Column:
    """A field of the record, SQL NULL where it is absent or JSON null."""
    v = F.try_element_at(data, F.lit(name))
    return F.when(~F.is_variant_null(v), v)


def _filled(v: Column) -> Column:
    """NULL for values that count as nothing: empty text, zero, false, empty object or list."""
    return F.when(~F.to_json(v).isin('""', "0", "false", "{}", "[]", "null"), v)


def parsed_event(text: Column) -> Column:
    return json_object(F.trim(text))


def envelope(
    text: Column, data: Column, options: EnvelopeOptions, file_sourcetype: Column | None = None
) -> Column:
    """JSON of ``event, time, host, source, sourcetype, index`` for a serialised record.

    ``data`` is :func:`parsed_event` of ``text``. The event is the raw field if it holds something,
    else the whole object; text that is not an object is sent as it is. Fixed options win over
    fields of the record; empty keys are left out.
    """
    def lit(value: str | None) -> Column:
        return F.lit(value or None).cast("string").cast("variant")

    raw = _field(data, options.raw_field)
    raw = F.when(F.to_json(raw) != '""', raw)
    whole = F.when(data.isNotNull(), F.to_variant_object(data))
    seconds = epoch_of(variant_value(_field(data, options.time_field)))
    by_file = F.lit(None).cast("variant") if file_sourcetype is None else _filled(
        file_sourcetype.cast("variant")
    )
    return F.to_json(
        F.struct(
            F.coalesce(raw, whole, text.cast("variant")).alias("event"),
            seconds.cast("decimal(20,6)").alias("time"),
            F.coalesce(lit(options.default_host), _filled(_field(data, options.host_field))).alias("host"),
            F.coalesce(lit(options.source), _filled(_field(data, options.source_field))).alias("source"),
            F.coalesce(
                lit(options.sourcetype), _filled(_field(data, options.sourcetype_field)), by_file
            ).alias("sourcetype"),
            lit(options.index).alias("index"),
        )
    )


def envelopes(
    df: DataFrame, text: str, options: EnvelopeOptions, file_sourcetype: str | None = None
) -> DataFrame:
    """Add ``envelope``; the record is parsed once."""
    by_file = None if file_sourcetype is None else F.col(file_sourcetype)
    staged = df.withColumn("_parsed", parsed_event(F.col(text)))
    made = envelope(F.col(text), F.col("_parsed"), options, by_file)
    return staged.withColumn("envelope", made).drop("_parsed")


def raw_line(text: Column, data: Column, raw_field: str = "_raw") -> Column:
    """The raw field if it holds something, else the text itself."""
    raw = _filled(_field(data, raw_field))
    return F.coalesce(F.try_variant_get(raw, "$", "string"), text)


def pack(
    df: DataFrame, line: str, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Group lines into request bodies: ``body, events, bytes``.

    Greedy and in order within a partition; a line larger than the limit travels alone. Memory per
    task is one body. Partitions are packed independently, so nothing is shuffled.
    """

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size = 0

        def body() -> pd.DataFrame:
            return pd.DataFrame({"body": ["\n".join(held)], "events": [len(held)], "bytes": [size]})

        for frame in frames:
            for text in frame["line"]:
                cost = len(text.encode()) + 1
                if held and (len(held) >= max_events or size + cost > max_bytes):
                    yield body()
                    held, size = [], 0
                held.append(text)
                size += cost
        if held:
            yield body()

    return (
        df.select(F.col(line).alias("line"))
        .filter(F.col("line").isNotNull())
        .mapInPandas(greedy, "body string, events long, bytes long")
    )


def pack_by_file(
    df: DataFrame, line: str, file: str, order: str, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Group lines into request bodies of one file each: ``file, place, body, events, bytes``.

    Lines of a file are packed by ``order``, ``place`` counts its bodies. A file is one task's work, as the
    order of its bodies asks for; memory per task is one body.
    """

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size, place, current = 0, 0, None

        def body() -> pa.RecordBatch:
            row = {"file": current, "place": place, "body": "\n".join(held), "events": len(held), "bytes": size}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist()):
                cost = len(text.encode()) + 1
                if held and (name != current or len(held) >= max_events or size + cost > max_bytes):
                    yield body()
                    held, size, place = [], 0, place + 1
                if name != current:
                    current, place = name, 0
                held.append(text)
                size += cost
        if held:
            yield body()

    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("body", pa.string()), ("events", pa.int64()), ("bytes", pa.int64())])
    rows = df.select(F.col(file).cast("string").alias("file"), F.col(order).alias("order"), F.col(line).alias("line"))
    rows = rows.filter(F.col("line").isNotNull()).repartition("file").sortWithinPartitions("file", "order")
    return rows.mapInArrow(greedy, "file string, place long, body string, events long, bytes long")


def dry_run(df: DataFrame, envelope_column: str = "envelope", shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """A few envelopes to look at, and the count of all of them."""
    sample = df.select(envelope_column).limit(shown)
    return sample, df.agg(F.count(F.lit(1)).alias("events"))


def request_params(options: EnvelopeOptions, sourcetype: str | None = None) -> dict[str, str]:
    """Per-request parameters of raw mode."""
    given = {
        "sourcetype": options.sourcetype or sourcetype, "index": options.index,
        "source": options.source, "host": options.default_host,
    }
    return {k: v for k, v in given.items() if v}


def endpoint(base_url: str, raw: bool = False) -> str:
    """Full address of the collector; the service path is added when it is not there."""
    service = "/services/collector"
    base = base_url.rstrip("/")
    return base if service in base else base + service + ("/raw" if raw else "/event")
