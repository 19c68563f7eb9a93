"""The fluent front of the library: input, output, time options, run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.manifests import replay_files
from tidemark.functions.paths import template_parts
from tidemark.functions.timeexpr import micros
from tidemark.operators import stats
from tidemark.operators.bounds import require_range
from tidemark.operators.collector import (
    MAX_BODY_BYTES, MAX_EVENTS, EnvelopeOptions, endpoint, envelopes, pack, parsed_event, raw_line, request_params,
)
from tidemark.operators.extract import (
    Found, instants, instants_by_sourcetype, json_fields, map_reader,
)
from tidemark.operators.lookups import file_sourcetypes
from tidemark.operators.writeback import shift_found
from tidemark.plans.pattern_sets import SCHEMAS, Pattern, patterns_for
from tidemark.plans.shift_plan import ShiftPlan, TimeSettings, plan_shift
from tidemark.session import cut_lineage, require_utc
from tidemark.sinks.delivery import deliver
from tidemark.sinks.files import print_lines, run_dry, serialised, write_lines
from tidemark.sources.readers import FORMATS, read_dataset, read_records

OUTPUT_FORMATS = ("json", "jsonl", "text")
COMPRESSIONS = ("none", "gzip", "bzip2")


@dataclass(frozen=True)
class _Output:
    path: str | None = None
    fmt: str = "jsonl"
    template: str = "{filename}"
    compression: str | None = None
    files_per_path: int | None = None
    collector: "_Collector | None" = None


@dataclass(frozen=True)
class _Collector:
    url: str
    token: str
    options: EnvelopeOptions
    raw: bool
    delivery: dict


class Replay:
    """``Replay(spark).input_source(...).output_destination(...).set_timestamp_options(...).run()``

    ``run`` returns one row of statistics. Two passes are made over the input: one aggregation for
    the time range (none if it is declared, or without a shift) and one projection that is written.
    """

    def __init__(self, spark: SparkSession, run_time: datetime | None = None):
        self._spark = require_utc(spark)
        self._run_time = run_time or datetime.now(timezone.utc)
        self._input: str | list[str] | DataFrame | None = None
        self._format, self._schema = "auto", "raw"
        self._patterns: tuple[Pattern, ...] = ()
        self._read_options: dict = {}
        self._files: DataFrame | None = None
        self._by_sourcetype = False
        self._outputs: list[_Output] = []
        self._settings = TimeSettings()
        self._range: tuple[int, int] | None = None
        self._shift, self._keep_encoding = True, False

    def input_source(
        self, source: str | list[str] | DataFrame, fmt: str = "auto", schema: str = "raw",
        patterns: tuple[Pattern, ...] = (), **read_options,
    ) -> "Replay":
        """Paths or addresses to read, or records (``file_name``, ``data``) at hand."""
        self._input, self._format, self._schema = source, fmt, schema
        self._patterns, self._read_options = tuple(patterns), read_options
        return self

    def input_dataset(self, manifests: DataFrame, root: str, schema: str = "raw") -> "Replay":
        """The files of a dataset, each read by its format and replayed by its sourcetype.

        ``manifests`` comes from :func:`tidemark.catalog.manifests.read_manifests`; bundled paths are
        below ``root``.
        """
        self._input = read_dataset(self._spark, replay_files(manifests, root))
        self._schema, self._by_sourcetype = schema, True
        return self

    def sourcetypes(self, files: DataFrame) -> "Replay":
        """``file_name, sourcetype, position``: the sourcetype of each file."""
        self._files, self._by_sourcetype = files, True
        return self

    def output_destination(
        self, path: str | None, fmt: str = "jsonl", template: str = "{filename}",
        compression: str | None = None, files_per_path: int | None = None,
    ) -> "Replay":
        """Where to write; no path prints to the console. Each call adds a destination."""
        self._outputs.append(_Output(path, fmt, template, compression, files_per_path))
        return self

    def output_collector(
        self, url: str, token: str, options: EnvelopeOptions | None = None, raw: bool = False,
        max_events: int = MAX_EVENTS, max_bytes: int = MAX_BODY_BYTES, **delivery,
    ) -> "Replay":
        """Send the records to an HTTP event collector, as envelopes or as ``raw`` lines.

        ``delivery`` takes the options of :func:`tidemark.sinks.delivery.deliver`, such as ``parallelism``
        and ``ledger``. In raw mode the fixed fields of ``options`` go along with every request.
        """
        delivery |= {"max_events": max_events, "max_bytes": max_bytes}
        self._outputs.append(_Output(collector=_Collector(url, token, options or EnvelopeOptions(), raw, delivery)))
        return self

    def set_timestamp_options(self, **options) -> "Replay":
        """Options of :class:`TimeSettings`, and ``keep_encoding`` for numeric fields."""
        self._keep_encoding = options.pop("keep_encoding", self._keep_encoding)
        self._settings = replace(self._settings, **options)
        return self

    def declared_range(self, earliest: datetime, latest: datetime) -> "Replay":
        """A known time range; the first pass is left out."""
        self._range = (micros(earliest), micros(latest))
        return self

    def no_shift(self) -> "Replay":
        """Pass records through unchanged."""
        self._shift = False
        return self

    def validate(self) -> list[str]:
        """Problems that can be found without reading anything."""
        found = self._settings.problems()
        if self._input is None:
            found.append("no input")
        if self._format not in FORMATS:
            found.append(f"unknown input format {self._format!r}")
        if self._schema not in SCHEMAS:
            found.append(f"unknown schema {self._schema!r}")
        for out in self._outputs:
            if out.fmt not in OUTPUT_FORMATS:
                found.append(f"unknown output format {out.fmt!r}")
            if (out.compression or "none") not in COMPRESSIONS:
                found.append(f"unknown compression {out.compression!r}")
            try:
                template_parts(out.template)
            except ValueError as problem:
                found.append(str(problem))
        return found

    # -----------------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        if isinstance(self._input, DataFrame):
            rows = self._input
        else:
            rows = read_records(self._spark, self._input, self._format, **self._read_options)
        if self._files is not None:
            rows = file_sourcetypes(rows, self._files)
        elif "sourcetype" not in rows.columns:
            rows = rows.withColumn("sourcetype", F.lit(None).cast("string"))
        return rows

    def _find(self, rows: DataFrame) -> tuple[DataFrame, list[Found]]:
        read = map_reader(F.col("data"))
        if self._schema == "raw" and not self._patterns and self._by_sourcetype:
            return instants_by_sourcetype(rows, read, F.col("sourcetype"))
        return instants(rows, read, patterns_for(self._schema, None, self._patterns))

    def plan(self) -> ShiftPlan:
        """Fix the move; reads the input once unless the range is declared."""
        bounds = self._range or self._scan()
        return plan_shift(self._settings, *bounds, micros(self._run_time))

    def _scan(self) -> tuple[int, int]:
        rows = self.records()
        plain = not self._by_sourcetype or self._schema != "raw" or self._patterns
        if self._format == "jsonl" and "raw" in rows.columns and plain:
            # only the fields that hold instants are parsed
            patterns = patterns_for(self._schema, None, self._patterns)
            rows, found = instants(*json_fields(rows.select("raw"), "raw", patterns), patterns)
        else:
            rows, found = self._find(rows)
        return require_range(rows, [F.timestamp_micros(f.us) for f in found])

    def shifted(self, plan: ShiftPlan | None = None) -> DataFrame:
        """The records after the replay, unwritten."""
        rows = self.records()
        if not self._shift:
            return rows
        move = (plan or self.plan()).affine()
        staged, found = self._find(rows)
        return shift_found(
            staged, found, move, sourcetype="sourcetype", keep_encoding=self._keep_encoding
        )

    def run(self, dry_run: bool = False) -> DataFrame:
        """Read, shift and write to all destinations; one row of statistics, gathered while writing.

        Every destination is a pass of its own over the input: the shift is a projection, cheaper
        to repeat than to keep.
        """
        problems = self.validate()
        if problems:
            raise ValueError("; ".join(problems))
        plan = self.plan() if self._shift else None
        rows = self.shifted(plan)
        if plan is None:
            metrics = {"events": F.count(F.lit(1)), "events_modified": F.lit(0).cast("bigint")}
        else:
            metrics = stats.replayed_statistics(plan.affine(), micros(self._run_time))
        aggregates = [c.alias(n) for n, c in metrics.items()]
        if not self._outputs:
            return rows.agg(*aggregates)
        observed = Observation("replay")
        self._write(rows.observe(observed, *aggregates), self._outputs[0], dry_run)
        for out in [] if dry_run else self._outputs[1:]:
            self._write(rows, out, False)
        schema = rows.agg(*aggregates).schema
        return self._spark.createDataFrame([tuple(observed.get[n] for n in metrics)], schema)

    def _write(self, rows: DataFrame, out: _Output, dry_run: bool) -> None:
        raw = F.col("raw") if "raw" in rows.columns and not self._shift else None
        line = serialised(F.col("data"), out.fmt, raw)
        if dry_run:
            run_dry(rows.select(line.alias("value")))
        elif out.collector is not None:
            self._send(rows.select(line.alias("line"), "sourcetype"), out.collector)
        elif out.path is None:
            print_lines(rows, line)
        else:
            write_lines(
                rows, line, out.path, out.template, self._run_time, F.col("file_name"),
                F.col("sourcetype"), out.compression, files_per_path=out.files_per_path,
            )


    def _send(self, lines: DataFrame, to: _Collector) -> None:
        delivery = dict(to.delivery)
        limits = {name: delivery.pop(name) for name in ("max_events", "max_bytes")}
        if to.raw:
            sent = lines.select(raw_line(F.col("line"), parsed_event(F.col("line")), to.options.raw_field).alias("line"))
            delivery["params"] = request_params(to.options) | (delivery.get("params") or {})
        else:
            sent = envelopes(lines, "line", to.options, "sourcetype").select(F.col("envelope").alias("line"))
        # written first: sending is no query, so the numbers of the run would not be observed by it
        deliver(cut_lineage(pack(sent, "line", **limits)), endpoint(to.url, to.raw), to.token, **delivery)


PROFILE_RESULT = "dataset string, events long, events_modified long, error string"


def run_profile(
    spark: SparkSession,
    datasets: Mapping[str, Callable[[Replay], Replay]],
    destinations: Sequence[Callable[[Replay], Replay]],
    settings: Mapping[str, dict] | None = None,
    defaults: dict | None = None,
    run_time: datetime | None = None,
) -> DataFrame:
    """Replay each dataset of a profile to all its destinations; a row per dataset.

    ``datasets`` gives a job its input, ``destinations`` add an output each, ``settings`` are time
    options by dataset over ``defaults``. A dataset that fails has its error in the result and does not
    stop the others; all share one run time.
    """
    now = run_time or datetime.now(timezone.utc)
    rows = []
    for name, give_input in datasets.items():
        try:
            job = give_input(Replay(spark, now)).set_timestamp_options(**{**(defaults or {}), **((settings or {}).get(name, {}))})
            for add in destinations:
                job = add(job)
            done = job.run().select("events", "events_modified").first()
            rows.append((name, done.events, done.events_modified, None))
        except Exception as failure:
            first = str(failure).strip().splitlines() or [""]
            rows.append((name, None, None, f"{type(failure).__name__}: {first[0]}"))
    return spark.createDataFrame(rows, PROFILE_RESULT)
