"""One reader per input format. Bad records are dropped here, or kept apart by ``quarantine``."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bind import computed_once
from tidemark.functions.xmltext import fits_layout, is_xml_line, windows_event, xml_line_json
from tidemark.operators.extract import JSON_OPTIONS, json_object
from tidemark.session import cut_lineage
from tidemark.sources.listing import hadoop_uri

FORMATS = ("auto", "csv", "json", "jsonl", "text", "xml")
CSV_ROWS = 2_000
RECORD_COLUMNS = ("file_path", "file_name", "format", "raw", "data")


def _file() -> tuple[Column, Column]:
    return (
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [hadoop_uri(p) for p in ([paths] if isinstance(paths, str) else paths)]


def _reader(spark: SparkSession, pattern: str | None, lenient: bool):
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if lenient:
        reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return reader


def read_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """``file_path, file_name, block, seq, line``: every line of every file, blank ones too.

    Splits are read in parallel; gzip and bzip2 files are unpacked by their extension.
    ``block`` and ``seq`` place a line inside its file (see :func:`number_lines`).
    """
    return _reader(spark, pattern, lenient).option("lineSep", "\n").text(_paths(paths)).select(
        *_file(),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_number`` (from 1, blank lines counted) without sorting the lines.

    A split is read in order by one task, so a line's place in its split is known; only the line
    counts of the splits (one row each) are added up over a file. Both passes must cut the files
    alike: should a setting or the number of cores change the splits in between, the job fails with
    a message and no line is lost or misnumbered.
    """
    blocks = lines.groupBy("file_path", "block").agg(
        F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = cut_lineage(
        blocks.select("file_path", "block", "_first", "_n", before.alias("_before"))
    )
    joined = lines.join(starts, ["file_path", "block"], "left")
    place = F.col("seq") - F.col("_first") + 1
    message = F.lit("files were split differently in the two passes over them; read them again")
    checked = F.when(place.between(1, F.col("_n")), F.col("_before") + place)
    number = checked.otherwise(F.raise_error(message).cast("bigint"))
    return joined.withColumn("line_number", number).drop("_first", "_n", "_before")


def _present(line: Column) -> Column:
    """Lines that hold something and are UTF-8."""
    return line.rlike(r"\S") & F.is_valid_utf8(line)


def _where_parsed(df: DataFrame, data: Column) -> DataFrame:
    """Add ``data`` and drop rows where it is NULL, computing it once per row.

    (A filter would be pushed below the projection and parse a second time.)
    """
    return df.withColumn("data", F.explode(F.array_compact(F.array(data))))


def _records(df: DataFrame, fmt: Column, raw: Column) -> DataFrame:
    extra = [c for c in ("line_number",) if c in df.columns]
    return df.select("file_path", "file_name", fmt.alias("format"), raw.alias("raw"), "data", *extra)


def _line_data(line: Column, number: Column | None) -> Column:
    fields = [F.lit("line"), line.cast("variant")]
    if number is not None:
        fields += [F.lit("line_number"), number.cast("variant")]
    return F.create_map(*fields)


def _with_number(data: Column, number: Column | None) -> Column:
    if number is None:
        return data
    return F.map_concat(data, F.create_map(F.lit("line_number"), number.cast("variant")))


def _xml_data(line: Column, windows: bool) -> Column:
    free = F.when(is_xml_line(line), F.trim(line))
    if not windows:
        return json_object(xml_line_json(free))
    # an event that has more than the layout holds goes through the free-form function
    fits = fits_layout(line)
    return F.coalesce(F.when(fits, windows_event(line)), json_object(xml_line_json(F.when(~fits, free))))


def read_text(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    line_numbers: bool = False,
    xml_lines: str = "any",
    lenient: bool = False,
) -> DataFrame:
    """Plain text, one record per line that is not blank: ``data = {line}``.

    Lines that start like an XML event become the fields of that event; ``xml_lines`` is ``any``
    (any XML, through a small Arrow function), ``windows`` (the Windows event layout in the JVM, the
    function only for events with other elements) or ``off``. An XML line that cannot be parsed stays text.
    """
    lines = read_lines(spark, paths, pattern, lenient)
    if line_numbers:
        lines = number_lines(lines)
    lines = lines.filter(_present(F.col("line")))
    number = F.col("line_number") if line_numbers else None
    plain = _line_data(F.col("line"), number)
    if xml_lines == "off":
        lines = lines.withColumn("data", plain)
        return _records(lines, F.lit("text"), F.col("line"))
    lines = lines.withColumn("_xml", _xml_data(F.col("line"), xml_lines == "windows"))
    parsed = _with_number(F.col("_xml"), number)
    lines = computed_once(lines, {"data": F.coalesce(parsed, plain)})
    fmt = F.when(F.col("_xml").isNotNull(), "xml").otherwise("text")
    return _records(lines, fmt, F.col("line"))


def read_json_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """One JSON object per line; blank, malformed and non-object lines are dropped."""
    lines = read_lines(spark, paths, pattern, lenient)
    return _records(
        _where_parsed(lines, json_object(F.col("line"))), F.lit("jsonl"), F.col("line")
    )


def quarantine(
    spark: SparkSession, paths: str | Iterable[str], pattern: str | None = None
) -> DataFrame:
    """The lines that :func:`read_json_lines` drops although they hold something."""
    lines = read_lines(spark, paths, pattern).filter(F.col("line").rlike(r"\S"))
    bad = lines.filter(json_object(F.col("line")).isNull())
    return bad.select("file_path", "file_name", F.col("line").alias("raw"),
                      F.lit("not a JSON object").alias("error"))


def read_json_documents(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Whole-file JSON: an array gives a row per object in it, an object gives one row.

    A file is one value, so it must fit a task; use JSON lines for large files.
    """
    files = _reader(spark, pattern, lenient).text(_paths(paths), wholetext=True).select(
        *_file(), F.try_parse_json("value").alias("_doc")
    )
    kind = F.schema_of_variant("_doc")
    items = F.when(
        kind.startswith("ARRAY"), F.try_variant_get("_doc", "$", "array<variant>")
    ).otherwise(F.array("_doc"))
    rows = files.select("file_path", "file_name", F.explode(items).alias("_item"))
    rows = rows.filter(F.schema_of_variant("_item").startswith("OBJECT"))
    data = F.try_variant_get("_item", "$", "map<string,variant>")
    return _records(rows.withColumn("data", data), F.lit("json"), F.to_json("_item"))


def read_csv(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    multi_line: bool = True,
    lenient: bool = False,
    one_header: bool = False,
) -> DataFrame:
    """CSV with a header row; all values are strings, empty ones stay empty.

    Every file is read by its own header. A short row has empty values, further values of a long row
    are left out, blank lines too. ``multi_line`` allows line breaks inside quotes, at the price of one
    task per file; turn it off for large files without them: lines are then read in parallel and meet
    the header of their file. ``one_header`` promises that all files share one, which Spark's own parser
    then reads; a file that breaks the promise fails the job.
    """
    if one_header:
        return _read_csv_alike(spark, paths, pattern, multi_line, lenient)
    if multi_line:
        files = _reader(spark, pattern, lenient).text(_paths(paths), wholetext=True)
        files = files.select(*_file(), F.col("value").alias("line"), F.lit(None).cast("string").alias("header"))
    else:
        lines = read_lines(spark, paths, pattern, lenient)
        first = lines.groupBy("file_path").agg(F.min(F.struct("block", "seq", "line")).alias("first"))
        headers = first.select("file_path", F.col("first.line").alias("header"), "first.block", "first.seq")
        body = lines.join(headers.withColumnsRenamed({"block": "_block", "seq": "_seq"}), "file_path")
        files = body.filter((F.col("block") != F.col("_block")) | (F.col("seq") != F.col("_seq")))
        files = files.select("file_path", "file_name", "line", "header")
    rows = files.mapInArrow(_csv_rows, "file_path string, file_name string, _raw string")
    data = F.from_json("_raw", "map<string,variant>", JSON_OPTIONS)
    return _records(computed_once(rows, {"data": data}), F.lit("csv"), F.col("_raw"))


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole files, or of single lines with the header of their file, as JSON objects."""
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        for path, name, text, header in zip(*[batch.column(c).to_pylist() for c in ("file_path", "file_name", "line", "header")]):
            source = io.StringIO((text or "").removeprefix("\ufeff"), newline="")
            names = None if header is None else next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]), [])
            out: list[str] = []
            for row in csv.DictReader(source, names, restval=""):
                row.pop(None, None)
                out.append(json.dumps(row, ensure_ascii=False))
                if len(out) >= CSV_ROWS:
                    yield _csv_batch(path, name, out)
                    out = []
            if out:
                yield _csv_batch(path, name, out)


def _csv_batch(path: str, name: str, rows: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(rows)], ["file_path", "file_name", "_raw"])


def _read_csv_alike(
    spark: SparkSession, paths: str | Iterable[str], pattern: str | None, multi_line: bool, lenient: bool
) -> DataFrame:
    reader = _reader(spark, pattern, lenient).options(
        header=True, inferSchema=False, enforceSchema=False, multiLine=multi_line,
        mode="PERMISSIVE", escape='"', maxCharsPerColumn=-1, encoding="UTF-8",
    )
    rows = reader.csv(_paths(paths))
    names = rows.columns
    # Spark reads an empty value as NULL
    values = [F.coalesce(_column(n), F.lit("")) for n in names]
    data = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[v.cast("variant") for v in values])
    )
    rows = rows.select(*_file(), data.alias("data")).withColumn("_raw", F.to_json("data"))
    return _records(rows, F.lit("csv"), F.col("_raw"))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_xml(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    tag: str = "event",
    schema: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Every element ``tag``: attributes, text as ``_text``, children; repeats become lists.

    Values are strings. Without a ``schema`` the fields are found in a first pass over the data.
    """
    reader = _reader(spark, pattern, lenient).format("xml").options(
        rowTag=tag, attributePrefix="", valueTag="_text", inferSchema=False, ignoreNamespace=True
    )
    if schema:
        reader = reader.schema(schema)
    rows = reader.load(_paths(paths))
    names = [c for c in rows.columns if c != "_corrupt_record"]
    rows = rows.select(*_file(), F.to_json(F.struct(*map(_column, names))).alias("_raw"))
    data = F.from_json("_raw", "map<string,variant>", JSON_OPTIONS)
    return _records(rows.withColumn("data", data), F.lit("xml"), F.col("_raw"))


def read_auto(
    spark: SparkSession,
    paths: str | Iterable[str],
    pattern: str | None = None,
    line_numbers: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """Format by line: JSON object, else XML, else text; ``format`` tells which."""
    lines = read_lines(spark, paths, pattern, lenient)
    if line_numbers:
        lines = number_lines(lines)
    lines = lines.filter(_present(F.col("line")))
    number = F.col("line_number") if line_numbers else None
    start = F.ltrim("line")
    as_xml = F.when(start.startswith("<"), F.trim("line"))
    staged = lines.withColumns({
        "_json": F.when(start.startswith("{"), json_object(F.col("line"))),
        "_xml": json_object(xml_line_json(as_xml)),
    })
    fmt = (
        F.when(F.col("_json").isNotNull(), "jsonl")
        .when(F.col("_xml").isNotNull(), "xml")
        .otherwise("text")
    )
    data = F.coalesce("_json", _with_number(F.col("_xml"), number), _line_data(F.col("line"), number))
    return _records(computed_once(staged, {"data": data}), fmt, F.col("line"))


_READERS = {
    "auto": read_auto, "csv": read_csv, "json": read_json_documents, "jsonl": read_json_lines,
    "text": read_text, "xml": read_xml,
}


def read_records(
    spark: SparkSession, paths: str | Iterable[str], fmt: str = "auto", **options
) -> DataFrame:
    """Read by format name."""
    if fmt not in _READERS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return _READERS[fmt](spark, paths, **options)


def _place(path: Column) -> Column:
    """A path without its scheme and escapes, the same for a listed and for a read file."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def read_dataset(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All files of a dataset: each by its own format, with its sourcetype and schema.

    ``files`` (``path, format, schema, sourcetype``) is the file list of a manifest; as with any
    read, the paths are known to the driver. Files of one format are read by one scan; schema and
    sourcetype come by a join on the path.
    """
    listed = files.select(
        "path", F.coalesce("format", F.lit("auto")).alias("format"),
        F.coalesce("schema", F.lit("raw")).alias("schema"), F.col("sourcetype").cast("string").alias("sourcetype"),
    ).distinct()
    by_format: dict[str, list[str]] = {}
    for row in listed.select("format", "path").distinct().toLocalIterator():
        by_format.setdefault(row.format, []).append(row.path)
    if not by_format:
        raise ValueError("the dataset has no files")
    parts = [
        read_records(spark, sorted(paths), fmt).select(*RECORD_COLUMNS, F.lit(fmt).alias("_declared"))
        for fmt, paths in sorted(by_format.items())
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    known = listed.select(_place(F.col("path")).alias("_place"), F.col("format").alias("_format"), "schema", "sourcetype")
    same = (_place(F.col("file_path")) == F.col("_place")) & (F.col("_declared") == F.col("_format"))
    return union.join(known, same, "left").drop("_place", "_format", "_declared")


def preview(
    spark: SparkSession,
    paths: str | Iterable[str],
    lines: int = 10,
    width: int = 200,
    pattern: str | None = None,
) -> DataFrame:
    """``file_path, file_name, line_number, line``: the first lines of every file, cut to ``width``.

    One pass: a task keeps the first ``lines`` of each of its splits, so no more reach the exchange.
    """
    order = W.partitionBy("file_path").orderBy("block", "seq")
    ranked = read_lines(spark, paths, pattern).select(
        "file_path", "file_name", "block", "seq", F.left("line", F.lit(width)).alias("line")
    ).withColumn("line_number", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("line_number") <= lines).select("file_path", "file_name", "line_number", "line")
