"""Manifest files to tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lookups import uncovered_references

MAX_MANIFEST_BYTES = 10 * 1024 * 1024

_LOG_SOURCE = (
    "struct<vendor:string,product:string,category:string,subcategory:string,event_ids:array<string>>"
)
_FILE = (
    "description:string,format:string,schema:string,sourcetype:string,"
    f"log_source:{_LOG_SOURCE},platforms:map<string,variant>"
)
MANIFEST = (
    "struct<metadata:struct<name:string,version:string,description:string,author:string,"
    "created:string,updated:string,license:string,tags:array<string>,"
    "timestamp_range:struct<earliest:string,latest:string,field:string>,"
    "mitre_attack:struct<techniques:array<struct<id:string,name:string,tactics:array<string>>>,"
    "tactics:array<string>>>,"
    f"files:struct<bundled:array<struct<path:string,event_count:bigint,{_FILE}>>,"
    f"references:array<struct<uri:string,checksum:string,{_FILE}>>>,"
    "dependencies:array<struct<dataset:string,version:string,description:string>>,"
    "defaults:struct<echo:map<string,variant>,replay:map<string,variant>,schema:string,"
    "input:map<string,variant>>,"
    "collection_environment:variant>"
)


def _yaml_converter():
    """The YAML step of :func:`read_manifests`, built so that it travels to the executors by value."""

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError:
            raise RuntimeError("YAML manifests need the yaml package; JSON manifests do not") from None

        def to_json(text: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return None

        for frame in frames:
            yield frame.assign(json=frame["value"].map(to_json))

    return convert


def _loaded(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """``path, size, json, manifest`` of every file; JSON and manifest are NULL where there is none."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(paths, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
            "value",
        )
        .filter(F.col("size") <= MAX_MANIFEST_BYTES)
    )
    is_json = F.col("path").endswith(".json")
    native = files.filter(is_json).withColumn("json", F.col("value"))
    other = files.filter(~is_json)
    converted = native
    if not other.isEmpty():
        converted = native.unionByName(
            other.mapInPandas(_yaml_converter(), "path string, size long, value string, json string")
        )
    return converted.select("path", "size", "json", F.from_json("json", MANIFEST).alias("manifest"))


def read_manifests(
    spark: SparkSession, paths: str | list[str], pattern: str = "dataset.{yaml,yml,json}"
) -> DataFrame:
    """``path, size, manifest`` of every readable manifest below ``paths``.

    JSON manifests are parsed by Spark; others go through the YAML parser, an Arrow batch at a time.
    What is left out, and why, is in :func:`manifest_problems`.
    """
    parsed = _loaded(spark, paths, pattern).select("path", "size", "manifest")
    return parsed.filter(F.col("manifest.metadata.name").isNotNull())


def manifest_problems(
    spark: SparkSession, paths: str | list[str], pattern: str = "dataset.{yaml,yml,json}"
) -> DataFrame:
    """``path, problem`` of every manifest that :func:`read_manifests` leaves out."""
    sizes = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(paths).filter(F.col("length") > MAX_MANIFEST_BYTES)
    )
    large = sizes.select("path", F.lit(f"larger than {MAX_MANIFEST_BYTES} bytes").alias("problem"))
    loaded = _loaded(spark, paths, pattern)
    readable = F.try_parse_json("json").isNotNull()
    problem = (
        F.when(~F.coalesce(readable, F.lit(False)), "cannot be parsed")
        .when(F.col("manifest.metadata.name").isNull(), "has no name")
    )
    bad = loaded.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())
    return bad.unionByName(large)


def _meta(name: str) -> Column:
    return F.col(f"manifest.metadata.{name}").alias(name)


def datasets(manifests: DataFrame) -> DataFrame:
    """One row per dataset; settings under the old key ``replay`` are read as ``echo``."""
    return manifests.select(
        "path", _meta("name"), _meta("version"), _meta("description"), _meta("author"),
        _meta("created"), _meta("updated"), _meta("license"),
        F.coalesce("manifest.metadata.tags", F.array().cast("array<string>")).alias("tags"),
        _meta("timestamp_range"),
        F.col("manifest.metadata.mitre_attack.techniques").alias("techniques"),
        F.col("manifest.metadata.mitre_attack.tactics").alias("tactics"),
        F.coalesce("manifest.defaults.echo", "manifest.defaults.replay").alias("replay_defaults"),
        F.col("manifest.collection_environment").alias("collection_environment"),
    )


def files(manifests: DataFrame) -> DataFrame:
    """One row per bundled or referenced file, in the order of the manifest."""
    def part(kind: str, path: str) -> DataFrame:
        rows = manifests.select(
            F.col("manifest.metadata.name").alias("dataset"),
            F.posexplode(f"manifest.files.{kind}").alias("position", "f"),
        )
        count = F.col("f.event_count") if kind == "bundled" else F.lit(None).cast("bigint")
        check = F.col("f.checksum") if kind == "references" else F.lit(None).cast("string")
        return rows.select(
            "dataset", F.lit(kind).alias("kind"), "position", F.col(f"f.{path}").alias("path"),
            F.coalesce("f.format", F.lit("auto")).alias("format"), "f.schema", "f.sourcetype",
            count.alias("event_count"), check.alias("checksum"), "f.log_source", "f.platforms",
        )

    return part("bundled", "path").unionByName(part("references", "uri"))


def techniques(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        F.col("manifest.metadata.name").alias("dataset"),
        F.explode("manifest.metadata.mitre_attack.techniques").alias("t"),
    ).select("dataset", F.col("t.id").alias("technique"), F.col("t.name").alias("technique_name"), "t.tactics")


def dependencies(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        F.col("manifest.metadata.name").alias("dataset"),
        F.posexplode("manifest.dependencies").alias("position", "d"),
    ).select(
        "dataset", "position", F.col("d.dataset").alias("dependency"),
        F.coalesce("d.version", F.lit("*")).alias("version"),
    )


def listing(manifests: DataFrame) -> DataFrame:
    """Name, version, description and path of every stored dataset."""
    return datasets(manifests).select("name", "version", "description", "path")


def replay_files(manifests: DataFrame, root: str) -> DataFrame:
    """``path, format, schema, sourcetype`` of the files a run reads.

    That is every bundled file, below ``root``, and the references whose sourcetype no bundled file
    covers.
    """
    named = files(manifests)
    bundled = named.filter(F.col("kind") == "bundled")
    places = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("path", r"^\./", ""))
    other = uncovered_references(named.filter(F.col("kind") == "references"), bundled)
    columns = ("path", "format", "schema", "sourcetype")
    return bundled.withColumn("path", places).select(*columns).unionByName(other.select(*columns))
