"""Listing, searching and checking the catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.versions import semver

SEARCH_FIELDS = ("name", "description", "tags", "mitre_attack")
# What a manifest may hold.
FILE_FORMATS = ("auto", "csv", "jsonl", "json", "text", "xml")
URI_SCHEMES = ("s3://", "gs://", "http://", "https://", "azure://")
CHECKSUM_ALGORITHMS = ("sha256", "sha512", "md5")
CONSTRAINT_OPERATORS = (">=", "<=", ">", "<", "=", "^", "~")


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))


def list_datasets(
    datasets: DataFrame,
    repository: str | None = None,
    tags: Sequence[str] | None = None,
    technique: str | None = None,
) -> DataFrame:
    """Datasets of enabled repositories, by repository name, any of the tags, technique id."""
    rows = datasets
    if "enabled" in rows.columns:
        rows = rows.filter("enabled")
    if repository is not None:
        rows = rows.filter(F.col("repository") == repository)
    if tags:
        rows = rows.filter(any_tag(F.col("tags"), tags))
    if technique is not None:
        rows = rows.filter(F.exists("techniques", lambda t: t["id"] == technique))
    return rows


def search_datasets(
    datasets: DataFrame, query: str, fields: Sequence[str] = SEARCH_FIELDS
) -> DataFrame:
    """Datasets that hold the query, in any letter case, in one of the fields."""
    unknown = set(fields) - set(SEARCH_FIELDS)
    if unknown:
        raise ValueError(f"cannot search in {sorted(unknown)}")
    wanted = query.lower()

    def holds(text: Column) -> Column:
        return F.coalesce(F.lower(text).contains(wanted), F.lit(False))

    def any_holds(items: str) -> Column:
        return F.coalesce(F.exists(items, holds), F.lit(False))

    tests = {
        "name": lambda: holds(F.col("name")),
        "description": lambda: holds(F.col("description")),
        "tags": lambda: any_holds("tags"),
        "mitre_attack": lambda: F.coalesce(
            F.exists("techniques", lambda t: holds(t["id"]) | holds(t["name"])), F.lit(False)
        ) | any_holds("tactics"),
    }
    match = F.lit(False)
    for field in fields:
        match = match | tests[field]()
    return datasets.filter(match)


def list_profiles(profiles: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Profiles by name, with any of the tags, and how many datasets each has."""
    rows = profiles if not tags else profiles.filter(any_tag(F.col("tags"), tags))
    return rows.withColumn("datasets_count", F.size("datasets")).orderBy("name")


def list_destinations(destinations: DataFrame, kind: str | None = None) -> DataFrame:
    rows = destinations if kind is None else destinations.filter(F.col("type") == kind)
    return rows.orderBy("name")


def _violations(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def dataset_violations(datasets: DataFrame) -> DataFrame:
    """Add ``violations``: the rules a dataset row breaks."""
    bad_id = F.coalesce(
        F.exists("techniques", lambda t: ~F.coalesce(t["id"].startswith("T"), F.lit(False))),
        F.lit(False),
    )
    return datasets.withColumn("violations", _violations({
        "name is missing": F.col("name").isNull(),
        "version is not semantic": semver(F.col("version")).isNull(),
        "technique id does not start with T": bad_id,
    }))


def path_escapes(path: Column) -> Column:
    """An absolute path, or one with a ``..`` step."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def file_violations(files: DataFrame) -> DataFrame:
    """Add ``violations`` to rows of ``kind`` (bundled, references), ``path``, ``format``, ``checksum``."""
    bundled = F.col("kind") == "bundled"
    scheme = F.lit(False)
    for s in URI_SCHEMES:
        scheme = scheme | F.col("path").startswith(s)
    algorithm = F.substring_index("checksum", ":", 1)
    checksum_ok = F.col("checksum").contains(":") & algorithm.isin(*CHECKSUM_ALGORITHMS)
    return files.withColumn("violations", _violations({
        "path leaves the dataset": bundled & path_escapes(F.col("path")),
        "address scheme is not supported": ~bundled & ~scheme,
        "format is unknown": ~F.col("format").isin(*FILE_FORMATS),
        "checksum is not algorithm:value": F.col("checksum").isNotNull() & ~checksum_ok,
    }))


def constraint_violation(constraint: Column) -> Column:
    """Whether a version constraint is malformed (operators are not looked behind)."""
    known = (constraint == "*") | F.lower(constraint).contains("x")
    for operator in CONSTRAINT_OPERATORS:
        known = known | constraint.startswith(operator)
    return ~known & semver(constraint).isNull()


def dataset_info(datasets: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per dataset the counts and lists a detail view shows."""
    per_file = files.groupBy("dataset").agg(
        F.count_if(F.col("kind") == "bundled").alias("bundled_files"),
        F.count_if(F.col("kind") == "references").alias("references"),
        F.sum("event_count").alias("events"),
        F.sort_array(F.collect_set("sourcetype")).alias("sourcetypes"),
    )
    per_dependency = dependencies.groupBy("dataset").agg(F.count(F.lit(1)).alias("dependencies"))
    return (
        datasets.select("name", "version", "description", F.size("techniques").alias("techniques"))
        .join(per_file, F.col("name") == per_file["dataset"], "left").drop("dataset")
        .join(per_dependency, F.col("name") == per_dependency["dataset"], "left").drop("dataset")
    )


def log_sources(files: DataFrame) -> DataFrame:
    """Files by vendor, product, category and subcategory."""
    return files.groupBy(
        "log_source.vendor", "log_source.product", "log_source.category", "log_source.subcategory"
    ).agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("dataset").alias("datasets")
    )


def platform_metadata(files: DataFrame) -> DataFrame:
    """One row per file and platform: ``dataset, path, platform, settings`` (JSON)."""
    return files.select(
        "dataset", "path", F.explode("platforms").alias("platform", "settings")
    ).withColumn("settings", F.to_json("settings"))
