"""Output paths from a template, and dataset references taken apart."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The variables of a template and the clock layout of each.
CLOCK_VARIABLES = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm"}
TEMPLATE_VARIABLES = ("filename", "sourcetype", *CLOCK_VARIABLES)
SUFFIX = {"gzip": ".gz", "bzip2": ".bz2", "none": "", None: ""}


def safe_sourcetype(sourcetype: Column) -> Column:
    """``:``, ``/`` and ``\\`` become ``-``; a missing sourcetype is ``unknown``."""
    return F.coalesce(F.regexp_replace(sourcetype, r"[:/\\]", "-"), F.lit("unknown"))


def template_parts(template: str) -> list[tuple[str, str]]:
    """``[(literal, variable)]`` of a template; an unknown variable is an error."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] not in TEMPLATE_VARIABLES:
            raise ValueError(f"unknown template variable {m[1]!r}; one of {TEMPLATE_VARIABLES}")
        parts.append((template[at:m.start()], m[1]))
        at = m.end()
    return [*parts, (template[at:], "")]


def template_columns(
    template: str, filename: Column, sourcetype: Column, run_time: datetime
) -> dict[str, Column]:
    """A column per variable of the template, for partitioned writes."""
    clock = F.lit(run_time.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    known = {
        "filename": F.element_at(F.split(filename, "/"), -1),
        "sourcetype": safe_sourcetype(sourcetype),
        **{name: F.date_format(clock, fmt) for name, fmt in CLOCK_VARIABLES.items()},
    }
    return {name: known[name] for _, name in template_parts(template) if name}


def output_path(
    template: str,
    filename: Column,
    sourcetype: Column,
    run_time: datetime,
    compression: str | None = None,
) -> Column:
    """The path of a record's file; the suffix of the compression is added once."""
    columns = template_columns(template, filename, sourcetype, run_time)
    pieces = [
        piece
        for literal, name in template_parts(template)
        for piece in ([F.lit(literal)] if literal else []) + ([columns[name]] if name else [])
    ]
    path, suffix = F.concat(*pieces), SUFFIX[compression]
    if not suffix:
        return path
    return F.when(path.endswith(suffix), path).otherwise(F.concat(path, F.lit(suffix)))


def split_reference(ref: Column) -> Column:
    """Struct ``path, version, scheme`` of a dataset reference."""
    web = ref.startswith("http")
    versioned = ~web & ref.contains("@")
    body = F.when(versioned, F.regexp_extract(ref, r"(?s)^(.*)@[^@]*\z", 1)).otherwise(ref)
    version = F.when(versioned, F.substring_index(ref, "@", -1))
    scheme = (
        F.when(body.startswith("github:"), "github")
        .when(body.startswith("local:"), "local")
        .when(body.startswith("https://"), "https")
        .when(body.startswith("http://"), "http")
        .when(body.startswith("s3://"), "s3")
        .when(body.startswith("gs://"), "gs")
    )
    path = F.when(scheme.isin("github", "local"), F.regexp_replace(body, r"^(?:github|local):", ""))
    return F.struct(
        F.coalesce(path, body).alias("path"), version.alias("version"), scheme.alias("scheme")
    )


def split_repository(ref: Column) -> Column:
    """Struct ``org, repo, path, version`` of ``org/repo/path[@version]``; NULL if too short."""
    versioned = ref.contains("@")
    body = F.when(versioned, F.regexp_extract(ref, r"(?s)^(.*)@[^@]*\z", 1)).otherwise(ref)
    parts = F.split(body, "/", -1)
    return F.when(
        F.size(parts) >= 2,
        F.struct(
            F.get(parts, 0).alias("org"), F.get(parts, 1).alias("repo"),
            F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("path"),
            F.when(versioned, F.substring_index(ref, "@", -1)).alias("version"),
        ),
    )
