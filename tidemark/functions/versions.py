"""Semantic versions as comparable structs, and constraints on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ``1.2.3`` with any number of leading ``v`` and an ignored pre-release part
_SEMVER = r"^v*(\d+)\.(\d+)\.(\d+)(?:-.+)?\z"
# the same with the numbers as one text
_WHOLE = r"v*(\d+\.\d+\.\d+)(?:-.+)?\z"


def semver(version: Column) -> Column:
    """Struct ``major, minor, patch``, NULL when the text is not a version."""
    def part(i: int) -> Column:
        return F.regexp_extract(version, _SEMVER, i).try_cast("bigint")

    return F.when(
        version.rlike(_SEMVER),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def number_text(version: Column) -> Column:
    """``1.2.3`` of a version, empty when the text is not a version."""
    return F.regexp_extract(version, "^" + _WHOLE, 1)


def bound_text(constraint: Column) -> Column:
    """``1.2.3`` of a constraint, without its operator; empty when there is none."""
    return F.regexp_extract(constraint, r"^(?:>=|<=|[\^~><=])?" + _WHOLE, 1)


def numbers(text: Column) -> Column:
    """The struct of :func:`semver` of such a text: where that is a column, no pattern is matched again."""
    parts = {
        "major": F.substring_index(text, ".", 1),
        "minor": F.substring_index(F.substring_index(text, ".", 2), ".", -1),
        "patch": F.substring_index(text, ".", -1),
    }
    return F.when(text != "", F.struct(*[part.try_cast("bigint").alias(name) for name, part in parts.items()]))


def satisfies(version: Column, constraint: Column) -> Column:
    """Whether a version meets ``*``, ``1.x``, ``1.2.x``, ``^``, ``~``, a comparison, or is equal.

    NULL when the version or the constraint cannot be read.
    """
    bare = F.regexp_replace(constraint, r"^(?:>=|<=|[\^~><=])", "")
    return meets(semver(version), constraint, semver(bare))


def meets(v: Column, constraint: Column, c: Column) -> Column:
    """:func:`satisfies`, of the numbers of the version and of the constraint.

    In the order of the numbers the versions that satisfy a constraint lie side by side.
    """
    low = F.lower(constraint)
    major = F.regexp_extract(low, r"^(\d+)\.", 1).try_cast("bigint")
    minor = F.regexp_extract(low, r"^\d+\.(\d+)\.", 1).try_cast("bigint")
    same_major = v["major"] == c["major"]
    same_minor = same_major & (v["minor"] == c["minor"])
    none = F.lit(None).cast("boolean")
    return (
        F.when(constraint == "*", F.lit(True))
        .when(v.isNull(), none)
        .when(
            low.contains("x"),
            F.when(low.rlike(r"^\d+\.x\z"), v["major"] == major)
            .when(low.rlike(r"^\d+\.\d+\.x\z"), (v["major"] == major) & (v["minor"] == minor)),
        )
        .when(c.isNull(), none)
        .when(constraint.startswith("^"), same_major & (v >= c))
        .when(constraint.startswith("~"), same_minor & (v >= c))
        .when(constraint.startswith(">="), v >= c)
        .when(constraint.startswith("<="), v <= c)
        .when(constraint.startswith(">"), v > c)
        .when(constraint.startswith("<"), v < c)
        .otherwise(v == c)
    )


def highest_version(df: DataFrame, key: str, version: str, constraint: Column) -> DataFrame:
    """Per key the highest version that meets the constraint (by text among equal numbers)."""
    # distinct first: the rows are merged by hash, and only the few versions left are sorted
    fitting = df.select(key, version).distinct().filter(satisfies(F.col(version), constraint))
    order = F.struct(semver(F.col(version)).alias("n"), F.col(version).alias("t"))
    return fitting.groupBy(key).agg(F.max_by(version, order).alias(version))
