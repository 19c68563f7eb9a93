"""Bad records: marked, not raised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.extract import json_object


def split_errors(df: DataFrame, raw: str) -> DataFrame:
    """Add ``data`` and ``error``; a record that is not one JSON object has an error and no data.

    Filter on ``error`` for either side; both come from one pass.
    """
    parsed = df.withColumn("data", json_object(F.col(raw)))
    return parsed.withColumn("error", F.when(F.col("data").isNull(), F.lit("not a JSON object")))
