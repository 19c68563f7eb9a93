"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def require_utc(spark: SparkSession) -> SparkSession:
    """Instants are read and printed in UTC; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder does not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    require_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors, of known size.

    The planner sees the bytes of the files, so whether a join broadcasts it is its own choice.
    """
    path = shared_path(df.sparkSession, "tidemark")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
