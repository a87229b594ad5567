"""Cutting lineage where a result is used several times or built in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension of at most so many rows is broadcast; a larger one is joined by shuffling.
DIMENSION = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only in local mode, where it may be unset, a folder is made and set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder. Spark removes a checkpoint with its DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet: for wide rows of arrays, which take several times as much as a checkpoint."""
    at = f"{shared_folder(df.sparkSession)}/plumbline/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def is_small(df: DataFrame, most: int = DIMENSION) -> bool:
    return df.limit(most + 1).count() <= most


def dimension(df: DataFrame, most: int = DIMENSION) -> DataFrame:
    """df for a join with facts: computed once, and marked to be broadcast if it has at most ``most`` rows; else as it is."""
    d = checkpointed(df)
    return F.broadcast(d) if is_small(d, most) else d
