"""Tables that are written to the folder all executors share, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset on a single machine, as in tests, a folder in /tmp is
    set as checkpoint folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/siftline-{uuid.uuid4().hex}")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as they are now, from Parquet: what is lost later is read again, not computed again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The rows, marked for a broadcast if there are at most so many; counting them is an action."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
