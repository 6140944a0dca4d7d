"""Tables of a job's own in the folder that all executors share, and joins to small sides of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; one of our own only where none is set and one machine does all, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: computed once, however often it is used."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has been counted to have few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
