"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few small columns that are broadcast; beyond that a shuffle takes their place.
BROADCAST_ROWS = 200_000

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="folioforge-"))
    return _LOCAL[0]


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so that a lost executor costs a reread and not the steps before."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has ``rows`` rows at most, else as it is. ``df`` should be settled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
