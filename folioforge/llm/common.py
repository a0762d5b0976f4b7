"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all runs on one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="folioforge-"))
    return _LOCAL_DIR[0]


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage ends there, so a lost executor costs a reread and not the steps before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken, name, i = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


#: What operators keep in a worker process between tasks, and how it is dropped.
WORKER_STORES: dict[str, Callable[[], None]] = {}


def enter_worker(owner: str) -> None:
    """At a task's start in Python: drop what other operators left in this worker, and give
    freed memory back, so that workers that serve many operators don't add up their stores."""
    for name, drop in WORKER_STORES.items():
        if name != owner:
            drop()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
