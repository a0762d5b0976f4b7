"""Usage rows from a stream, each batch once.

A batch is a folder of its own, which a batch that is tried again writes over, and a table of batch ids
says which are whole. Rows of other folders don't count, so neither a batch that was
cut off nor one that was written twice adds a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.service import clean_field
from folioforge.sources.corpus import path_exists


def whole_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch): the ids of the batches that were written whole."""
    if not path_exists(spark, f"{path}/batches"):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{path}/batches")


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: text fields are cleaned, and the batch's id follows its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not whole_batches(spark, path).where(F.col("batch") == batch_id).isEmpty():
            return
        text = [f.name for f in batch.schema.fields if f.dataType.simpleString() == "string"]
        batch.withColumns({c: clean_field(F.col(c)) for c in text}).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        # one writer and one row an id: a second attempt writes the same folder
        spark.range(batch_id, batch_id + 1, 1, 1).toDF("batch").write.mode("overwrite").parquet(f"{path}/batches/id-{batch_id}")

    return write


def usage_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with ``batch``."""
    if not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows")
    return rows.join(whole_batches(spark, path), "batch", "left_semi").select(*[c for c in rows.columns if c != "batch"], "batch")


def append_stream(usage: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is of the stream and ends."""
    return usage.writeStream.foreachBatch(write_once(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
