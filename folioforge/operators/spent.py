"""The running union of what periods have spent, in bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_union(rows: DataFrame, period: Column, key: Column) -> DataFrame:
    """(period, n_keys, n_new, n_running): distinct integer keys of each period, those of no period before, and all up to it.

    A bitmap of 32,768 keys is kept for each bucket and period, and the union runs over a
    bucket's periods; so neither keys nor a period's rows come together in one task. Null
    keys don't count, and null periods are a period before all others.
    """
    told = rows.select(period.alias("period"), key.cast("long").alias("key")).where("key is not null")
    bits = told.groupBy("period", F.bitmap_bucket_number("key").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits"))
    order = W.partitionBy("bucket").orderBy("period")
    union = bits.select("period", "bucket", F.bitmap_count("bits").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("so_far"))
    new = union.select("period", "n", (F.col("so_far") - F.coalesce(F.lag("so_far").over(order), F.lit(0))).alias("new"))
    periods = new.groupBy("period").agg(F.sum("n").alias("n_keys"), F.sum("new").alias("n_new"))
    return periods.select("period", "n_keys", "n_new", F.sum("n_new").over(W.orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("n_running"))  # a row a period
