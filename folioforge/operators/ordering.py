"""Places in an order within groups that are too large for one task to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leading characters of a drawn key that name its bin: 16 ** BIN bins a group.
BIN = 3


def drawn_places(rows: DataFrame, group: list[str], drawn: Column, tie: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in their group's order of ``drawn``, a text of evenly spread hexadecimal digits.

    Each bin of a group is sorted alone, and the counts of the bins before it are added. Null
    groups are groups; rows equal in ``drawn`` go by ``tie``.
    """
    own = rows.columns
    keyed = rows.select(*own, drawn.alias("_drawn"), F.left(drawn, F.lit(BIN)).alias("_bin"))
    counts = keyed.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bin").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # 16 ** BIN rows a group
    before = counts.select("_of", *[f"_g{i}" for i in range(len(group))], F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    local = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(*group, "_bin").orderBy("_drawn", tie)))
    met = F.col("_bin") == F.col("_of")
    for i, c in enumerate(group):
        met = met & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return local.join(before, met).select(*own, (F.col("_rank") + F.col("_before")).cast("int").alias(name))
