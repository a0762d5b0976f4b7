"""Connected components of a graph in a table, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import settle


#: Rows of 16-byte keys that are broadcast; beyond that a node of more than HUB edges is split.
BROADCAST_ROWS, HUB = 200_000, 100_000


def _with_least(edges: DataFrame, broadcast_rows: int, hub: int) -> DataFrame:
    """``edges`` (u, v) with m, the least of u and its neighbours v.

    The least is taken before the shuffle in each task. It comes back by broadcast, if its
    size allows that; otherwise by a join in which the edges of a hub are dealt to parts,
    each of which gets the hub's row.
    """
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    small = least.limit(broadcast_rows + 1).count() <= broadcast_rows
    if small:
        return edges.join(F.broadcast(least.drop("n")), "u")
    total = least.agg(F.sum("n")).first()[0]
    most = max(hub, math.ceil(total / broadcast_rows))  # so no more hubs than may be broadcast
    parts = F.broadcast(least.where(F.col("n") > most).select("u", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = edges.join(parts, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))).drop("parts")
    rows = least.select("u", "m", F.when(F.col("n") > most, F.ceil(F.col("n") / most).cast("int")).otherwise(1).alias("k"))
    rows = rows.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("part"))
    return dealt.join(rows, ["u", "part"]).drop("part")


def _large_star(edges: DataFrame, broadcast_rows: int, hub: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both, broadcast_rows, hub).withColumn("m", F.least("u", "m"))
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, broadcast_rows: int, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down, broadcast_rows, hub)
    moved = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hub: int = HUB) -> DataFrame:
    """(u, v): each node that isn't the least of its component, and that least node.

    ``edges`` has columns u and v of one type; loops don't count. Each round is written
    to the shared folder. A node of very many edges is split. No edges give an empty table.
    """
    state, before = settle(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges"), None
    while True:
        sign = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before or sign[0] == 0:
            return state
        before, state = sign, settle(_small_star(_large_star(state, broadcast_rows, hub), broadcast_rows, hub), "edges")
