"""Differences of two large tables by trees of digests.

The leaves are ranges of the key, a node covers FANOUT nodes below it, and its digest is made
of its rows', in any order. Two trees are compared from the root; a level's nodes are read
only under nodes that differ, and rows only under leaves that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.tables import settled, small

#: Keys in a leaf, nodes below a node, and levels; the last level is one node for as many keys as a long holds.
LEAF_KEYS, FANOUT = 64, 256


def _down(number: Column, by: int) -> Column:
    """The floor of an exact division."""
    return F.call_function("div", number - F.pmod(number, F.lit(by)), F.lit(by))


def _leaf(key: Column, leaf_keys: int) -> Column:
    return _down(key.cast("long"), leaf_keys)


def digest_tree(rows: DataFrame, key: str, leaf_keys: int = LEAF_KEYS, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of (node, n, digest), from the leaves to the level whose nodes are all 0 or -1.

    The digest of a leaf is the sum of two hashes of its rows, as 38-digit decimals, so that
    repeated rows don't cancel; rows of a null key are a leaf of their own, node null.
    """
    columns = [F.col(c) for c in rows.columns]
    nulls = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in rows.columns])  # a hash passes over nulls
    hashed = rows.select(_leaf(F.col(key), leaf_keys).alias("node"), F.xxhash64(*columns, nulls).alias("h1"), F.xxhash64(F.lit(1), *columns, nulls).alias("h2"))
    wide = lambda h: F.sum(F.col(h).cast("decimal(38,0)"))
    level = settled(hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), wide("h1").alias("d1"), wide("h2").alias("d2")), "digests")
    tree = [level]
    while level.where("node not in (0, -1)").limit(1).count():
        up = level.select(_down(F.col("node"), fanout).alias("node"), "n", "d1", "d2")
        level = settled(up.groupBy("node").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2")), "digests")
        tree.append(level)
    return tree


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose digests differ, or that one side lacks."""
    other = b.select(F.col("node").alias("_node"), F.struct("n", "d1", "d2").alias("_b"))
    both = a.select("node", F.struct("n", "d1", "d2").alias("_a")).join(other, F.col("node").eqNullSafe(F.col("_node")), "full")
    met = F.when(F.col("_a").isNotNull(), F.col("node")).otherwise(F.col("_node"))
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(met.alias("node"))


def differing_leaves(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """(nodes of the leaf level that differ, how many nodes were compared at each level from the top)."""
    height = max(len(a), len(b))
    at = lambda tree, i: tree[min(i, len(tree) - 1)]  # noqa: E731 (a shorter tree's top is the same node at all levels above)
    compared, under = [], None
    for i in range(height - 1, -1, -1):
        left, right = at(a, i), at(b, i)
        if under is not None:
            below = lambda t, u=under: t.join(u, _down(F.col("node"), fanout).eqNullSafe(F.col("_up")), "left_semi")
            left, right = below(left), below(right)
        left, right = settled(left, "compared"), settled(right, "compared")
        compared.append(left.count() + right.count())
        differing = settled(_differing(left, right), "differing")
        under = small(differing.select(F.col("node").alias("_up")))
    return differing, compared


def differences(old: DataFrame, new: DataFrame, key: str, leaf_keys: int = LEAF_KEYS, fanout: int = FANOUT) -> DataFrame:
    """The rows of either table that the other lacks, with ``side`` ``old`` or ``new``; repeated rows count.

    Both tables have the same columns. Rows are read again only in the key ranges that differ:
    a bounded number of ranges reaches the scan as a filter, more of them as a join.
    """
    leaves, _ = differing_leaves(digest_tree(old, key, leaf_keys, fanout), digest_tree(new, key, leaf_keys, fanout), fanout)
    ranges = leaves.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_if(F.col("node").isNull()).alias("nulls")).first()
    columns = old.columns

    def within(rows: DataFrame, side: str) -> DataFrame:
        span = F.lit(False) if ranges["a"] is None else F.col(key).between(ranges["a"] * leaf_keys, (ranges["b"] + 1) * leaf_keys - 1)
        span = span | F.col(key).isNull() if ranges["nulls"] else span
        met = rows.where(span).join(small(leaves.withColumnRenamed("node", "_leaf")), _leaf(F.col(key), leaf_keys).eqNullSafe(F.col("_leaf")), "left_semi")
        return met.select(*columns, F.lit(1 if side == "old" else -1).alias("_sign"))

    both = within(old, "old").unionByName(within(new.select(*columns), "new")).groupBy(*columns).agg(F.sum("_sign").alias("_more")).where("_more <> 0")
    times = F.sequence(F.lit(1).cast("long"), F.abs("_more"))
    return both.select(*columns, F.when(F.col("_more") > 0, "old").otherwise("new").alias("side"), F.explode(times).alias("_time")).drop("_time")
