"""Mentions of a large dictionary by a trie of token sequences.

A phrase is a path of words and the gaps between them, and a node is the hash of the path
to it. A text's tokens are probed against the nodes once each, whatever the number of
phrases; a path goes on only where some phrase does. Of the phrases that begin at one
token the longest counts, and a hit begins and ends on whole words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.functions.readings import tokens
from folioforge.tables import settled

#: First letters that are looked for before the trie, if there are no more than these.
MOST_LETTERS = 500


def _node(t: Column, i: Column, depth: int) -> Column:
    """The hash of the path of ``depth`` tokens from place ``i``; null beyond the end."""
    path = F.xxhash64(F.get(t, i)["word"])
    for k in range(1, depth):
        path = F.xxhash64(path, F.get(t, i + k)["gap"], F.get(t, i + k)["word"])
    return F.when(i + depth <= F.size(t), path)


def _trie(phrases: DataFrame, depth: int) -> list[DataFrame]:
    """For each level (node, phrase, deeper): the phrase that ends there, if one does, and whether one goes on."""
    told = phrases.select("phrase", tokens(F.col("phrase")).alias("t"))
    nodes = told.select("phrase", F.size("t").alias("n"), *[X.let(F.col("t"), lambda t, k=k: _node(t, F.lit(0), k)).alias(f"h{k}") for k in range(1, depth + 1)])
    nodes = settled(nodes, "phrases")
    ends = lambda k: F.max(F.when(F.col("n") == k, F.col("phrase")))
    return [nodes.where(F.col("n") >= k).groupBy(F.col(f"h{k}").alias("node")).agg(ends(k).alias("phrase"), F.max((F.col("n") > k).cast("int")).alias("deeper")) for k in range(1, depth + 1)]


def mentions(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, phrase): the longest of ``phrases`` (one column) that begins at each token of each text.

    Places count from 0. Phrases must begin and end with a word character; others, null and
    empty ones are never found. Whether a level of the trie is sent along, or the tokens that
    begin like a phrase are shuffled to it, is left to Spark, which knows its size.
    """
    whole = phrases.select(F.col(phrases.columns[0]).alias("phrase")).where(F.regexp_like("phrase", F.lit(r"(?Us)^\w(?:.*\w)?$"))).distinct()
    whole = settled(whole, "dictionary")
    depth = whole.agg(F.max(F.size(tokens(F.col("phrase"))))).first()[0] or 1
    letters = [r[0] for r in whole.select(F.left("phrase", F.lit(1))).distinct().limit(MOST_LETTERS + 1).collect()]
    starts = F.lit(letters) if 0 < len(letters) <= MOST_LETTERS else None

    def at(t: Column) -> Column:
        places = F.transform(t, lambda x, i: F.struct(i.alias("i"), F.left(x["word"], F.lit(1)).alias("c")))
        if starts is not None:
            places = F.filter(places, lambda p: F.array_contains(starts, p["c"]))
        return F.transform(places, lambda p: F.struct(p["i"].alias("place"), *[_node(t, p["i"], k).alias(f"h{k}") for k in range(1, depth + 1)]))

    found = docs.select(F.col(id_col).alias("id"), F.explode(X.let(tokens(F.col(text_col)), at)).alias("p")).select("id", "p.*")
    for k, level in enumerate(_trie(whole, depth), 1):
        level = settled(level.select(F.col("node").alias(f"h{k}"), F.col("phrase").alias(f"p{k}"), F.col("deeper").alias(f"d{k}")), "trie")
        if k == 1:
            found = found.join(level, "h1")
            continue
        on = (F.coalesce(F.col(f"d{k - 1}"), F.lit(0)) == 1) & F.col(f"h{k}").isNotNull()
        # paths that end here are spread over the join's partitions, where null keys would meet in one
        spread = F.when(on, F.col(f"h{k}")).otherwise(F.xxhash64("id", "place"))
        found = found.withColumn("on", on).withColumn(f"h{k}", spread).join(level, f"h{k}", "left")
        found = found.withColumns({c: F.when(F.col("on"), F.col(c)) for c in (f"p{k}", f"d{k}")}).drop("on")
    longest = reduce(lambda best, k: F.coalesce(F.col(f"p{k}"), best), range(2, depth + 1), F.col("p1"))
    return found.select("id", "place", longest.alias("phrase")).where("phrase is not null")
