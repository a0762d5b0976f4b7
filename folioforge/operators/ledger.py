"""A ledger of stems over a whole corpus: each is taken unless it is like one taken before.

What the sequential ledger takes is the lexicographically first maximal independent set of
the likeness graph, and that can be found by rounds (Blelloch, Fineman and Shun 2012): a
stem without an undecided stem before it among its neighbours is taken, its neighbours
are refused, and what is left goes to the next round. Only edges travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.tables import settled, small

#: Two stems that share 7 of 10 words of the larger one are alike.
LIKE = (7, 10)
#: So many common words of a pair's rarest ones name the bucket in which the two meet.
SHARED = 2


def _least(size: Column) -> Column:
    """The words that a set of ``size`` must share with another one to be like it."""
    return F.ceil(size * LIKE[0] / LIKE[1]).cast("int")


def _buckets(words: Column, size: Column) -> Column:
    """Keys of all pairs among the first words; ``words`` go from rare to frequent.

    Two sets that share ``least`` words or more share SHARED of each one's first
    ``size - least + SHARED`` words, if both go by one order.
    """
    first = F.slice(words, F.lit(1), F.greatest(size - _least(size) + SHARED, F.lit(0)))
    inner = lambda v, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda u: F.xxhash64(v, u))
    return F.flatten(F.transform(first, inner))


def like_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: the ids of ``sets`` (group, id, words) of one group that are alike.

    Distinct word sets come in; null groups are a group. Sets of one word are like equal
    ones alone, and those are no pairs here.
    """
    each = sets.select("id", F.explode("words").alias("word"))
    counts = settled(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-counts")
    ranked = each.join(small(counts), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))  # a set's words, so bounded by it
    keyed = sets.join(ranked, "id").select("id", F.xxhash64("group").alias("g"), F.size("words").alias("n"), F.transform("ranked", lambda r: r["word"]).alias("ranked"))
    keyed = keyed.select("id", "n", "g", F.explode(_buckets(F.col("ranked"), F.col("n"))).alias("k")).select("id", "n", F.xxhash64("g", "k").alias("key"))
    keyed = settled(keyed, "ledger-buckets")
    # a bucket of one set has no pair
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key")
    keyed = settled(keyed.join(full, "key", "left_semi"), "ledger-buckets")
    a, b = (keyed.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("nb") >= _least(F.col("na"))) & (F.col("na") >= _least(F.col("nb")))
    pairs = a.join(b, "key").where(near).select("a", "b").distinct()
    of = lambda x: sets.select(F.col("id").alias(x), F.col("group").alias(f"g{x}"), F.col("words").alias(f"w{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("ga").eqNullSafe(F.col("gb")))
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(common * LIKE[1] >= F.greatest(F.size("wa"), F.size("wb")) * LIKE[0]).select("a", "b")


def refused(edges: DataFrame) -> DataFrame:
    """(id): what a ledger that goes by ascending ids refuses, given ``edges`` (a, b), a < b.

    Each round takes at least the first undecided id of each component, and with it the
    whole neighbourhood is decided; as many rounds are needed as the longest chain of stems
    that wait for one another.
    """
    edges, out = settled(edges, "ledger-edges"), None
    while not edges.isEmpty():
        free = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        free = small(settled(free, "ledger-taken"))
        lost = settled(edges.join(free, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct(), "ledger-refused")
        out = lost if out is None else out.unionByName(lost)
        gone = small(lost)
        edges = edges.join(gone.select(F.col("id").alias("b")), "b", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        edges = settled(edges.select("a", "b"), "ledger-edges")
    return out if out is not None else edges.select(F.col("a").alias("id"))


def ledger(stems: DataFrame) -> DataFrame:
    """(group, id, taken) for ``stems`` (group, id, words), per group by ascending id.

    A stem without words, or a null one, isn't taken. Of equal word sets only the first can be
    taken, so only that one meets others. Ids are distinct; an empty table gives an empty one.
    """
    words = F.array_sort(F.array_distinct("words"))
    told = settled(stems.select("group", "id", words.alias("words"), F.xxhash64("group", words).alias("h1"), F.md5(F.array_join(words, " ")).alias("h2")), "stems")
    full = told.where("size(words) > 0")
    firsts = full.groupBy("group", "h1", "h2").agg(F.min("id").alias("id"))
    sets = settled(told.join(small(settled(firsts.select("id"), "first-stems")), "id", "left_semi").select("group", "id", "words"), "stem-sets")
    lost = small(settled(refused(like_pairs(sets)), "ledger-out"))
    taken = sets.select("id").join(lost, "id", "left_anti").withColumn("taken", F.lit(True))
    return told.select("group", "id").join(taken, "id", "left").select("group", "id", F.coalesce("taken", F.lit(False)).alias("taken"))
