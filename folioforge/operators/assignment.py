"""Items to shapes under caps, as a single pass by priority would deal them, by rounds.

An item takes the first of its shapes that isn't full, if its answer isn't used up; items go
by priority. In each round every item holds what it could have if the holders of the
round before were right: a shape or an answer is open to it if fewer than the cap of its holders
go before it, which is to say that its priority doesn't lie behind the last one that the
cap admits. Only these last priorities pass from round to round. The pass by priority
is the one state that a round doesn't change, and with each round at least one more item,
in order, holds what it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioforge.tables import settled, small

#: Characters of a priority that name its bin; a cap's last holder is looked for in one bin only.
BIN = 3


def last_holders(holders: DataFrame, caps: Column) -> DataFrame:
    """(resource, last): the priority of the holder that fills a resource's cap; no row for those that aren't full.

    ``holders`` are (resource, priority) with distinct priorities. Holders are counted by
    resource and bin; only the bin in which the cap is reached is sorted.
    """
    bins = holders.groupBy("resource", F.left("priority", F.lit(BIN)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("resource").orderBy("bin")
    upto = bins.select("resource", "bin", "n", F.sum("n").over(order).alias("upto"), caps.alias("cap"))
    full = settled(upto.where((F.col("upto") >= F.col("cap")) & (F.col("upto") - F.col("n") < F.col("cap"))).select("resource", "bin", (F.col("cap") - (F.col("upto") - F.col("n"))).alias("at")), "full-bins")
    inside = holders.select("resource", F.left("priority", F.lit(BIN)).alias("bin"), "priority").join(small(full), ["resource", "bin"])
    ranked = inside.select("resource", "priority", "at", F.row_number().over(W.partitionBy("resource", "bin").orderBy("priority")).alias("r"))
    return ranked.where(F.col("r") == F.col("at")).select("resource", F.col("priority").alias("last"))


def assign(items: DataFrame, shape_caps: dict[str, int], answer_cap: int) -> DataFrame:
    """``items`` (id, priority, shapes, answer) with ``shape``: what each gets, null if nothing.

    ``priority`` is a distinct text, lesser ones first; ``shapes`` an array of names, the liked
    ones first, of which those without a cap are never open. A null answer is used by no
    other and has no cap; a cap of 0 admits none. An empty table gives an empty one.
    """
    items = settled(items.select("id", "priority", "shapes", "answer"), "items")
    open_shapes = {s: None for s, cap in shape_caps.items() if cap > 0}  # the last priority that a shape admits; None for all
    answers, seen = None, None
    while True:
        rows = items if answers is None else items.join(small(answers), "answer", "left")
        allowed = F.lit(True) if answers is None else F.coalesce(F.col("priority") <= F.col("last"), F.lit(True))
        bounds = {s: F.lit(last) for s, last in open_shapes.items()}
        fit = lambda s: F.coalesce(*[F.when(s == name, F.lit(True) if open_shapes[name] is None else F.col("priority") <= bound) for name, bound in bounds.items()], F.lit(False))
        choice = F.when(allowed & F.lit(answer_cap > 0), F.get(F.filter("shapes", fit), F.lit(0)))
        held = rows.select("id", "priority", "shapes", "answer", choice.alias("shape"))
        holding = held.where("shape is not null")
        cap = F.coalesce(*[F.when(F.col("resource") == s, n) for s, n in shape_caps.items()])
        lasts = {r["resource"]: r["last"] for r in last_holders(holding.select(F.col("shape").alias("resource"), "priority"), cap).collect()}  # a row a shape
        answers = settled(last_holders(holding.where("answer is not null").select(F.col("answer").alias("resource"), "priority"), F.lit(answer_cap)).withColumnRenamed("resource", "answer"), "answers")
        sign = (tuple(sorted(lasts.items())), *answers.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("answer", "last"))).first())
        if sign == seen:
            return held
        seen, open_shapes = sign, {s: lasts.get(s) for s in open_shapes}
