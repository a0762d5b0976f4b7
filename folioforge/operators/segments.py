"""Scans over one long order, cut into splits.

Rows are sorted across tasks, each task scans its split as if nothing came before, and says
how its split ends. These few rows, one a split, give what each split should have begun
with, and a second pass puts that in. No task sees more than its split, however long
a file, a block of one prefix, or a run between two marks is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.tables import settled

_SPLIT = "_split"


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _splits(df: DataFrame, order: list[str], splits: int | None) -> DataFrame:
    ordered = df.repartitionByRange(splits, *order) if splits else df.repartitionByRange(*order)
    return ordered.sortWithinPartitions(*order)


# ---------------------------------------------------------------- running numbers


def running(rows: DataFrame, order: list[str], mark: Column, value: Column, splits: int | None = None) -> DataFrame:
    """``rows`` with what a single pass in ``order`` would know at each of them.

    ``number``: its place from 1. ``marks``: the rows up to it at which ``mark`` holds; a null
    mark doesn't. ``since``: the rows since the last marked one, null before the first.
    ``chapter``: 1, and one more at every row whose ``value`` (an integer; null counts as 0) isn't
    greater than that of the row before. ``order`` should tell rows apart; others go in any order.
    """
    made = ["number", "marks", "since", "chapter"]
    given = rows.withColumn("_mark", F.coalesce(mark, F.lit(False))).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    schema = _fields(rows, "_value long", *[f"{c} long" for c in made], f"{_SPLIT} int")
    own = rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = marks = chapter = 0
        last_mark, before = None, None
        split = TaskContext.get().partitionId()
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            hit, v = batch.column("_mark").to_numpy(zero_copy_only=False), batch.column("_value").to_numpy()
            places = np.arange(n + 1, n + size + 1)
            seen = marks + np.cumsum(hit)
            marked = np.maximum.accumulate(np.where(hit, places, -1 if last_mark is None else last_mark))
            prior = np.concatenate([[v[0] - 1 if before is None else before], v[:-1]])  # the split's first row opens none yet
            chapters = chapter + np.cumsum(v <= prior)
            since = pa.array(places - marked, mask=marked < 0)
            columns = [*(batch.column(c) for c in own), batch.column("_value"), pa.array(places), pa.array(seen), since, pa.array(chapters), pa.array(np.full(size, split), pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i > len(own) and i < len(columns) - 1 else c for i, c in enumerate(columns)], names=[*own, "_value", *made, _SPLIT])
            n, marks, chapter, before = n + size, int(seen[-1]), int(chapters[-1]), int(v[-1])
            last_mark = int(marked[-1]) if marked[-1] >= 0 else None

    local = settled(_splits(given, order, splits).mapInArrow(scan, schema), "running")
    # a row a split: its length, marks, chapters opened, its first and last value, and the place of its last mark
    ends = local.groupBy(_SPLIT).agg(
        F.max("number").alias("n"), F.max("marks").alias("marks"), F.max("chapter").alias("chapter"), F.min_by("_value", "number").alias("first"), F.max_by("_value", "number").alias("last"),
        F.max(F.col("number") - F.col("since")).alias("marked"),
    )
    carries, n, marks, chapter, marked, before = [], 0, 0, 1, None, None
    for r in sorted(ends.collect(), key=lambda r: r[_SPLIT]):
        chapter += before is not None and r["first"] <= before
        carries.append((r[_SPLIT], n, marks, chapter, None if marked is None else n - marked))
        n, marks, chapter, before, marked = n + r["n"], marks + r["marks"], chapter + r["chapter"], r["last"], marked if r["marked"] is None else n + r["marked"]
    carry = rows.sparkSession.createDataFrame(carries, f"{_SPLIT} int, _n long, _marks long, _chapter long, _since long")
    out = local.join(F.broadcast(carry), _SPLIT)
    return out.select(*own, (F.col("number") + F.col("_n")).alias("number"), (F.col("marks") + F.col("_marks")).alias("marks"), F.coalesce("since", F.col("_since") + F.col("number")).alias("since"), (F.col("chapter") + F.col("_chapter")).alias("chapter"))


# ---------------------------------------------------------------- shortest prefixes


def shortest_prefixes(terms: DataFrame, column: str, least: int = 4, splits: int | None = None) -> DataFrame:
    """(low, root): each distinct term of ``least`` letters or more in lower case, and the shortest such term that begins it.

    Sorted, all terms that a term begins follow it directly. So a scan keeps one root: a term
    that it begins has it, another becomes the root. Null terms don't count.
    """
    low = terms.select(F.lower(column).alias("low")).where(F.char_length("low") >= least).distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = None
        split = TaskContext.get().partitionId()
        for batch in batches:
            found = []
            for term in batch.column("low").to_pylist():
                root = root if root is not None and term.startswith(root) else term
                found.append(root)
            yield pa.RecordBatch.from_arrays([batch.column("low"), pa.array(found, pa.string()), pa.array([split] * len(found), pa.int32())], names=["low", "root", _SPLIT])

    local = settled(_splits(low, ["low"], splits).mapInArrow(scan, f"low string, root string, {_SPLIT} int"), "prefixes")
    carries, root = [], None
    for r in sorted(local.groupBy(_SPLIT).agg(F.max_by("root", "low").alias("root")).collect(), key=lambda r: r[_SPLIT]):  # a row a split
        carries.append((r[_SPLIT], root))
        root = root if root is not None and r["root"].startswith(root) else r["root"]
    carry = terms.sparkSession.createDataFrame(carries, f"{_SPLIT} int, _root string")
    begun = F.coalesce(F.startswith("low", "_root"), F.lit(False))
    return local.join(F.broadcast(carry), _SPLIT).select("low", F.when(begun, F.col("_root")).otherwise(F.col("root")).alias("root"))
