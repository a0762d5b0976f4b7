"""Checks that are made while a table is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_judged(rows: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Writes ``rows`` and says how many there are (``rows``) and how many break each rule, in one job.

    A rule is a condition that a sound row doesn't meet; a null one isn't met. The figures
    are those of the rows written, so nothing is read twice. A table with violations is
    written all the same: the caller decides what becomes of it.
    """
    judged = Observation()
    counts = [F.coalesce(F.count_if(broken), F.lit(0)).alias(f"rule_{i}") for i, broken in enumerate(rules.values())]
    rows.observe(judged, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(path)
    found = judged.get
    return {"rows": found["rows"], **{name: found[f"rule_{i}"] for i, name in enumerate(rules)}}
