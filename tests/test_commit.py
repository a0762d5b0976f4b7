"""A paper folder through jobs that end and jobs that don't."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.sources.commit import MANIFEST, manifest, write_papers_together


def documents(spark, rows):
    made = [(p, v, f"L{p}", json.dumps({"contest": {"name": p}, "items": [], "mark": mark})) for p, v, mark in rows]
    return spark.createDataFrame(made, "paper_id string, version int, label string, document string").repartition(3)


def marks(path):
    return {k: json.loads((path / v / "test.json").read_text())["mark"] for k, v in manifest(path).items()}


def test_papers_appear_together(spark, tmp_path):
    assert manifest(tmp_path) == {}
    write_papers_together(documents(spark, [("a", 1, "old"), ("a", 2, "old"), ("b", 1, "old")]), tmp_path)
    assert marks(tmp_path) == {"a/V1": "old", "a/V2": "old", "b/V1": "old"}
    broken = documents(spark, [("a", 1, "new"), ("c", 1, "new")]).withColumn("document", F.when(F.col("paper_id") == "c", "no json").otherwise(F.col("document")))
    with pytest.raises(Exception, match="no json|JSON|Expecting"):
        write_papers_together(broken, tmp_path)
    assert marks(tmp_path) == {"a/V1": "old", "a/V2": "old", "b/V1": "old"}
    write_papers_together(documents(spark, [("a", 1, "new"), ("c", 1, "new")]), tmp_path)
    assert marks(tmp_path) == {"a/V1": "new", "a/V2": "old", "b/V1": "old", "c/V1": "new"}
    files = [f for f in tmp_path.rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    assert len(files) == 1 + 4 * 3 and (tmp_path / MANIFEST) in files
