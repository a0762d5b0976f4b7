"""Each stage of the pipeline on what the one before kept."""

import shutil

import corpus_pipeline as P
from folioforge.llm import packing, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, held = [], [docs.count()]
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        names.append(name)
        stage(spark, docs, SF).write.parquet(out := str(tmp_path / str(i)))
        docs = spark.read.parquet(out)
        if i < 4:
            assert docs.columns == columns
            held.append(docs.count())
    assert len(names) == 5 and held[0] > held[1] == held[2] > held[3] > held[4]
    kept = spark.read.parquet(str(tmp_path / "3")).select("doc_id").distinct().count()
    assert docs.select("doc_id").distinct().count() == kept == held[4]
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(spark.read.parquet(str(tmp_path / "0")), "doc_id", "left_anti")
    assert bad.count() <= 1
    shutil.rmtree(tmp_path)


def test_clashing_columns_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.selectExpr("doc_id", "lang", "text", "1 as accepted", "2 as bits", "3 as _lost", "4 as n_lines", "5 as cls", "6 as _copy", "7 as _leaked")
    for _, stage in P.STAGES[:4]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns
        assert {tuple(r)[3:] for r in out.limit(20).collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_empty_tables_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and packing.END_ID == 1
