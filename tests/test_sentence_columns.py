import time

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.plans import columns


def test_a_sentence_of_very_many_words_is_read_once(spark, tmp_path):
    """Its words were found anew for each of them."""
    long = "Unu " + " ".join(f"cuvânt{i}" for i in range(20_000))
    texts = [long + ".", long + " Unu.", "... !", "Unu doi. Unu unu Unu!", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = {(r["doc_id"], r["sentence_no"]): r["sole"] for r in columns.sentence_columns(spark, str(tmp_path)).collect()}
    assert time.monotonic() - start < 30
    assert got == {(0, 0): True, (1, 0): False, (2, 0): False, (2, 1): False, (3, 0): True, (3, 1): False}


def test_head_words_are_those_of_squeezed_text(spark):
    values = ["", " ", " \n", "Ana are", "  și\tnu", " cum. a", "și", "Ce", None]
    squeezed = F.coalesce(F.get(F.split(X.squeeze(F.col("v")), " "), F.lit(0)), F.lit("null"))
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", squeezed.alias("want"), F.coalesce(X.head_word(F.col("v")), F.lit("null")).alias("got"), X.register(F.col("v")).alias("r"))
    rows = df.collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert [r["r"] for r in rows] == ["empty", "empty", "empty", "capitalised", "plain", "plain", "plain", "subordinate", "plain"]
