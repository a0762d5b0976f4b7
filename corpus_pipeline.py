"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and but
for the last returns the columns of documents. doc_id is the key of a document: rows with
a null id are never dropped for their likeness to others. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import settle, table
from folioforge.llm.decontaminate import drop_leaks
from folioforge.llm.line_dedup import dedup_lines
from folioforge.llm.ngram_join import similarity_components
from folioforge.llm.packing import default_tokenizer, pack, pieces_of
from folioforge.llm.quality import classify, trusted_rows

SEQUENCE_TOKENS = 4096
KNOWN = ("doc_id", "text", "lang")
#: Ids to drop are broadcast up to this many; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _clear(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns under names that no operator uses."""
    return docs.toDF(*[c if c in KNOWN else f"__column_{i}" for i, c in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text accepts; nulls and empty texts stay."""
    own = _clear(docs)
    kept = classify(own, trusted_rows(own.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))).where("accepted")
    return kept.select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share; n_chars follows the text."""
    own = _clear(docs)
    out = dedup_lines(own).select(*own.columns).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest id."""
    groups = similarity_components(docs)
    copies = settle(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_copy")).distinct(), "copies")
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(copies) if small else copies, docs["doc_id"] == copies["_copy"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return pack(pieces_of(docs, default_tokenizer(), SEQUENCE_TOKENS), SEQUENCE_TOKENS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The first stage can't be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
