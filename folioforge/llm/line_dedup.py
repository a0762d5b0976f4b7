"""Line deduplication over the whole corpus, in DataFrame operations only.

Lines are normalised, hashed to 128 bits, counted by distinct document, and dropped
where they are common; what stays is put together in its old order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import plain_name, settle

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common lines are broadcast up to this many (each 3 longs); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """The distinct 128-bit hashes of the keys that are long enough."""
    long_lines = F.filter(lines_of(text), lambda x: F.char_length(x) >= min_chars)
    keys = F.filter(F.transform(long_lines, line_key), lambda k: F.char_length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, _hash))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def common_lines(df: DataFrame, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, keeper): keys in at least ``min_docs`` documents and the largest id that holds each.

    A document counts once for a key, so a partial sum before the shuffle leaves a row
    for each key and task, however many documents share a line. Rows of one id are one
    document: only the lines of ids that repeat are made distinct first. Rows with a null id
    don't count.
    """
    own = df.where(F.col(id_col).isNotNull())
    several = settle(own.groupBy(F.col(id_col).alias("_several")).count().where("count > 1").select("_several"), "repeated-ids")
    n = several.limit(BROADCAST_ROWS + 1).count()
    several = F.broadcast(several) if n <= BROADCAST_ROWS else several

    def held(rows: DataFrame) -> DataFrame:
        each = rows.select(F.col(id_col).alias("_id"), F.explode(_hashes(F.col(text_col), min_chars)).alias("_h"))
        return each.select("_id", F.col("_h.h1").alias("h1"), F.col("_h.h2").alias("h2"))

    lines = held(own)
    if n:
        same = own[id_col] == several["_several"]
        lines = held(own.join(several, same, "left_anti")).union(held(own.join(several, same, "left_semi")).distinct())
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def _salted(held: DataFrame, common: DataFrame, parts: int = 16) -> DataFrame:
    """The join by line hash where common lines are too many to broadcast: each is sent to
    ``parts`` places, so that a line which a third of all rows hold isn't one task's."""
    dealt = held.withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    copies = common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, ["h1", "h2", "part"]).drop("part")


def dedup_lines(df: DataFrame, *, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` without its common lines, and with n_lines and n_dropped.

    A key found in ``min_docs`` documents loses all its lines except in the largest id
    that holds it. Null or empty text is one empty line. Rows of a repeated id count as
    one document, and each of them keeps what its id keeps. Rows with a null id don't count
    as holders and lose all common lines.
    All other columns stay, but for ones named n_lines or n_dropped, which are replaced; an
    empty table gives an empty table.
    """
    common = settle(common_lines(df, min_docs, min_chars, id_col, text_col), "common-lines")
    small = common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own_id, gone, left = (plain_name(df, n) for n in ("_id", "_lost", "_kept"))
    held = df.select(F.col(id_col).alias("_id"), F.explode(_hashes(F.col(text_col), min_chars)).alias("_h"))
    held = held.select("_id", F.col("_h.h1").alias("h1"), F.col("_h.h2").alias("h2"))
    lost = held.join(F.broadcast(common), ["h1", "h2"]) if small else _salted(held, common)
    lost = lost.where(~F.col("_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("_id").alias(own_id)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    with_lost = df.join(lost, df[id_col].eqNullSafe(lost[own_id]), "left").drop(own_id)
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda x: (F.char_length(x) < min_chars) | ~F.array_contains(F.col(gone), _hash(line_key(x))))
    out = with_lost.withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn(left, F.when(F.col(gone).isNull(), lines).otherwise(kept))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size(left))
    return out.withColumn(text_col, F.array_join(left, "\n")).drop(left, gone)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their numbers of lines and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE common.key IS NOT NULL AND doc_id <> keeper))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key)
GROUP BY doc_id"""
