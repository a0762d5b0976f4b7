"""Sharding by jump consistent hash (Lamping and Veach 2014), in column expressions only.

The hash needs no ring table: key and shard count decide alone, and one more shard
takes rows only into itself. Its 64-bit generator is carried as two 32-bit halves,
since a product that wraps around raises an error under ANSI arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioforge.llm.common import plain_name, settle

#: The generator's multiplier, a fixed value of the published method.
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
#: Jumps grow like ln(shards); a row that needs more than this many steps stops the job.
MOST_STEPS = 160
#: Rows that one numbering task should sort, and the most numbering cells.
ROWS_PER_CELL = 200_000
MOST_CELLS = 8192


def _step(s: Column, shards: int) -> Column:
    """One jump: the next generator state and the next candidate bucket."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & MASK

    def low_product(x: Column, c: int) -> Column:
        """(x * c) before its reduction to 32 bits of x * c's high half: below 2**49."""
        return x * F.lit(c & 0xFFFF) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(0xFFFF), 16)

    lo, hi = s["lo"], s["hi"]
    part = low_product(lo, c_lo)
    low = part.bitwiseAND(MASK) + F.lit(1)
    carry = F.shiftright(part, 32) + F.shiftright(lo * F.lit(c_lo >> 16), 16) + F.shiftright(low, 32)
    high = (carry + low_product(hi, c_lo) + low_product(lo, c_hi).bitwiseAND(MASK)).bitwiseAND(MASK)
    jump = F.floor(
        (s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double"))
    ).cast("long")
    moved = F.struct(high.alias("hi"), low.bitwiseAND(MASK).alias("lo"), s["j"].alias("b"), jump.alias("j"))
    return F.when(s["j"] < F.lit(shards), moved).otherwise(s)


def jump_hash(key: Column, shards: int, integral: bool = True) -> Column:
    """The shard of ``key`` among ``shards``; keys that aren't integers are hashed first, null counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    k = F.coalesce(key.cast("long") if integral else F.xxhash64(key), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(MASK).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )
    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_STEPS)))
    done = lambda s: F.when(s["j"] >= F.lit(shards), s["b"]).otherwise(
        F.raise_error(F.lit("jump hash: more steps than MOST_STEPS")).cast("long")
    )
    return F.aggregate(steps, start, lambda s, _: _step(s, shards), done).cast("int")


def _cell(at: Column, cuts: list[int], width: int = 32) -> Column:
    """How many of the ascending ``cuts`` are at most ``at``: a step over every ``width``-th, then one within."""
    if not cuts:
        return F.lit(0)
    rough = F.lit([c for c in cuts[width - 1 :: width]] or [cuts[-1]]) if len(cuts) >= width else None
    whole = F.lit(cuts)
    if rough is None:
        return F.size(F.filter(whole, lambda c: c <= at))
    first = F.size(F.filter(rough, lambda c: c <= at)) * width
    return first + F.size(F.filter(F.slice(whole, first + 1, F.lit(width)), lambda c: c <= at))


def shard(
    df: DataFrame, key: str, shards: int, *, shard_col: str = "shard", slot_col: str | None = None, order: list[str] | None = None, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """``df`` with its shard, and with a gapless place in the shard if ``slot_col`` is given.

    Rows are numbered by ``order`` (the key, if not given). No task sorts a whole shard: the
    keys' quantiles cut each shard into ranges, a range of one much repeated key is cut again
    by the task that read a row, each range is numbered alone, and the counts of the ranges
    before it are added. The rows with their ranges are written once, so that counts and
    numbers agree. A null key goes where 0 goes and is numbered first. Columns named like the
    made ones are replaced. Rows equal in ``order``, and those of a key that is cut again, get
    different places in any order. An empty table gives an empty result.
    """
    kind = df.schema[key].dataType
    integral = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    out = df.withColumn(shard_col, jump_hash(F.col(key), shards, integral))
    if slot_col is None:
        return out
    order = order or [key]
    at = F.col(key).cast("long") if integral else F.xxhash64(F.col(key))
    n = df.count()
    cells = max(1, min(MOST_CELLS // shards, math.ceil(n / shards / rows_per_cell)))
    cuts: list[int] = []
    if cells > 1:
        found = df.select(F.percentile_approx(at, [i / cells for i in range(1, cells)], 20_000)).first()[0] or []
        hot = {a for a, b in zip(found, found[1:], strict=False) if a == b}
        cuts = sorted({x for c in found for x in ((c, c + 1) if c in hot and c < (1 << 63) - 1 else (c,))})
    cell_col, part_col, rank_col, before_col = (plain_name(out, n) for n in ("_cell", "_part", "_rank", "_before"))
    part = F.when(at.isNull() | at.isin(*sorted(hot)), F.spark_partition_id()).otherwise(0) if cells > 1 else F.lit(0)
    cell = F.when(at.isNull(), -1).otherwise(_cell(at, cuts))
    out = settle(out.withColumn(cell_col, cell).withColumn(part_col, part), "cells")
    counts = out.groupBy(shard_col, cell_col, part_col).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard_col).orderBy(cell_col, part_col).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(shard_col, cell_col, part_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(before_col))
    here = W.partitionBy(shard_col, cell_col, part_col).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = out.withColumn(rank_col, F.row_number().over(here).cast("long"))
    return (
        numbered.join(F.broadcast(counts), [shard_col, cell_col, part_col])  # MOST_CELLS rows, and one a task for each hot key (under MOST_CELLS of them)
        .withColumn(slot_col, F.col(rank_col) - 1 + F.col(before_col))
        .drop(cell_col, part_col, rank_col, before_col)
    )


def op3_jump_shards(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``key``; null texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return shard(sized, "doc_id", shards, slot_col="slot", order=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def _oracle(shards: int) -> str:
    def last(n: int) -> str:
        return f"SELECT doc_id, max(b) AS bucket FROM jumps_{n} GROUP BY doc_id"

    def jumps(n: int) -> str:
        step = f"(k * {MULTIPLIER} + 1) % 18446744073709551616"
        return f"""jumps_{n} AS (
            SELECT doc_id, doc_id::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
            UNION ALL
            SELECT doc_id, {step}, j,
                   floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (({step}) // 8589934592 + 1)::DOUBLE))::BIGINT
            FROM jumps_{n} WHERE j < {n})"""

    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
    WITH RECURSIVE {jumps(shards)}, {jumps(shards + 1)},
    placed AS (SELECT a.doc_id, a.bucket AS shard, b.bucket AS grown FROM ({last(shards)}) a JOIN ({last(shards + 1)}) b USING (doc_id)),
    bits AS (SELECT i, 0 AS step, i AS c FROM range(256) t(i) UNION ALL SELECT i, step + 1, {bit} FROM bits WHERE step < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
    bytes AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
    sums AS (
        SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) % 256) + 1], c // 256)), 4294967295)::BIGINT AS text_crc32
        FROM bytes, crc)
    SELECT d.doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, text_crc32, 'key' AS law, placed.shard::INT AS shard,
           (row_number() OVER (PARTITION BY placed.shard ORDER BY d.doc_id) - 1)::BIGINT AS slot, placed.grown::INT AS grown_shard
    FROM sums d JOIN placed USING (doc_id)"""


#: DuckDB has no crc32, so the oracle works it out from the bytes.
SHARD_SQL = _oracle(8)
