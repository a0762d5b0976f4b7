"""Packing documents into sequences of fixed length, certified by lower bounds.

Each partition packs its pieces by best-fit decreasing and knows a lower bound of its
number of sequences from dual feasible functions (Fekete and Schepers 2001). Partitions
with a gap give up their least filled sequences; what is given up is dealt into new
groups and packed again, as long as that saves sequences and the bound for the whole
corpus isn't reached.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker, settle
from folioforge.llm.tokens import encoder

#: Pieces that one task packs at a time.
PIECES_PER_GROUP = 20_000
ROUNDS = 3
END_ID = 1
_FULL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, open boolean"
_COLUMNS = [c.split()[0] for c in _FULL.split(", ")]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length. The bins are held by what is left in them, so a search is one bit scan."""
    bins = np.empty(len(lengths), np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        if fits := mask >> x:
            left = x + (fits & -fits).bit_length() - 1
            b = held[left].pop()
            if not held[left]:
                mask ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        left -= x
        if left:
            held[left].append(b)
            mask |= 1 << left
        bins[i] = b
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts[x]`` pieces of each length x has fewer bins.

    The largest of: total length; for each t, pieces over capacity - t alone and those
    from t on by length; the rounding functions u(k), k up to 50.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    number, total = np.cumsum(counts), np.cumsum(counts * x)
    t = np.arange(1, capacity // 2 + 1)
    alone = number[-1] - number[capacity - t]
    best = max(best, int((alone - -(total[capacity - t] - total[t - 1]) // capacity).max(initial=0)))
    for k in range(1, 51):
        scaled = (k + 1) * x
        weight = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (k * capacity)))
    return best


def pieces_of(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; only documents over ``capacity`` ids are cut.

    Null and empty text have the end id only. ``spread`` is a number that deals out rows
    evenly, repeated ones too. With ``keep_ids`` the ids themselves come along.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("tokens")
        words, row = encoder(tokenizer), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                data = [t or b"" for t in texts.slice(at, 512).to_pylist()]
                for key, ids in zip(keys.slice(at, 512).to_pylist(), words.encode(data), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        row += 1
                        out.append((key, piece, start // 4, len(own) // 4, zlib.crc32(own), row) + ((np.frombuffer(own, "<i4").tolist(),) if keep_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def _packed(group: pd.DataFrame, part: int, capacity: int) -> pd.DataFrame:
    """The group with its bins, and with which of them are open to an exchange.

    Without a gap to the bound only the least filled bin is open; with one, a quarter of
    the bins, so that what four partitions give up is no more than one partition.
    """
    lengths = group["length"].to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    n = int(bins.max()) + 1
    gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n)
    free = np.zeros(n, bool)
    free[np.argsort(fill, kind="stable")[: max(1, n // 4) if gap else 1]] = True
    free &= fill < capacity
    order = np.lexsort((-lengths, bins))
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, np.diff(bins[order]) > 0]
    offset = np.empty(len(group), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return group.assign(part=part, sequence_id=(part << 24) + bins, offset=offset, open=free[bins])


def _repacker(round_no: int, capacity: int):
    """Packs a pool anew; the old bins stay if that saves none."""

    def again(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        new = _packed(group, (round_no << 30) + int(key[0]), capacity)
        return (new if (new["offset"] == 0).sum() < (group["offset"] == 0).sum() else group)[_COLUMNS]

    return again


def pack(pieces: DataFrame, capacity: int, pieces_per_group: int = PIECES_PER_GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (see pieces_of) with sequence_id and offset, gapless in each sequence.

    An empty table gives an empty table.
    """
    pieces = settle(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row a length
        counts[length] = n
    best, groups = lower_bound(counts, capacity), max(1, math.ceil(int(counts.sum()) / pieces_per_group))

    def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _packed(group, int(key[0]), capacity)[_COLUMNS]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("spread", "doc_id", "piece"), F.lit(groups)))
    state = settle(dealt.groupBy("_group").applyInPandas(first, _FULL), "packed")
    bins = state.where("offset = 0").count()
    for round_no in range(1, rounds + 1):
        if bins <= best:
            break
        given = state.where("open")
        pools = max(1, math.ceil(given.count() / pieces_per_group))

        mixed = given.withColumn("_group", F.pmod(F.xxhash64("part", F.lit(round_no)), F.lit(pools)))
        new = settle(state.where("not open").unionByName(mixed.groupBy("_group").applyInPandas(_repacker(round_no, capacity), _FULL)), "packed")
        saved = bins - new.where("offset = 0").count()
        state, bins = new, bins - saved
        if saved <= 0:
            break
    return state.drop("part", "open")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces_of(docs, default_tokenizer(), 4096), 4096)
