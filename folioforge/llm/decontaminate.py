"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors of unit length over hashed words. One pass
sums the randomised projection of their Gram matrix, from which the driver takes the
leading singular directions (Halko, Martinsson and Tropp 2011, section 5.5). Every window
of every document is folded into that space and compared with each benchmark item by
cosine: what passes is a candidate. Candidates are confirmed by the item's rarer words
(the answer check) and by the longest common subsequence of words, so that reworded
passages are found as well as copies.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker, settle
from folioforge.llm.tokens import chunks

FEATURES, RANK, EXTRA = 1 << 14, 48, 8
#: Words of a passage, and of the blocks that windows are made of.
PASSAGE, BLOCK = 64, 16
#: A candidate's least cosine, and the share of an item's words that it must keep in order.
COSINE, SUBSEQUENCE = 0.3, 0.6
#: Of an item's rarer words, how many must be there (see answer_words).
ANSWER_HITS = 2
#: By information, what share of an item's words that the corpus holds must be near; as long
#: a subsequence as SURE passes without.
ANSWER_SHARE, SURE = 0.5, 0.8
#: Words of a batch and of a segment of a long document; windows and items compared at once.
WORDS_AT_ONCE, SEGMENT, WINDOWS_AT_ONCE, ITEMS_AT_ONCE = 1 << 17, 1 << 16, 2_048, 2_000
#: Rows of a gather that stay in a core's cache.
GATHER = 1 << 13
#: Benchmark text that goes to every task at once; a larger benchmark goes slice by slice.
SLICE_BYTES = 1 << 26
SEED = 20
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words, lower-cased in A-Z and without ASCII punctuation, in parts."""
    for part in chunks(data):
        yield part.lower().translate(_PLAIN).split()


def codes_of(data: bytes) -> np.ndarray:
    parts = [np.fromiter(map(zlib.crc32, w), np.uint32, len(w)) for w in words_of(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@dataclass
class Batch:
    """Segments of documents: their word codes one after another, the length, row and first word of each."""

    ids: list
    codes: np.ndarray
    lens: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray


def _batches(batches: Iterator[pa.RecordBatch], overlap: int = 0) -> Iterator[Batch]:
    """About WORDS_AT_ONCE words at a time. Documents over SEGMENT words come in segments
    that share ``overlap`` words; ``rows`` numbers a task's documents, ids has those at hand."""
    enter_worker("decontaminate")
    row, held = 0, 0
    ids, parts, rows, firsts = [], [], [], []

    def made() -> Batch:
        return Batch(ids, np.concatenate(parts), np.array(list(map(len, parts))), np.array(rows), np.array(firsts))

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            codes = codes_of(text.as_py() or b"")
            row += 1
            for at in range(0, max(1, len(codes) - overlap) if len(codes) else 0, SEGMENT - overlap):
                ids.append(i.as_py())
                parts.append(codes[at : at + SEGMENT])
                rows.append(row)
                firsts.append(at)
                held += len(parts[-1])
                if held >= WORDS_AT_ONCE:
                    yield made()
                    ids, parts, rows, firsts, held = [], [], [], [], 0
    if parts:
        yield made()


def _cuts(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of ``size`` words that don't cross segments, and their segments."""
    n = -(-lens // size)
    owner = np.repeat(np.arange(len(lens)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(lens) - lens, n) + size * rank, owner


def _features(codes: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(piece, feature) of each distinct feature of each piece, in order, and the number of pieces."""
    starts, _ = _cuts(lens, size)
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    pairs = np.sort((of * FEATURES + codes % FEATURES).astype(np.uint32 if len(starts) < 1 << 18 else np.uint64))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    return (pairs // FEATURES).astype(np.int64), (pairs % FEATURES).astype(np.int64), len(starts)


def _sum_rows(out: np.ndarray, to: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    """Add table[rows] to out[to]; ``to`` ascends. Done in parts that fit the cache."""
    held = np.empty((GATHER, table.shape[1]), table.dtype)
    for at in range(0, len(rows), GATHER):
        own, here = to[at : at + GATHER], rows[at : at + GATHER]
        part = np.take(table, here, axis=0, out=held[: len(here)], mode="clip")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(part, first)


class Codes:
    """A sorted set of word codes; most other words are told apart by one lookup."""

    BITS = 20

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes).astype(np.int64)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.codes & (1 << self.BITS) - 1] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` that hold a member, and which member."""
        at = np.flatnonzero(self.table[codes & np.uint32((1 << self.BITS) - 1)])
        spot = np.minimum(np.searchsorted(self.codes, codes[at]), max(len(self.codes) - 1, 0))
        same = self.codes[spot] == codes[at] if len(self.codes) else np.zeros(len(at), bool)
        return at[same], spot[same]


# ---------------------------------------------------------------- the space


def _frequencies(watched: Codes):
    """A task's numbers of passages that hold each feature, of all passages, and of watched words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, words = np.zeros(FEATURES + 1, np.int64), np.zeros(len(watched.codes), np.int64)
        for b in _batches(batches):
            words += np.bincount(watched.find(b.codes)[1], minlength=len(words))
            _, f, passages = _features(b.codes, b.lens, PASSAGE)
            df[:-1] += np.bincount(f, minlength=FEATURES)
            df[-1] += passages
        total = np.concatenate([df, words])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["feature", "n"])

    return run


def _omega() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((FEATURES, RANK + EXTRA)).astype(np.float32)


def _gram(idf: np.ndarray, group: int = 256):
    """A task's share of A'A Omega, in rows of ``group`` features; A's rows are passages of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _omega() * idf[:, None]
        total, some = np.zeros((FEATURES, RANK + EXTRA), np.float32), False
        for b in _batches(batches):
            some = True
            of, f, passages = _features(b.codes, b.lens, PASSAGE)
            y = np.zeros((passages, RANK + EXTRA), np.float32)
            _sum_rows(y, of, omega, f)
            y /= np.maximum(np.bincount(of, idf[f] ** 2, passages), 1e-9).astype(np.float32)[:, None]
            turned = np.sort((f * passages + of).astype(np.uint32 if passages < 1 << 18 else np.uint64))
            _sum_rows(total, (turned // passages).astype(np.int64), y, (turned % passages).astype(np.int64))
        if some:
            total *= idf[:, None]
            rows = total.reshape(FEATURES // group, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["rows", "part"])

    return run


def _add(group):
    import pandas as pd

    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in group["part"])
    return pd.DataFrame({"rows": [group["rows"].iloc[0]], "part": [total.tobytes()]})


@dataclass
class Space:
    """idf of each feature, its projection with idf, and how often each watched word stands.

    Directions are divided by their singular values, as folding-in does, so that the few
    that tell languages apart don't drown those that tell passages apart.
    """

    idf: np.ndarray
    project: np.ndarray
    words: dict[int, int]

    def fold(self, codes: np.ndarray, lens: np.ndarray, size: int) -> np.ndarray:
        """A vector for each piece of ``size`` words."""
        of, f, n = _features(codes, lens, size)
        out = np.zeros((n, self.project.shape[1]), np.float32)
        _sum_rows(out, of, self.project, f)
        return out


def fit_space(docs: DataFrame, watched: np.ndarray | None = None) -> Space:
    """TF-IDF and singular directions over the passages of all documents, and the numbers of
    ``watched`` words (those of the benchmark).

    What reaches the driver is FEATURES numbers and one a watched word, then FEATURES *
    (RANK + EXTRA). Without documents every direction is zero, and nothing is found.
    """
    codes = Codes(np.empty(0, np.uint32) if watched is None else watched)
    counts = np.zeros(FEATURES + 1 + len(codes.codes), np.int64)
    for r in docs.mapInArrow(_frequencies(codes), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES rows
        counts[r["feature"]] = r["n"]
    words = dict(zip(codes.codes.tolist(), counts[FEATURES + 1 :].tolist(), strict=True))
    counts = counts[: FEATURES + 1]
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)
    parts = docs.mapInArrow(_gram(idf), "rows int, part binary").groupBy("rows").applyInPandas(_add, "rows int, part binary").collect()
    z = np.zeros((FEATURES, RANK + EXTRA))
    if parts:
        z = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(parts, key=lambda r: r["rows"])]).reshape(FEATURES, -1)
    omega = _omega().astype(np.float64)
    values, vectors = np.linalg.eigh((omega.T @ z + z.T @ omega) / 2)
    good = values > max(values.max(), 0) * 1e-10
    if not good.any():
        return Space(idf, np.zeros((FEATURES, RANK), np.float32), words)
    u, s, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    kept = s[:RANK] > 1e-6 * s[0]
    return Space(idf, (u[:, :RANK][:, kept] / s[:RANK][kept] * idf[:, None]).astype(np.float32), words)


# ---------------------------------------------------------------- items and candidates


def answer_words(codes: np.ndarray, words: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The rarest words of an item, their places in it, and how many of these must be there.

    So many words are taken that whatever share 1 - SUBSEQUENCE of the item is reworded,
    ANSWER_HITS of their places are left: the check loses no window that keeps SUBSEQUENCE
    of the words.
    """
    distinct, n = np.unique(codes, return_counts=True)
    order = np.argsort(np.array([words.get(c, 0) for c in distinct.tolist()]), kind="stable")
    places = np.cumsum(n[order])
    lost = len(codes) - math.ceil(SUBSEQUENCE * len(codes) - 1e-9)
    k = min(int(np.searchsorted(places, lost + ANSWER_HITS)), len(places) - 1) + 1
    return distinct[order[:k]].astype(np.int64), n[order[:k]], min(ANSWER_HITS, int(places[k - 1]) - lost)


class Items:
    """Benchmark items of one window length: word codes, unit vectors, answer words, weights."""

    def __init__(self, ids: list, words: list[np.ndarray], space: Space, blocks: int):
        self.ids, self.words, self.blocks = ids, [w.tolist() for w in words], blocks
        vectors = np.concatenate([space.fold(w, np.array([len(w)]), len(w)) for w in words])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        answers = [answer_words(w, space.words) for w in words]
        self.needed = np.array([n for _, _, n in answers], np.int64)
        codes, places = (np.concatenate([a[i] for a in answers]) for i in (0, 1))
        owner = np.repeat(np.arange(len(words)), [len(c) for c, _, _ in answers])
        self.set = Codes(codes)
        by = np.argsort(codes, kind="stable")
        self.owner, self.places = owner[by], np.minimum(places[by], ANSWER_HITS).astype(np.uint8)
        self.begins = np.searchsorted(codes[by], np.r_[self.set.codes, np.iinfo(np.int64).max])
        total = sum(space.words.values())
        often = [{c: space.words.get(c, 0) for c in set(w)} for w in self.words]
        # words that no document holds weigh nothing, so that rewording can't turn the check
        self.weights = [{c: w.count(c) * math.log1p(total / n) for c, n in x.items() if n} for w, x in zip(self.words, often, strict=True)]
        self.counts = [Counter(w) for w in self.words]

    def answers_at(self, window: np.ndarray, which: np.ndarray, windows: int) -> np.ndarray:
        """(windows, items): places of answer words in each window, from the words it holds."""
        held = np.unique(window * len(self.set.codes) + which)
        window, which = held // len(self.set.codes), held % len(self.set.codes)
        n = self.begins[which + 1] - self.begins[which]
        at = np.repeat(self.begins[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(window, n) * len(self.ids) + self.owner[at]
        return np.bincount(cell, self.places[at], windows * len(self.ids)).reshape(windows, -1)

    def covered(self, j: int, near: set[int]) -> int:
        """How many of the item's words are in ``near``; no common subsequence is longer."""
        return sum(n for w, n in self.counts[j].items() if w in near)

    def answered(self, j: int, near: set[int]) -> bool:
        """Not only common words are there."""
        own = self.weights[j]
        return sum(x for w, x in own.items() if w in near) >= ANSWER_SHARE * sum(own.values())


def make_items(rows: list[tuple[int, str | None]], space: Space) -> list[Items]:
    """Items by the window that holds them, in groups; items without words are left out."""
    by: dict[int, list] = {}
    for i, t in rows:
        codes = codes_of((t or "").encode())
        if len(codes):
            by.setdefault(max(2, 1 << math.ceil(math.log2(len(codes) / BLOCK))), []).append((i, codes))
    return [
        Items([i for i, _ in own[at : at + ITEMS_AT_ONCE]], [c for _, c in own[at : at + ITEMS_AT_ONCE]], space, blocks)
        for blocks, own in sorted(by.items())
        for at in range(0, len(own), ITEMS_AT_ONCE)
    ]


def common_subsequence(item: list, words: list) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        if m := where.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def overlap_of(groups: list[Items]) -> int:
    """Words that segments share, so that every window lies whole in one with what is around it."""
    return min(2 * BLOCK * max((g.blocks for g in groups), default=0), SEGMENT // 2)


def candidates(b: Batch, sums: np.ndarray, items: Items, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, first block, item, cosine, places of answer words) of the windows near an
    item. ``sums`` has a vector for each block; windows step by a quarter, or a block."""
    n_blocks = -(-b.lens // BLOCK)
    before = np.cumsum(n_blocks) - n_blocks
    step, c = max(1, items.blocks // 4), items.blocks
    windows = -(-n_blocks // step)
    owner = np.repeat(np.arange(len(b.lens)), windows)
    first = step * (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    total = np.zeros((len(sums) + 1, sums.shape[1]))
    np.cumsum(sums, axis=0, out=total[1:])
    # answer words are looked for from half a window before to half a window after it
    place, which = items.set.find(b.codes)
    segment = np.repeat(np.arange(len(b.lens)), b.lens)[place]
    block = (place - (np.cumsum(b.lens) - b.lens)[segment]) // BLOCK
    reach = np.arange(-(-(3 * c // 2) // step) + 1) - (-(-(3 * c // 2) // step) - (c // 2) // step)
    to = (block // step)[:, None] + reach
    good = (to >= 0) & (to < windows[segment][:, None])
    good &= (block[:, None] >= to * step - c // 2) & (block[:, None] < to * step + c + c // 2)
    window = (to + (np.cumsum(windows) - windows)[segment][:, None])[good]
    which = np.repeat(which, to.shape[1]).reshape(to.shape)[good]
    by = np.argsort(window, kind="stable")
    window, which = window[by], which[by]
    for at in range(0, len(owner), WINDOWS_AT_ONCE):
        own, f = owner[at : at + WINDOWS_AT_ONCE], first[at : at + WINDOWS_AT_ONCE]
        low = before[own] + f
        vectors = (total[np.minimum(low + c, before[own] + n_blocks[own])] - total[low]).astype(np.float32)
        norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
        likeness = vectors @ items.vectors.T
        w, j = np.nonzero(likeness >= cosine * norm[:, None])
        a, z = np.searchsorted(window, [at, at + len(own)])
        places = items.answers_at(window[a:z] - at, which[a:z], len(own))[w, j]
        yield own[w], f[w], j, likeness[w, j] / norm[w], places


def search_batch(b: Batch, groups: list[Items], space: Space, best: dict[tuple, tuple], cosine: float = COSINE) -> int:
    """Put the best window of each (row, item) that is confirmed in ``best``; the number of candidates."""
    sums, starts, number = space.fold(b.codes, b.lens, BLOCK), np.cumsum(b.lens) - b.lens, 0
    for items in groups:
        half = items.blocks * BLOCK // 2
        for segment, first, j, value, places in candidates(b, sums, items, cosine):
            number += len(j)
            near_words: dict[tuple[int, int], set[int]] = {}
            for k in np.flatnonzero(places >= items.needed[j]).tolist():
                g, at, i = int(segment[k]), int(first[k]) * BLOCK, int(j[k])
                own, low = items.words[i], int(starts[g])
                if (g, at) not in near_words:
                    near_words[g, at] = set(b.codes[low + max(0, at - half) : low + min(at + 3 * half, int(b.lens[g]))].tolist())
                near = near_words[g, at]
                if items.covered(i, near) < SUBSEQUENCE * len(own):
                    continue
                length = common_subsequence(own, b.codes[low + max(0, at - half) : low + min(at + 3 * half, int(b.lens[g]))].tolist())
                if length < SUBSEQUENCE * len(own) or not (length >= SURE * len(own) or items.answered(i, near)):
                    continue
                key, found = (int(b.rows[g]), items.ids[i]), (length, round(float(value[k]), 4), -(int(b.firsts[g]) + at))
                if key not in best or found > best[key][1]:
                    best[key] = (b.ids[g], found, len(own))
    return number


_FOUND = "doc_id long, item_id long, cosine double, common_words long, item_words long, first_word long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]


def _slice_leaks(texts: DataFrame, rows: list[tuple[int, str | None]]) -> DataFrame:
    own = [codes_of((t or "").encode()) for _, t in rows]
    space = fit_space(texts, np.concatenate(own) if own else None)
    shared = texts.sparkSession.sparkContext.broadcast((space, make_items(rows, space)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_space, groups = shared.value
        best: dict[tuple, tuple] = {}

        def flush(before: float) -> Iterator[pa.RecordBatch]:
            done = [(k, best.pop(k)) for k in [k for k in best if k[0] < before]]
            if done:
                columns = zip(*((i, item, f[1], f[0], n, -f[2]) for (_, item), (i, f, n) in done), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

        for b in _batches(batches, overlap_of(groups)):
            search_batch(b, groups, own_space, best)
            yield from flush(int(b.rows[-1]))  # the last document may go on
        yield from flush(math.inf)

    return texts.mapInArrow(run, _FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, item_words, first_word) of each leaked item.

    An item leaks into a document if a window of it has cosine COSINE, keeps SUBSEQUENCE of
    its words in order, and holds ANSWER_SHARE of it by information, where the words in order
    are under SURE of it. Of a pair's windows the one with most words in order is told of,
    then that of the highest cosine, then the first. Documents and items without words (null,
    empty, punctuation alone) leak nothing, and nor does an empty table; a repeated row is
    found as often as it stands there, under its own id or null. Long texts are searched in
    overlapping segments. Only the id and the text are read, so no other column's name can
    clash. The benchmark goes to every task; one of more than ``slice_bytes`` goes in slices,
    each with a pass of its own.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    out = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        found = _slice_leaks(texts, [(r["item_id"], r["text"]) for r in part.collect()])
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without the documents that find_leaks finds; null ids stay."""
    leaked = settle(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks")
    small = leaked.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(leaked) if small else leaked, docs[id_col] == leaked["_leaked"], "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
