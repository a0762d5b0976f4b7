"""Near duplicates by exact Jaccard similarity of word shingles: T-occurrence search.

Equal sets are one class, so copies never form pairs. A document that links to another
shares at least T of its shingles, so three exact filters come first, each dealing
shingles to buckets in packed arrays:

1. Of the shingles under half of the hash range, a linked class shares all but n - T.
   Classes that share fewer with any other class are done.
2. Shingles of the rest are ranked rarest first. Linked classes share one of their first
   n - T + 1, so classes meet only where such a shingle is shared (and sizes allow it).
3. Within a block of classes that meet, DivideSkip (Li, Lu and Lu 2008) looks for the
   classes that occur T times in the inverted lists of a query: short lists are merged,
   long ones are only probed for what the merge found.

Only components are wanted, so a class is never compared with one that it is already
joined to. Blocks over BLOCK_SHINGLES are cut into parts of which every two meet in a task
of their own, so no task holds more than two parts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker, settle
from folioforge.llm.components import components
from folioforge.llm.shingles import digest, shingle_set

NUM, DEN = 75, 100
#: Shingles of a packed row, of a bucket, and of a block that one task searches.
PACK, PER_BUCKET, BLOCK_SHINGLES = 1 << 20, 1 << 21, 1 << 21
#: A table of 16-byte keys is broadcast up to this many rows.
BROADCAST_ROWS = 200_000
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01
HALF = np.uint64(1 << 63)


def least_overlap(n: int, m: int) -> int:
    """Shared shingles that sets of n and m need: 100 * shared >= 75 * (n + m - shared)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def own_overlap(n):
    """Shared shingles that a set of n needs with any other."""
    return -(-NUM * n // DEN)


# ---------------------------------------------------------------- packed rows


def _deal(tokens: np.ndarray, owners: np.ndarray, classes: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, positions, their tokens, tokens of each owner); owners ascend."""
    bucket = ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b, end in enumerate(ends.tolist()):
        at = order[(ends[b - 1] if b else 0) : end]
        if len(at):
            yield b, at, tokens[at], np.bincount(owners[at], minlength=classes)


def _short(tokens: np.ndarray) -> np.ndarray:
    """What tells tokens of one bucket apart in a filter; chance meetings only let more through."""
    return (tokens >> np.uint64(31)).astype("<u4")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[np.ndarray]]]:
    """(rows, digests, sets) of about PACK shingles each; a class comes once in a block."""
    enter_worker("ngram_join")
    ids: list = []
    seen: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for row, text in zip(batch.column(0), batch.column(batch.num_columns - 1).cast(pa.binary()), strict=True):
            s = shingle_set(text.as_py())
            if not len(s) or (d := digest(s)) in seen:
                continue
            seen[d] = len(sets)
            ids.append(row.as_py())
            sets.append(s)
            held += len(s)
            if held >= PACK:
                yield ids, list(seen), sets
                ids, seen, sets, held = [], {}, [], 0
    if sets:
        yield ids, list(seen), sets


def _frame(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)


def _block_id(digests: list[bytes]) -> bytes:
    return digest(np.frombuffer(b"".join(digests), "<u8"))


# ---------------------------------------------------------------- filter 1: what is shared at all

_ASK = ["bucket", "block", "tokens", "at", "counts", "classes"]
_ASK_TYPES = [pa.int32(), *[pa.binary()] * 5]
_ASK_SCHEMA = "bucket int, block binary, tokens binary, at binary, counts binary, classes binary"


def _ask(buckets: int):
    """For each block, its low shingles by bucket, and in bucket -1 what its classes need.

    Shingles that two classes of a block share are known to be shared; they are sent once
    and need no answer, so a shingle of very many documents is a row a block and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, digests, sets in _blocks(batches):
            n = np.array([len(s) for s in sets], np.int64)
            owners = np.repeat(np.arange(len(sets)), n)
            tokens = np.concatenate(sets)
            low = tokens < HALF
            tokens, owners = tokens[low], owners[low]
            values, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
            known = times[at] > 1
            need = np.bincount(owners, minlength=len(sets)) - (n - own_overlap(n)) - np.bincount(owners[known], minlength=len(sets))
            block = _block_id(digests)
            rows = [(-1, block, b"", b"", need.astype("<i4").tobytes(), b"".join(digests))]
            marks = np.frombuffer(b"".join(d[:8] for d in digests), "<u8")
            for b, _, t, counts in _deal(tokens[~known], owners[~known], len(sets), buckets):
                some = np.flatnonzero(counts)
                rows.append((b, block, _short(t).tobytes(), some.astype("<u4").tobytes(), counts[some].astype("<u4").tobytes(), marks[some].tobytes()))
            shared = values[times > 1]
            for b, _, t, _ in _deal(shared, np.zeros(len(shared), np.int64), 1, buckets):
                rows.append((b, block, _short(t).tobytes(), None, None, None))
            yield _frame(rows, _ASK, _ASK_TYPES)

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """For each block the number of shingles of each class that another class has too."""
    names = ["block", "at", "counts", "classes"]
    if group["bucket"].iloc[0] < 0:
        return group[names]
    tokens, marks, owners, spans, held = [], [], [], [], 0
    for t, c, m in zip(group["tokens"], group["counts"], group["classes"], strict=True):
        t = np.frombuffer(t, "<u4")
        if m is None:  # from two classes or more
            tokens += [t, t]
            marks += [np.zeros(len(t), np.uint64), np.full(len(t), ~np.uint64(0))]
            owners.append(np.full(2 * len(t), -1))
        else:
            owner = np.repeat(np.arange(len(m) // 8), np.frombuffer(c, "<u4"))
            tokens.append(t)
            marks.append(np.frombuffer(m, "<u8")[owner])
            owners.append(owner + held)
            held += len(m) // 8
        spans.append(held)
    token, mark, owner = map(np.concatenate, (tokens, marks, owners))
    order = np.argsort(token, kind="stable")
    token, mark, owner = token[order], mark[order], owner[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    several = np.minimum.reduceat(mark, first) != np.maximum.reduceat(mark, first)
    hit = np.repeat(several, np.diff(np.r_[first, len(token)])) & (owner >= 0)
    counts, out, start = np.bincount(owner[hit], minlength=held), [], 0
    for block, at, end in zip(group["block"], group["at"], spans, strict=True):
        own = counts[start:end]
        if own.any():
            out.append((block, np.frombuffer(at, "<u4")[own > 0].tobytes(), own[own > 0].astype("<i4").tobytes(), None))
        start = end
    return pd.DataFrame(out, columns=names)


def _passes(group: pd.DataFrame) -> pd.DataFrame:
    """The classes of a block that share enough."""
    own = group[group["classes"].notna()].iloc[0]
    need = np.frombuffer(own["counts"], "<i4").astype(np.int64)
    got, answers = np.zeros(len(need), np.int64), group[group["classes"].isna()]
    for at, counts in zip(answers["at"], answers["counts"], strict=True):
        got[np.frombuffer(at, "<u4")] += np.frombuffer(counts, "<i4")
    return pd.DataFrame({"cls": [own["classes"][16 * i : 16 * i + 16] for i in np.flatnonzero(got >= need)]})


# ---------------------------------------------------------------- filter 2: where classes meet


def _df_answer(group: pd.DataFrame) -> pd.DataFrame:
    """For each block the document frequencies of its shingles, to 255, in the order they were sent."""
    parts = [np.frombuffer(t, "<u4") for t in group["tokens"]]
    _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    df, ends = np.minimum(8 * np.log2(times[at]), 255).astype(np.uint8), np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "df": [x.tobytes() for x in np.split(df, ends[:-1])]})


def _prefixes(buckets: int):
    """From a block's sets and frequencies: the shared shingles of each class's prefix, by bucket."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = {b: np.frombuffer(x, np.uint8) for b, x in zip(right["bucket"], right["df"], strict=True)}
        for _, r in left.head(1).iterrows():  # a block repeated by repeated rows is the same block
            n = np.frombuffer(r["counts"], "<u4").astype(np.int64)
            tokens, owners = np.frombuffer(r["tokens"], "<u8"), np.repeat(np.arange(len(n)), n)
            df = np.zeros(len(tokens), np.uint8)
            for b, at, _, _ in _deal(tokens, owners, len(n), buckets):
                df[at] = answers[b]
            order = np.lexsort((tokens, df, owners))
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            keep = order[(rank < (n - own_overlap(n) + 1)[owners]) & (df[order] > 0)]
            for b, at, t, counts in _deal(tokens[keep], owners[keep], len(n), buckets):
                some = np.flatnonzero(counts)
                digests = b"".join(r["classes"][16 * i : 16 * i + 16] for i in some)
                out.append((b, t.astype("<u8").tobytes(), counts[some].astype("<u4").tobytes(), n[some].astype("<u4").tobytes(), digests))
        return pd.DataFrame(out, columns=["bucket", "tokens", "counts", "sizes", "classes"])

    return run


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """A tree of the classes that share a prefix shingle of this bucket and may link by size."""
    classes = np.concatenate([np.frombuffer(c, "V16") for c in group["classes"]])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in group["counts"]])
    sizes = np.concatenate([np.frombuffer(c, "<u4") for c in group["sizes"]]).astype(np.int64)
    names, own = np.unique(np.array([bytes(c) for c in classes], object), return_inverse=True)
    owner = np.repeat(own, counts)
    size = np.repeat(sizes, counts)
    token = np.concatenate([np.frombuffer(t, "<u8") for t in group["tokens"]])
    order = np.lexsort((size, token))
    owner, size, token = owner[order], size[order], token[order]
    meets = (token[1:] == token[:-1]) & (own_overlap(size[1:]) <= size[:-1]) & (owner[1:] != owner[:-1])
    label = local_components(owner[1:][meets], owner[:-1][meets], len(names))
    off = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"u": names[off], "v": names[label[off]]})


# ---------------------------------------------------------------- the search in a block


class OccurrenceIndex:
    """Inverted lists over the sets of a block, in order of size, and the classes joined so far."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        values, self.token = np.unique(np.concatenate(self.sets), return_inverse=True)
        owners = np.repeat(np.arange(len(sets)), self.n)
        self.postings = owners[by := np.argsort(self.token, kind="stable")]
        self.begins = np.searchsorted(self.token[by], np.arange(len(values)))
        self.own = np.empty(len(by), np.int64)  # where each entry stands in its list
        self.own[by] = np.arange(len(by))
        self.at = np.r_[0, np.cumsum(self.n)]
        self.root = np.arange(len(sets))
        self.member = np.full(len(values), -1)  # of each list so far, and whether all are joined
        self.uniform = np.ones(len(values), bool)

    def _join(self, a: int, b: int) -> None:
        ra, rb = self.root[a], self.root[b]
        if ra != rb:
            self.root[self.root == max(ra, rb)] = min(ra, rb)

    def _linked(self, a: int, b: int) -> bool:
        x, y = self.token[self.at[a] : self.at[a + 1]], self.token[self.at[b] : self.at[b + 1]]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= least_overlap(len(x), len(y))

    def search(self, q: int) -> list[int]:
        """The earlier sets that reach the overlap with q and aren't joined to it."""
        tokens = self.token[self.at[q] : self.at[q + 1]]
        starts, ends = self.begins[tokens], self.own[self.at[q] : self.at[q + 1]]
        need = own_overlap(int(self.n[q]))
        first = int(np.searchsorted(self.n, need))  # smaller sets can't link
        skip = self.uniform[tokens] & (self.member[tokens] >= 0) & (self.root[self.member[tokens]] == self.root[q])
        live = (ends > starts) & ~skip
        if live.sum() < need:
            return []
        starts, ends = starts[live], ends[live]
        lens = ends - starts
        by = np.argsort(lens, kind="stable")
        longest = int(lens[by[-1]])
        n_long = min(int(need / (MU * math.log2(longest + 1) + 1)), need - 1) if longest > 8 else 0
        short, long = by[: len(by) - n_long], by[len(by) - n_long :]
        floor = need - n_long
        ids, counts = _merge([self.postings[s:e] for s, e in zip(starts[short].tolist(), ends[short].tolist(), strict=True)], floor)
        keep = (ids >= first) & (self.root[ids] != self.root[q])
        ids, counts = ids[keep], counts[keep].astype(np.int64)
        for i, k in enumerate(long):
            if not len(ids):
                return []
            part = self.postings[starts[k] : ends[k]]
            spot = np.minimum(np.searchsorted(part, ids), len(part) - 1)
            counts += part[spot] == ids
            if i % 16 == 15:  # those that can't reach it any more
                alive = counts + (len(long) - 1 - i) >= need
                ids, counts = ids[alive], counts[alive]
        reach = counts >= -(-NUM * (self.n[q] + self.n[ids]) // (NUM + DEN))
        return ids[reach].tolist()

    def run(self) -> np.ndarray:
        """The root of each set, in the order the sets were given."""
        for q in range(len(self.sets)):
            tokens = self.token[self.at[q] : self.at[q + 1]]
            members = self.member[tokens]
            if len(some := members[members >= 0]):
                guess = int(np.bincount(some).argmax())
                if self._linked(q, guess):  # most often a copy of what it meets most
                    self._join(q, guess)
                for r in self.search(q):
                    self._join(q, r)
            here = self.root[q]
            self.uniform[tokens] &= (members < 0) | (self.root[members] == here)
            self.member[tokens] = np.where(members < 0, q, members)
        out = np.empty(len(self.sets), np.int64)
        out[self.order] = np.array(self.order)[self.root]
        return out


def _merge(lists: list[np.ndarray], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids in at least ``floor`` of the lists, with counts: a heap merge of a few short
    lists, and for more than that the same merge as one sort."""
    if sum(map(len, lists)) <= 64:
        ids, counts = [], []
        for x in heapq.merge(*(p.tolist() for p in lists)):
            if ids and ids[-1] == x:
                counts[-1] += 1
            else:
                ids.append(x)
                counts.append(1)
        ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
    else:
        ids, counts = np.unique(np.concatenate(lists), return_counts=True)
    return ids[counts >= floor], counts[counts >= floor]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; each task's classes are searched together."""
    enter_worker("ngram_join")
    key, names, sets = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(names) > 1:
            root = OccurrenceIndex(sets).run()
            yield _frame([(names[i], names[r]) for i, r in enumerate(root.tolist()) if r != i], ["u", "v"], [pa.binary(), pa.binary()])

    for batch in batches:
        for task, name, tokens in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            if (k := task.as_py()) != key:
                yield from flush()
                key, names, sets = k, [], []
            names.append(name.as_py())
            sets.append(np.frombuffer(tokens.as_py(), "<u8"))
    yield from flush()


# ---------------------------------------------------------------- the join


def class_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, cls) of every row; cls is null where there is no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("ngram_join")
        for batch in batches:
            n, cls = [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py())
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary())], ["doc_id", "n_shingles", "cls"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, cls binary")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _candidate_sets(docs: DataFrame, table: DataFrame, classes: DataFrame) -> DataFrame:
    """Packed rows with the sets of ``classes``, each from one document that has it; a class
    that only rows without an id hold comes from those."""
    own = table.join(_small(classes), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    own = settle(own.select("doc_id").distinct(), "survivors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, digests, sets in _blocks(batches):
            counts = np.array([len(s) for s in sets], "<u4")
            yield _frame([(_block_id(digests), counts.tobytes(), np.concatenate(sets).astype("<u8").tobytes(), b"".join(digests))], ["block", "counts", "tokens", "classes"], [pa.binary()] * 4)

    return settle(docs.join(_small(own.withColumnRenamed("doc_id", "_own")), F.col("doc_id").eqNullSafe(F.col("_own")), "left_semi").select("doc_id", "text").mapInArrow(run, "block binary, counts binary, tokens binary, classes binary"), "sets")


def _spread(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = np.frombuffer(r["counts"], "<u4")
            tokens = np.frombuffer(r["tokens"], "<u8")
            rows = [(b, r["block"], _short(t).tobytes()) for b, _, t, _ in _deal(tokens, np.repeat(np.arange(len(n)), n), len(n), buckets)]
            yield _frame(rows, ["bucket", "block", "tokens"], [pa.int32(), pa.binary(), pa.binary()])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = np.frombuffer(r["counts"], "<u4").astype(np.int64)
            ends = 8 * np.cumsum(n)
            rows = [(r["classes"][16 * i : 16 * i + 16], int(n[i]), r["tokens"][int(e) - 8 * int(n[i]) : int(e)]) for i, e in enumerate(ends)]
            yield _frame(rows, ["cls", "n", "tokens"], [pa.binary(), pa.int64(), pa.binary()])


def _buckets(total: int) -> int:
    return max(8, math.ceil(total / PER_BUCKET))


def similarity_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df``.

    Rows link if 100 * shared >= 75 * union over their distinct 5-word shingles; the
    component is the smallest id that links reach. Rows without words link to nothing.
    Repeated rows and ids are kept; rows without an id link like others and pass links on,
    but only name a component that holds no id. Other columns aren't read, so their names
    can't clash. An empty table gives an empty table.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = settle(class_table(docs, "doc_id", "text"), "classes")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = _buckets(total // 2)
    asked = docs.mapInArrow(_ask(buckets), _ASK_SCHEMA)
    answers = asked.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("block")).alias("_b")).applyInPandas(_answer, "block binary, at binary, counts binary, classes binary")
    passed = settle(answers.groupBy("block").applyInPandas(_passes, "cls binary").distinct(), "passed")
    sets = _candidate_sets(docs, table, passed)
    left = sets.agg(F.sum(F.length("tokens"))).first()[0] or 0
    buckets = _buckets(left // 8)
    frequencies = sets.mapInArrow(lambda x: _spread(x, buckets), "bucket int, block binary, tokens binary").groupBy("bucket").applyInPandas(_df_answer, "block binary, bucket int, df binary")
    prefixes = sets.groupBy("block").cogroup(frequencies.groupBy("block")).applyInPandas(_prefixes(buckets), "bucket int, tokens binary, counts binary, sizes binary, classes binary")
    met = components(prefixes.groupBy("bucket").applyInPandas(_meet, "u binary, v binary"))
    met = met.union(met.select(F.col("v").alias("u"), "v").distinct())
    rows = sets.mapInArrow(_unpack, "cls binary, n long, tokens binary").join(_small(met.withColumnRenamed("u", "cls")), "cls")
    sizes = met.withColumnRenamed("u", "cls").join(table.select("cls", "n_shingles").distinct(), "cls").groupBy("v").agg(F.sum("n_shingles").alias("held"))
    large = settle(sizes.where(F.col("held") > block_shingles).select("v", F.ceil(F.col("held") * 2 / block_shingles).cast("int").alias("parts")), "large")
    n_large = large.count()
    rows = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "v", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = rows.withColumn("a", part).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.concat_ws("-", F.hex("v"), F.least("a", "b"), F.greatest("a", "b"))
    tasks = rows.select(task.alias("task"), "cls", "tokens").repartition("task").sortWithinPartitions("task", "cls")
    links = tasks.mapInArrow(_search, "u binary, v binary")
    found = components(links) if n_large else settle(links, "links")
    least = table.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = least.join(_small(found.withColumnRenamed("u", "cls")), "cls", "left").withColumn("root", F.coalesce("v", "cls"))
    lowest = named.join(_small(found.select(F.col("v").alias("root")).distinct()), "root", "left_semi")
    roots = lowest.groupBy("root").agg(F.min("low").alias("component"))
    of_class = named.join(roots, "root", "left").select("cls", F.coalesce("component", "low").alias("component_id"))
    return table.join(_small(of_class), "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their shingle set and their component."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
