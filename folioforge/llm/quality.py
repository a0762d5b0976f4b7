"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

The units are UTF-8 bytes in 64 classes (letters keep their case), the order is 5 (Chen
and Goodman 1999). N-grams of trusted text are counted in each batch, summed by n-gram, and
turned into probabilities by joins of counts, contexts and lower orders. Documents are
scored by joins that are sharded by n-gram as well: a block of documents asks for each of
its distinct n-grams once, the shards answer from their part of the model, and the answers
come back to the block. So neither the model nor the corpus's n-grams are ever in one place,
and both grow with the input. A document is rejected if its bits a byte are over a quantile
of its language's trusted documents, taken from documents that the model hasn't seen.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import enter_worker, plain_name, settle

ORDER, BITS = 5, 6
CLASSES = 1 << BITS
#: An n-gram of the full order has ORDER * BITS = 30 bits.
GRAM = np.dtype("<i4")
#: The model of all languages together, for texts whose language has none of its own.
POOLED = "*"
#: A language's probabilities are mixed with the pooled ones as if these had this many bytes.
POOLED_BYTES = 20_000
#: Decisions take PRIOR_BYTES bytes of the language's mean beside the text's own, so that
#: a few odd words don't reject a short text.
PRIOR_BYTES = 128
#: The limit is this quantile of held-out trusted documents, from their order or from their
#: spread, whichever is higher (see fit); a language's excess over its mean
#: is mixed with that of all languages as if these had POOLED_DOCS documents.
QUANTILE, POOLED_DOCS = 0.999, 200
#: One of HELD_OUT trusted texts sets limits, the others train.
HELD_OUT = 5
#: Bytes of text in a block, and how many bytes of text one group of shards answers.
BLOCK_BYTES, GROUP_BYTES = 1 << 23, 1 << 25
#: Two classes before the last choose an n-gram's shard.
CELLS = CLASSES * CLASSES
BROADCAST_ROWS = 200_000
CHUNK = 1 << 20


def _class_table() -> bytes:
    def of(c: int) -> int:
        if c >= 128:
            return 62 + (c >= 192)
        ch = chr(c)
        if ch.isalpha():
            return c - 96 if ch.islower() else c - 38
        if ch.isdigit():
            return 55
        named = {" ": 53, "\n": 54, ".": 56, ",": 57} | dict.fromkeys("!?;:", 58) | dict.fromkeys("\"'()[]", 59) | dict.fromkeys("-_/", 60)
        return named.get(ch, 0 if c < 32 or c == 127 else 61)

    return bytes(map(of, range(256)))


CLASS_TABLE = _class_table()
_START = bytes([54]) * (ORDER - 1)


def grams_of(data: bytes) -> Iterator[np.ndarray]:
    """The n-grams that end at each byte, as integers; a text begins after line ends."""
    classes = _START + data.translate(CLASS_TABLE)
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(classes, np.uint8, min(CHUNK, len(data) - at) + ORDER - 1, at).astype(GRAM)
        g = b[: len(b) - ORDER + 1]
        for i in range(1, ORDER):
            g = g << BITS | b[i : len(b) - ORDER + 1 + i]
        yield g


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order, and where each begins among the sorted ones."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    return grams[first], first


def _packed(grams: np.ndarray) -> bytes:
    """Ascending n-grams as compressed steps."""
    return pa.compress(np.diff(grams, prepend=grams.dtype.type(0)).astype(GRAM).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, GRAM.itemsize * n, "zstd"), GRAM), dtype=GRAM)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema.names)


# ---------------------------------------------------------------- counts and probabilities
#
# An n-gram, its context and its suffixes down to three classes share the two classes before the
# last, so a shard of those has all that the orders from 3 on need. Orders 1 and 2, at most
# CELLS numbers a language, are summed over the shards, and so are the counts of counts.

LOW = 2
_COUNTS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_COUNTS_DDL = "shard int, lang string, n int, grams binary, counts binary"
_SHARDS = pa.schema([*_COUNTS, ("few", pa.list_(pa.int64())), ("low", pa.binary()), ("bytes", pa.int64())])
_SHARDS_DDL = f"{_COUNTS_DDL}, few array<long>, low binary, bytes long"
_LANGS = pa.schema([("lang", pa.string()), ("bytes", pa.int64()), ("discounts", pa.list_(pa.float64())), ("low", pa.binary())])


def _shard_of(cells: np.ndarray, shards: int) -> np.ndarray:
    return (cells * 40503 & 0xFFFF) * shards >> 16


def _count(shards: int):
    """(shard, lang, n-grams, counts) of some million n-grams at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("quality")
        of: dict[str | None, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for lang, parts in of.items():
                grams = np.concatenate(parts)
                own, first = _distinct(grams)
                counts, shard = np.diff(np.r_[first, len(grams)]), _shard_of(own >> BITS & (CELLS - 1), shards)
                for s in np.unique(shard).tolist():
                    at = shard == s
                    out.append((s, lang, int(at.sum()), _packed(own[at]), pa.compress(counts[at].astype("<u4").tobytes(), "zstd", asbytes=True)))
            of.clear()
            yield _rows(out, _COUNTS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for g in grams_of(text.as_py() or b""):
                    of.setdefault(lang, []).append(g)
                    held += len(g)
                    if held > 1 << 22:
                        yield from flush()
                        held = 0
        yield from flush()

    return run


def _levels(grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, n-grams, counts) from ORDER down to LOW + 1; lower orders count the distinct classes before an n-gram."""
    for k in range(ORDER, LOW, -1):
        yield k, grams, counts
        own = grams & ((1 << BITS * (k - 1)) - 1)
        grams, first = _distinct(own)
        counts = np.diff(np.r_[first, len(own)])


def _few(counts: np.ndarray) -> list[int]:
    """How many n-grams have the counts 1 to 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _merge(group: pa.Table) -> pa.Table:
    """A shard's counts of each language, and of all together as POOLED."""
    enter_worker("quality")
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in group.to_pylist():
        part = _unpacked(r["grams"], r["n"]), np.frombuffer(pa.decompress(r["counts"], 4 * r["n"], "zstd"), "<u4").astype(np.int64)
        for lang in {r["lang"], POOLED} - {None}:
            parts.setdefault(lang, []).append(part)
    out, shard = [], group.column("shard")[0].as_py() if group.num_rows else 0
    for lang, own in parts.items():
        grams, counts = (np.concatenate([p[i] for p in own]) for i in (0, 1))
        by = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.diff(grams[by], prepend=-1))
        grams, counts = grams[by][first], np.add.reduceat(counts[by], first)
        few, last = [], grams
        for _, last, n in _levels(grams, counts):
            few += _few(n)
        low = np.bincount(last & (CELLS - 1), minlength=CELLS).astype("<u4")
        out.append((shard, lang, len(grams), _packed(grams), pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True), few, pa.compress(low.tobytes(), "zstd", asbytes=True), int(counts.sum())))
    return pa.Table.from_batches([_rows(out, _SHARDS)])


def _discounts(few: list[int]) -> list[float]:
    """Of counts 1, 2 and from 3 on. A count of counts that is missing gives 0.5, 1 and 1.5."""
    if not all(few):
        return [0.5, 1.0, 1.5]
    y = few[0] / (few[0] + 2 * few[1])
    return [min(float(i), max(0.0, i - (i + 1) * y * few[i] / few[i - 1])) for i in (1, 2, 3)]


def _language(group: pa.Table) -> pa.Table:
    """A language's bytes, the discounts of all orders from ORDER down, and its counts of order 2."""
    rows = group.to_pylist()
    low = sum(np.frombuffer(pa.decompress(r["low"], 4 * CELLS, "zstd"), "<u4").astype(np.int64) for r in rows)
    few = np.sum([r["few"] for r in rows], axis=0).tolist()
    one = (low.reshape(CLASSES, CLASSES) > 0).sum(axis=0)
    few += _few(low) + _few(one)
    discounts = [d for i in range(0, len(few), 4) for d in _discounts(few[i : i + 4])]
    return pa.Table.from_batches([_rows([(rows[0]["lang"], sum(r["bytes"] for r in rows), discounts, pa.compress(low.tobytes(), "zstd", asbytes=True))], _LANGS)])


class Levels:
    """One language's part of a model: for each order n-grams and contexts, sorted, with their values."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: np.ndarray, discounts: list[float], size: int):
        self.size, self.of = size, {}
        one = (low.reshape(CLASSES, CLASSES) > 0).sum(axis=0)
        below = [(2, np.flatnonzero(low), low[low > 0]), (1, np.flatnonzero(one), one[one > 0])]
        for (k, own, n), at in zip([*_levels(grams, counts), *below], range(0, 3 * ORDER, 3), strict=True):
            d = np.r_[0.0, discounts[at : at + 3]][np.minimum(n, 3)]
            context = own >> BITS
            first = np.flatnonzero(np.diff(context, prepend=-1))
            total, freed = (np.add.reduceat(x, first) if len(first) else np.empty(0) for x in (n.astype(float), d))
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own)]))
            self.of[k] = (own, (n - d) / total[of]), (context[first], freed / total)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        names, values = table
        if not len(names):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, values[at], missing)

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of n-grams of the full order: own part and context's weight of what is below, from the uniform distribution upwards."""
        p = np.full(len(grams), 1 / CLASSES)
        for k in range(1, ORDER + 1):
            own = grams & ((1 << BITS * k) - 1)
            seen, contexts = self.of[k]
            p = self._look(seen, own, 0.0) + self._look(contexts, own >> BITS, 1.0) * p
        return p


@dataclass
class Counts:
    """What a model is made of, in written tables: n-grams by shard, and a row a language."""

    shards: int
    parts: DataFrame
    langs: DataFrame


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", group_bytes: int | None = None) -> Counts:
    """Count the n-grams of all texts of ``df``, each language's and all together."""
    own = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(CELLS, math.ceil(size / (group_bytes or GROUP_BYTES))))
    counted = own.mapInArrow(_count(shards), _COUNTS_DDL)
    parts = settle(counted.groupBy("shard").applyInArrow(_merge, _SHARDS_DDL), "ngrams")
    langs = parts.select("lang", "few", "low", "bytes").groupBy("lang").applyInArrow(_language, "lang string, bytes long, discounts array<double>, low binary")
    return Counts(shards, parts, settle(langs, "languages"))


# ---------------------------------------------------------------- scoring by sharded joins


def _pack(text_at: int, lang_at: int):
    """Blocks of rows, all columns together and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("quality")
        for batch in batches:
            lens = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(lens) // BLOCK_BYTES, prepend=0)) if len(lens) else []
            edges = sorted({0, *map(int, cut), batch.num_rows})
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([int(lens[a:b].sum())]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"]
                )

    return run


def _languages(rows: pa.Table, lang_at: int) -> Iterator[tuple[str, list[int]]]:
    """Each language of a block with its row numbers."""
    langs = np.array([POOLED if x is None else str(x) for x in rows.column(lang_at).to_pylist()], object)
    for lang in sorted(set(langs)):
        yield lang, np.flatnonzero(langs == lang).tolist()


def _some_texts(texts: pa.ChunkedArray, at: list[int]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(rows, where each begins, n-grams) of the texts in rows ``at``, some CHUNK n-grams at a time."""
    rows, starts, parts, held = [], [], [], 0
    for row in at:
        for part in grams_of(texts[row].as_py() or b""):
            rows.append(row)
            starts.append(held)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield rows, starts, np.concatenate(parts)
                rows, starts, parts, held = [], [], [], 0
    if parts:
        yield rows, starts, np.concatenate(parts)


def _all_distinct(texts: pa.ChunkedArray, at: list[int]) -> np.ndarray:
    own = np.empty(0, GRAM)
    for _, _, grams in _some_texts(texts, at):
        own, _ = _distinct(np.concatenate([own, _distinct(grams)[0]]))
    return own


_ASKS = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("block", pa.binary()), ("lang", pa.string()), ("n", pa.int32()), ("grams", pa.binary())])
_ANSWERS = pa.schema([("block", pa.binary()), ("lang", pa.string()), ("shard", pa.int32()), ("bits", pa.binary())])


def _asks(text_at: int, lang_at: int, shards: int, salts: int):
    """For each block and language its distinct n-grams, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("quality")
        for batch in batches:
            for block, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, rows = [], pa.ipc.open_stream(stored.as_py()).read_all()
                texts = rows.column(text_at).cast(pa.binary())
                for lang, at in _languages(rows, lang_at):
                    own = _all_distinct(texts, at)
                    shard = _shard_of(own >> BITS & (CELLS - 1), shards)
                    for s in np.unique(shard).tolist():
                        at = shard == s
                        out.append((s, int.from_bytes(block[:4], "little") % salts, block, lang, int(at.sum()), _packed(own[at])))
                yield _rows(out, _ASKS)

    return run


def _answer(asks: pa.Table, model: pa.Table) -> pa.Table:
    """Bits of each n-gram that a block asks for, in the order asked, in half precision."""
    enter_worker("quality")
    rows = {(r["discounts"] is None, r["lang"]): r for r in model.to_pylist()} if asks.num_rows else {}
    of: dict[str, Levels] = {}
    for (part, lang), r in rows.items():
        if not part:
            own = rows.get((True, lang))
            grams = _unpacked(own["grams"], own["n"]) if own else np.empty(0, GRAM)
            counts = np.frombuffer(pa.decompress(own["counts"], 8 * own["n"], "zstd"), "<i8") if own else np.empty(0, np.int64)
            of[lang] = Levels(grams, counts, np.frombuffer(pa.decompress(r["low"], 8 * CELLS, "zstd"), "<i8"), r["discounts"], r["bytes"])
    out = []
    for r in asks.to_pylist():
        grams = _unpacked(r["grams"], r["n"])
        p = of[POOLED].probabilities(grams) if POOLED in of else np.full(len(grams), 1 / CLASSES)
        if r["lang"] in of and r["lang"] != POOLED:
            own = of[r["lang"]]
            share = POOLED_BYTES / (own.size + POOLED_BYTES)
            p = share * p + (1 - share) * own.probabilities(grams)
        out.append((r["block"], r["lang"], r["shard"], (-np.log2(np.maximum(p, 1e-12))).astype("<f2").tobytes()))
    return pa.Table.from_batches([_rows(out, _ANSWERS)])


def _summed(text_at: int, lang_at: int, shards: int, names: list[str]):
    """The rows of a block, with the bits and bytes of each."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        enter_worker("quality")
        bits = {(lang, s): np.frombuffer(b, "<f2") for lang, s, b in zip(*(answers.column(c).to_pylist() for c in ("lang", "shard", "bits")), strict=True)}
        rows = pa.ipc.open_stream(blocks.column("rows")[0].as_py()).read_all()
        total, size = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
        texts = rows.column(text_at).cast(pa.binary())
        for lang, at in _languages(rows, lang_at):
            own = _all_distinct(texts, at)
            shard, value = _shard_of(own >> BITS & (CELLS - 1), shards), np.empty(len(own), np.float32)
            for s in np.unique(shard).tolist():
                value[shard == s] = bits[lang, s]
            for some, starts, grams in _some_texts(texts, at):
                np.add.at(total, some, np.add.reduceat(value[np.searchsorted(own, grams)], starts, dtype=np.float64))
                np.add.at(size, some, np.diff([*starts, len(grams)]))
        return pa.Table.from_arrays([*rows.columns, pa.array(total), pa.array(size)], names)

    return run


def score(df: DataFrame, model: Counts, text_col: str, lang_col: str, bits_col: str, bytes_col: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` with the bits of each text under the model and its bytes.

    A shard's model is sent to as many groups as the asks of that shard need, so that no
    group grows with the corpus.
    """
    text_at, lang_at = df.columns.index(text_col), df.columns.index(lang_col)
    blocks = settle(df.mapInArrow(_pack(text_at, lang_at), "block binary, size long, rows binary"), "blocks")
    groups = math.ceil((blocks.agg(F.sum("size")).first()[0] or 0) / (group_bytes or GROUP_BYTES))
    salts = max(1, math.ceil(groups / model.shards))
    asks = blocks.select("block", "rows").mapInArrow(_asks(text_at, lang_at, model.shards, salts), "shard int, salt int, block binary, lang string, n int, grams binary")
    parts = model.parts.select("shard", "lang", "n", "grams", "counts", F.lit(None).cast("array<double>").alias("discounts"), F.lit(None).cast("binary").alias("low"), "bytes")
    none = lambda kind: F.lit(None).cast(kind)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(model.shards - 1)))
    langs = model.langs.select(everywhere.alias("shard"), "lang", none("int").alias("n"), none("binary").alias("grams"), none("binary").alias("counts"), "discounts", "low", "bytes")
    spread = parts.union(langs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = asks.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(_answer, "block binary, lang string, shard int, bits binary")
    schema = T.StructType([*df.schema.fields, T.StructField(bits_col, T.DoubleType()), T.StructField(bytes_col, T.LongType())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed(text_at, lang_at, model.shards, schema.names), schema)


@dataclass
class Model:
    """Counts, and limits (lang, mean, limit) with POOLED among them, a written table."""

    levels: Counts
    limits: DataFrame


def _rate(bits, size, mean):
    return (bits + PRIOR_BYTES * mean) / (size + PRIOR_BYTES)


def fit(trusted: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on four fifths of the trusted texts; the rest, equal texts together, set the limits.

    Limits are quantiles of each language's held-out documents under the models that they
    would meet: their language's, and the pooled one for all. There is no least size: a small
    language leans on the pooled model and its spread.
    """
    own = trusted.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    levels = train(own.where(~held))
    langs = F.when(F.col("lang").isNull() | (F.col("lang") == POOLED), F.array(F.lit(POOLED))).otherwise(F.array("lang", F.lit(POOLED)))
    scored = score(own.where(held).select(F.explode(langs).alias("lang"), "text"), levels, "text", "lang", "bits", "bytes")
    scored = settle(scored.select("lang", "bits", "bytes"), "held-out")
    means = scored.groupBy("lang").agg((F.sum("bits") / F.sum("bytes")).alias("mean"), F.count(F.lit(1)).alias("n"))
    # one row a language; joined without a broadcast hint, Spark knows the size
    rated = scored.join(means, "lang").withColumn("rate", _rate(F.col("bits"), F.col("bytes"), F.col("mean")))
    # the largest of a few documents is well under the quantile, which the spread then tells
    by_spread = NormalDist().inv_cdf(QUANTILE) * F.coalesce(F.stddev_samp("rate"), F.lit(0.0))
    tops = rated.groupBy("lang", "mean", "n").agg(F.greatest(F.percentile_approx("rate", QUANTILE, 10_000) - F.first("mean"), by_spread).alias("excess"))
    pooled = tops.where(F.col("lang") == POOLED).select("excess").first()
    if pooled is None:
        return Model(levels, settle(tops.select("lang", "mean", F.col("mean").alias("limit")), "limits"))
    mixed = (F.col("n") * F.col("excess") + POOLED_DOCS * F.lit(pooled["excess"])) / (F.col("n") + POOLED_DOCS)
    limit = F.col("mean") + F.greatest(F.lit(0.0), F.when(F.col("lang") == POOLED, F.col("excess")).otherwise(mixed))
    return Model(levels, settle(tops.select("lang", "mean", limit.alias("limit")), "limits"))


def trusted_rows(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that a label calls good and none calls bad."""
    said = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    said = settle(said, "trusted")
    return docs.join(F.broadcast(said) if said.count() <= broadcast_rows else said, "doc_id", "left_semi")


def classify(df: DataFrame, trusted: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` with perplexity (two to the bits a byte) and accepted.

    A null or empty text has a null perplexity and is accepted; so is every text where
    nothing trusted is held out. A null or untrained language uses the pooled model and its
    limit. Rows are scored one by one, so repeated rows score alike; an empty table gives an
    empty one. Other columns stay, but for ones named perplexity or accepted, which are replaced.
    """
    model = fit(trusted, text_col, lang_col)
    df = df.drop(*[c for c in df.columns if c.lower() in ("perplexity", "accepted") and c not in (text_col, lang_col)])
    bits, size, lang, mean, limit = (plain_name(df, n) for n in ("_bits", "_bytes", "_lang", "_mean", "_limit"))
    out = score(df, model.levels, text_col, lang_col, bits, size)
    pooled = model.limits.where(F.col("lang") == POOLED).first()
    rows = model.limits.select(F.col("lang").alias(lang), F.col("mean").alias(mean), F.col("limit").alias(limit))
    small = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = out.join(F.broadcast(rows) if small else rows, F.col(lang_col).cast("string") == F.col(lang), "left")
    own = lambda c, at: F.coalesce(F.col(c), F.lit(pooled[at] if pooled else None).cast("double"))
    fits = _rate(F.col(bits), F.col(size), own(mean, "mean")) <= own(limit, "limit")
    accepted = (F.col(size) == 0) | F.coalesce(fits, F.lit(True)) if pooled else F.lit(True)
    perplexity = F.when(F.col(size) > 0, F.pow(F.lit(2.0), F.col(bits) / F.col(size)))
    return out.withColumn("perplexity", perplexity).withColumn("accepted", accepted).drop(bits, size, lang, mean, limit)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """All documents with their perplexity and whether they are accepted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, trusted_rows(docs, labels)).select("doc_id", F.round("perplexity", 6).alias("perplexity"), "accepted")
