"""Language identification with bit-sliced Bloom filters over byte n-grams.

Each slot of the filter holds one bit for each language, so one probe returns the mask
of all languages that contain an n-gram. The set bits of a text's n-grams are counted by
language, corrected for the false positives of each language's own fill, and decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioforge.llm.common import enter_worker, settle

#: An n-gram belongs to a language if it is at least this share of the language's n-grams
#: (so a language has 1 / LEAST_RATE n-grams at most, which bounds the model) ...
LEAST_RATE = 1e-5
#: ... and at least this share of the rate in the language where it is most common.
LEAST_RATIO = 0.2
PROBES = 2
SLOTS_PER_GRAM = 16
MOST_LANGUAGES = 4096
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_TABLE = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams_of(text: str) -> np.ndarray:
    """The 3- and 4-byte windows of the lower-cased words between single blanks, as integers."""
    data = b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return np.concatenate([three, three[:-1] | b[3:] << 24])


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    g = grams.astype(np.uint64) + np.uint64(1)
    return [(g * m) >> np.uint64(64 - bits) for m in _MULTIPLIERS[:PROBES]]


@dataclass
class Model:
    """languages in order of their share of the training text; masks[slot, word]."""

    languages: list[str]
    masks: np.ndarray
    bits: int
    false_rates: np.ndarray

    def masks_of(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages that contain it, in words of the filter's type."""
        first, *rest = _slots(grams, self.bits)
        out = self.masks[first]
        for s in rest:
            out &= self.masks[s]
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        grams, n = grams_of(text), len(self.languages)
        hits = np.zeros(n)
        for at in range(0, len(grams), 1 << 18):
            found = self.masks_of(grams[at : at + (1 << 18)])
            width = 8 * found.itemsize
            for i in range(n):
                hits[i] += np.count_nonzero(found[:, i // width] & found.dtype.type(1 << i % width))
        true = np.maximum(0, (hits - self.false_rates * len(grams)) / (1 - self.false_rates))
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true[best] > 0 else 0.0


def build(rows: list[tuple[str, np.ndarray]]) -> Model:
    """A filter of ``rows``: each language and its n-grams, the language with most text first."""
    n, total = len(rows), sum(len(g) for _, g in rows)
    kind = np.dtype(np.uint8 if n <= 8 else np.uint64)
    width = 8 * kind.itemsize
    bits = max(10, int(np.ceil(np.log2(max(1, total) * SLOTS_PER_GRAM))))
    masks = np.zeros((1 << bits, max(1, -(-n // width))), kind)
    fill = np.zeros(n)
    for i, (_, grams) in enumerate(rows):
        bit = kind.type(1 << i % width)
        for s in _slots(grams, bits):
            masks[s, i // width] |= bit
        fill[i] = np.count_nonzero(masks[:, i // width] & bit) / len(masks)
    return Model([name for name, _ in rows], masks, bits, np.minimum(0.5, fill**PROBES))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows that have a text and a language.

    N-grams are counted in each batch by language, then summed. The model is collected:
    1 / LEAST_RATE n-grams a language at most. More than MOST_LANGUAGES languages raise
    ValueError. No row to learn from gives a model without languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[str, list[np.ndarray]] = {}
            held = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for lang, parts in of.items():
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
                of.clear()

            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = grams_of(text.as_py())
                of.setdefault(lang.as_py(), []).append(grams)
                held += len(grams)
                if held > 1 << 23:
                    yield from flush()
                    held = 0
            yield from flush()

    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_LANGUAGES + 1)
    found = sorted(((r["lang"], r["total"]) for r in totals.collect()), key=lambda x: (-x[1], x[0]))
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= LEAST_RATE)
    kept = rates.withColumn("most", F.max("rate").over(W.partitionBy("gram"))).where(F.col("rate") >= LEAST_RATIO * F.col("most"))
    table = kept.select("lang", "gram").toArrow().to_pandas()
    by = {lang: g["gram"].to_numpy(np.uint32) for lang, g in table.groupby("lang")}
    return build([(lang, by.get(lang, np.empty(0, np.uint32))) for lang, _ in found])


def identify(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score.

    Null text, text without a letter, and any text if no language was learned are
    ``und`` with score 0. A text without a known n-gram gets the language with most
    training text and score 0; so do ties that the counts leave.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("language_id")
        for batch in batches:
            found = [shared.value.decide(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    docs = docs.withColumn("held_out", fold == 2)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
