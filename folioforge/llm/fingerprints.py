"""Document fingerprints by consistent weighted sampling (Ioffe 2010), in column expressions only.

A text's terms are its lower-cased words, weighted by their counts. For each sample ``k`` a term
has two numbers ``r`` and ``c`` of Gamma(2, 1) and one ``b`` of the unit interval, all drawn from its hash:
``t = floor(ln(weight) / r + b)``, ``y = exp(r * (t - b))``, ``a = c / (y * exp(r))``. The term with the
least ``a`` gives (term, t), and two texts agree in a sample with the probability of their
generalised Jaccard likeness: the sum of the lesser weights over the sum of the greater ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioforge.llm.sharding import _cell

#: Samples of a fingerprint; a likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32
BLANKS = r"[ \t-\r]+"
#: Ranges of ids: documents in one, the most of them, documents in a task, and tasks at most.
DOCS_PER_CELL, MOST_CELLS, DOCS_PER_TASK, MOST_TASKS = 250, 32_768, 2_000, 20_000
#: An id that fills a range is cut by the hash of its texts.
HOT_PARTS = 16
_LOW = 0xFFFFFFFF


def _unit(bits: Column, width: int) -> Column:
    """A number between 0 and 1, never either, from the lowest ``width`` bits."""
    return (bits.bitwiseAND((1 << width) - 1) + F.lit(0.5)) * F.lit(2.0**-width)


def sample(term: Column, ln_weights: list[Column], k: int) -> list[Column]:
    """Sample ``k`` of a term for each weight: a long that orders as ``a`` does and whose low half names
    (term, t); null where the weight's logarithm is. What the weights share is written alike, so it is worked out once."""
    first = F.xxhash64(F.lit(k), term)
    second = F.xxhash64(F.lit(k), first)
    r = -F.ln(_unit(first, 21) * _unit(F.shiftrightunsigned(first, 21), 21))
    b = _unit(F.shiftrightunsigned(first, 42), 22)
    ln_c = F.ln(-F.ln(_unit(second, 32) * _unit(F.shiftrightunsigned(second, 32), 32)))
    out = []
    for ln_w in ln_weights:
        t = F.floor(ln_w / r + b)
        ln_a = ln_c - r * (t - b + F.lit(1.0))
        rank = F.floor((ln_a + F.lit(128.0)) * F.lit(float(1 << 22)))
        name = second.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(_LOW)
        out.append(F.shiftleft(rank, 32).bitwiseOR(name))
    return out


def signatures(rows: DataFrame, keys: list[str], contents: list[str], numbers: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys``, the ``numbers`` (longs), and for each of ``contents`` its signature, an array of ``samples`` longs.

    Rows of one key are one text. A null text is empty; texts without words have a signature
    of nulls. Terms are summed by key and hash before they are sampled; if ``rows`` are
    partitioned by some of the keys, nothing is shuffled.
    """
    # The numbers of a row travel like terms of other kinds, so that the many rows of terms don't carry them.
    pick = [F.struct(F.lower(F.coalesce(F.col(c), F.lit(""))).alias("text"), F.lit(0).alias("kind"), *[F.lit(int(i == j)).cast("long").alias(f"w{j}") for j in range(len(contents))]) for i, c in enumerate(contents)]
    nothing = F.lit(None).cast("string").alias("text")
    pick += [F.struct(nothing, F.lit(i + 1).alias("kind"), *[(F.col(c).cast("long") if j == 0 else F.lit(0).cast("long")).alias(f"w{j}") for j in range(len(contents))]) for i, c in enumerate(numbers)]
    own = [F.col(c) for c in keys]
    each = rows.select(*own, F.inline(F.array(*pick)))
    weights = [f"w{j}" for j in range(len(contents))]
    words = each.select(*own, "kind", *weights, F.explode_outer(F.split("text", BLANKS, -1)).alias("word")).where("kind > 0 or word <> ''")
    terms = words.groupBy(*own, "kind", F.xxhash64("word").alias("term")).agg(*[F.sum(w).alias(w) for w in weights])
    # the logarithm of 0 is null and so is that of a number's row, so that only terms of a text are sampled for it
    logs = terms.select(*own, "kind", "term", "w0", *[F.ln(F.when(F.col("kind") == 0, F.col(w))).alias(f"l{j}") for j, w in enumerate(weights)])
    drawn = [sample(F.col("term"), [F.col(f"l{j}") for j in range(len(contents))], k) for k in range(samples)]
    mins = [F.min(d[j]).alias(f"s{j}_{k}") for k, d in enumerate(drawn) for j in range(len(contents))]
    back = [F.max(F.when(F.col("kind") == i + 1, F.col("w0"))).alias(c) for i, c in enumerate(numbers)]
    found = logs.groupBy(*own).agg(*back, *mins)
    return found.select(*own, *numbers, *[F.array(*[F.col(f"s{j}_{k}").bitwiseAND(_LOW) for k in range(samples)]).alias(c) for j, c in enumerate(contents)])


def text_form(signature: Column) -> Column:
    """The signature as hexadecimal digits, eight a sample; without words an empty text."""
    return F.array_join(F.transform(signature, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree; 1 if both texts have no words, 0 if one has."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda s: s))
    return same / F.size(a)


def fingerprint(docs: DataFrame, id_col: str, text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of the documents; rows of one id, null among them, are one document. Only signatures are shuffled."""
    made = signatures(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), ["key"], ["text"], [], samples)
    return made.select(F.col("key").alias(id_col), text_form(F.col("text")).alias("fingerprint"))


def _with_next(docs: DataFrame, docs_per_cell: int) -> DataFrame:
    """(cell, part, place, guest, id, text, next): each document with the next one's text by ascending id.

    Ids are cut into ranges at their quantiles, and the first document of each range is a
    guest at the end of the range before it, so that one shuffle by range is all it takes.
    """
    n = docs.count()
    cells, cuts, hot = max(1, min(MOST_CELLS, math.ceil(n / docs_per_cell))), [], []
    if cells > 1:
        found = docs.select(F.percentile_approx("id", [i / cells for i in range(1, cells)], 4 * MOST_CELLS)).first()[0] or []
        hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
        cuts = sorted({x for c in found for x in ((c, c + 1) if c in hot and c < (1 << 63) - 1 else (c,))})
    part = F.when(F.col("id").isNull() | F.col("id").isin(hot), F.pmod(F.xxhash64("text"), F.lit(HOT_PARTS))).otherwise(0) if cells > 1 else F.lit(0)
    own = docs.select(F.when(F.col("id").isNull(), -1).otherwise(_cell(F.col("id"), cuts)).cast("int").alias("cell"), part.cast("int").alias("part"), "id", "text")
    heads = own.groupBy("cell", "part").agg(F.min("id").alias("head"))  # at most MOST_CELLS rows, and HOT_PARTS for each hot id
    order = W.orderBy("cell", "part")
    ends = F.last(F.struct("cell", "part")).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.coalesce(F.lag(F.struct("cell", "part")).over(order), ends)
    heads = heads.select("head", F.col("cell").alias("at_cell"), F.col("part").alias("at_part"), before.alias("before"))
    met = (F.col("cell") == F.col("at_cell")) & (F.col("part") == F.col("at_part")) & F.col("id").eqNullSafe(F.col("head"))
    guests = own.join(F.broadcast(heads), met).groupBy("before").agg(F.min("text").alias("text"))
    guests = guests.select("before.cell", "before.part", F.lit(1).cast("long").alias("guest"), F.lit(None).cast("long").alias("id"), "text")
    both = own.select("cell", "part", F.lit(0).cast("long").alias("guest"), "id", "text").unionByName(guests)
    tasks = max(1, min(MOST_TASKS, math.ceil(n / DOCS_PER_TASK)))
    here = W.partitionBy("cell", "part").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    return both.repartition(tasks, "cell", "part").select("*", F.row_number().over(here).alias("place"), F.lead("text").over(here).alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str, text_col: str, *, samples: int = SAMPLES, docs_per_cell: int = DOCS_PER_CELL) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many,
    or all, of the next document: that of the next id, after the last the first; null ids
    come first. Rows of one id follow each other by their texts; those of an id that fills a
    whole range, and of null ids in a table of several ranges, by a hash of the text first.
    A null text is empty, and a text without words has an empty fingerprint, which is like
    other empty ones only. Repeated rows stay; an empty table gives an empty one. No other
    column is read. Ids are integers.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_col} must be an integer")
    rows = _with_next(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), docs_per_cell)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("cell", "part", "place", "guest", "id", "text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left(F.coalesce("next", F.lit("")), half)).alias("edited"))
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"sha_{i}") for i in range(4)]
    rows = rows.select("*", *quarters)
    made = signatures(rows, ["cell", "part", "place"], ["text", "edited"], ["id", "n_chars", "guest", *[f"sha_{i}" for i in range(4)]], samples)
    following = F.lead("text").over(W.partitionBy("cell", "part").orderBy("place"))
    made = made.withColumn("following", following).where("guest = 0")
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"sha_{i}"), 16, "0")) for i in range(4)])
    return made.select(
        F.col("id").alias(id_col), "n_chars", sha.alias("edited_sha256"), text_form(F.col("text")).alias("fingerprint"), text_form(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("following")).alias("near_next"),
    )


def op13_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to these and to the next document."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
