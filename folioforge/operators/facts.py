"""Facts: what a verse is asked about, whether that is a known name, and rival options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioforge import lexicon as L
from folioforge.errors import SelectionError
from folioforge.functions import text as X

_CAPITALISED = r"(?U)(?<!\w)[A-ZĂÂÎȘȚ][a-zăâîșț]+(?!\w)"
_LONG = r"(?U)(?<!\w)[a-zăâîșțA-ZĂÂÎȘȚ]{5,}(?!\w)"
#: Values of a group that option seeding keeps: own, two others, and one to spare.
SEEDS = 3


def capitalised(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(0))


def preferred_terms(verses: DataFrame, least: int = 2) -> DataFrame:
    """(term, n): capitalised words met ``least`` times, but for stop words and the word that opens a verse."""
    terms = F.filter(capitalised(F.col("text")), lambda w, i: ~((i == 0) & F.startswith("text", w)) & ~w.isin(L.STOP_TERMS))
    return verses.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def known_names(text: Column) -> Column:
    return F.filter(capitalised(text), lambda w: w.isin(L.QUALITY_TERMS))


def first_preferred(verses: DataFrame) -> DataFrame:
    """(book, chapter, verse, proper): the first preferred term of each verse without a known
    name. Terms grow with the corpus, so they are joined and not sent along."""
    plain = verses.where(F.size(known_names(F.col("text"))) == 0)
    each = plain.select("book", "chapter", "verse", F.posexplode(capitalised(F.col("text"))).alias("at", "term")).where(~F.col("term").isin(L.STOP_TERMS))
    return each.join(preferred_terms(verses), "term", "left_semi").groupBy("book", "chapter", "verse").agg(F.min_by("term", "at").alias("proper"))


def target(text: Column, proper: Column) -> Column:
    """The first known name that isn't oblique, else the oblique one, else ``proper``, else the
    first of the longest words of five letters; a text with none is an error."""
    known = known_names(text)
    direct = F.filter(known, lambda w: w != L.OBLIQUE_DEITY)
    longest = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(_LONG), F.lit(0)), lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w"))))["w"]
    first = lambda a: F.get(a, F.lit(0))
    none = F.raise_error(F.concat(F.lit("Nu pot extrage un răspuns verificabil din verset: "), text)).cast("string")
    return F.coalesce(first(direct), first(known), proper, longest, none)


def seed_options(facts: DataFrame) -> DataFrame:
    """``facts`` with options: own object, then the first two others of its group among quality
    facts in corpus order. The first SEEDS values of a group are enough, so no pairs are made."""
    group = X.term_group(F.col("object"))
    first = facts.where("quality").groupBy(group.alias("_g"), "object").agg(F.min(F.struct("book", "chapter", "verse")).alias("at"))
    few = first.withColumn("r", F.row_number().over(W.partitionBy("_g").orderBy("at"))).where(F.col("r") <= SEEDS)
    few = few.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "object"))), lambda x: x["object"]).alias("_few"))
    joined = facts.withColumn("_g", group).join(F.broadcast(few), "_g", "left")  # a row a group
    others = F.slice(F.filter(F.coalesce("_few", F.array().cast("array<string>")), lambda o: o != F.col("object")), 1, 2)
    return joined.withColumn("options", F.concat(F.array("object"), others)).drop("_g", "_few")


def facts_of(verses: DataFrame) -> DataFrame:
    """A fact for each verse."""
    known = verses.join(first_preferred(verses), ["book", "chapter", "verse"], "left")
    where = F.concat_ws("-", "book", "chapter", "verse")
    facts = known.select(
        "book", "chapter", "verse", where.alias("id"), F.col("text").alias("statement"),
        F.concat(F.lit("versetul "), X.reference(F.col("book"), F.col("chapter"), F.col("verse"), F.col("verse"))).alias("subject"),
        F.lit("completează").alias("predicate"), target(F.col("text"), F.col("proper")).alias("object"),
        F.struct("book", "chapter", F.col("verse").alias("verse_start"), F.col("verse").alias("verse_end"), "text").alias("evidence"),
    )
    facts = seed_options(facts.withColumn("quality", F.col("object").isin(L.QUALITY_TERMS)))
    return facts.select(F.struct("book", "chapter", "verse").alias("pos"), "id", "statement", "subject", "predicate", "object", "evidence", "options", "quality")


def missing_scope(verses: DataFrame, selection: DataFrame) -> DataFrame:
    """(book, chapter, last): selected chapters that the corpus lacks; last is null for a missing book."""
    held = verses.groupBy("book").agg(F.max("chapter").alias("last"))
    gone = selection.join(verses.select("book", "chapter").distinct(), ["book", "chapter"], "left_anti")
    return gone.join(F.broadcast(held), "book", "left")


def facts_for(facts: DataFrame, verses: DataFrame, selection: DataFrame) -> DataFrame:
    """The facts of the selected chapters; SelectionError names what the corpus doesn't hold."""
    if gone := missing_scope(verses, selection).orderBy("book", "chapter").limit(200).collect():
        if (r := gone[0])["last"] is None:
            books = ", ".join(x["book"] for x in verses.select("book").distinct().orderBy("book").collect())
            raise SelectionError(f"Cartea „{r['book']}” nu există în corpusul local. Disponibile: {books}.")
        chapters = ", ".join(str(x["chapter"]) for x in gone if x["book"] == r["book"])
        raise SelectionError(f"„{r['book']}” nu are capitolul {chapters} (are 1-{r['last']}).")
    scope = selection.select("book", "chapter").distinct()
    return facts.join(F.broadcast(scope), (facts["evidence.book"] == scope["book"]) & (facts["evidence.chapter"] == scope["chapter"]), "left_semi")
