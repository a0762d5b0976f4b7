"""Every question a fact could become, worked out once for all papers.

``with_candidates`` reads statements in Arrow batches and is what papers use. ``candidate_columns``
gives the same columns by expressions alone, which run faster and take longer to plan: for
the 120 facts of the tests 26 and 2 seconds to plan and run, in batches 1 and 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioforge import lexicon as L
from folioforge.functions import readings as G
from folioforge.functions import romanian as R
from folioforge.functions import text as X

_STEM = "struct<stem:string,segment:string,answer:string,tail:string>"
SCHEMA = (
    "concise string, concise_named string, blanks array<{s}>, place {s}, numeral {s}, wh {s}, named string, left string, right string, "
    "list_stem string, list_members array<string>, rivals array<array<string>>, numerals array<string>, places array<string>"
).format(s=_STEM)
NAMES = ["concise", "concise_named", "blanks", "place", "numeral", "wh", "named", "left", "right", "list_stem", "list_members", "rivals", "numerals", "places"]


def wh_question(clause: Column, name: Column) -> Column:
    stem = F.concat(F.lit("Cine "), clause, F.lit("?"))
    return F.when(name.isin(L.PERSONAL) & clause.isNotNull(), F.struct(stem.alias("stem"), clause.alias("segment"), name.alias("answer"), F.lit("").alias("tail")))


def candidate_columns(facts: DataFrame) -> DataFrame:
    """``facts`` with one column for each shape; null where the fact doesn't lend itself to it.

    What the whole statement names, and which of its sentences stand alone, are worked out
    first, since most shapes ask for them.
    """
    own = facts.columns
    statement, name = F.col("statement"), F.col("object")
    holds = lambda s: G.self_contained(s, F.col("_named"))
    rows = facts.select(*own, G.named_nouns(G.tokens(statement)).alias("_named"))
    rows = rows.select("*", F.transform(X.sentences(statement), lambda s: F.struct(s.alias("s"), holds(s).alias("alone"))).alias("_told"))
    told = F.col("_told")
    alone = F.transform(F.filter(told, lambda t: t["alone"]), lambda t: t["s"])
    rows = rows.select(
        "*", X.shortest_fit(alone).alias("_concise"), X.shortest_fit(F.filter(alone, lambda s: X.mentions(s, name))).alias("_concise_named"), G.clause_halves(statement, holds).alias("_halves"),
        G.enumeration(statement, holds).alias("_list"), G.name_predicate(statement, name, holds, quotes=True).alias("_quoted"),
    )
    return rows.select(
        *own, F.col("_concise.sentence").alias("concise"), F.col("_concise_named.sentence").alias("concise_named"), G.completions(told, name).alias("blanks"), G.place_stem(told).alias("place"),
        G.numeral_stem(told).alias("numeral"), wh_question(F.col("_quoted"), name).alias("wh"), G.name_predicate(statement, name, holds).alias("named"), F.col("_halves.left").alias("left"), F.col("_halves.right").alias("right"),
        F.col("_list.stem").alias("list_stem"), F.col("_list.members").alias("list_members"), G.rival_words(statement, name).alias("rivals"), G.numerals_in(statement).alias("numerals"), G.places_in(statement).alias("places"),
    )


# ---------------------------------------------------------------- in batches


def _stem(s: R.Stem | None) -> dict | None:
    return s and {"stem": s.stem, "segment": s.segment, "answer": s.answer, "tail": s.tail}


@lru_cache(maxsize=10_000)
def candidates_of(statement: str, name: str) -> list:
    """What a statement can ask of a name, in the order of NAMES; equal ones are read once and shared, so don't change it."""
    left, right = R.clause_halves(statement) or (None, None)
    stem, members = R.enumeration(statement) or (None, None)
    return [
        R.concise(statement), R.concise(statement, name), [_stem(b) for b in R.completions(statement, name)], _stem(R.place_stem(statement)),
        _stem(R.numeral_stem(statement)), _stem(R.wh_question(statement, name)), R.name_predicate(statement, name), left, right, stem, members,
        [sorted(w) for w in R.rival_words(statement, name)], R.numerals_in(statement), R.places_in(statement),
    ]


def with_candidates(facts: DataFrame) -> DataFrame:
    """``facts`` with one column for each shape; null where the fact doesn't lend itself to it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema.fields)
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(SCHEMA))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [candidates_of(s, n) for s, n in zip(b["statement"].to_pylist(), b["object"].to_pylist(), strict=True)]
            shapes = [pa.array([m[i] for m in made], types[n]) for i, n in enumerate(NAMES)]
            yield pa.RecordBatch.from_arrays([*b.columns, *shapes], [*b.schema.names, *NAMES])

    return facts.mapInArrow(run, f"{fields}, {SCHEMA}")
