"""Checks of papers as queries: each rule finds its violations, and none means a sound paper.

``items`` are the rows of plans.paper.papers; evidence comes from the facts by id, and from
the verses themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.errors import ValidationError
from folioforge.functions import romanian as R
from folioforge.functions import text as X
from folioforge.tables import small

_KEYS = ["paper_id", "version"]
SIZES = {"I": 10, "II": 10, "III": 1, "IV": 3}


def _says(rows: DataFrame, rule: str, where: Column | str | None = None) -> DataFrame:
    """(paper_id, version, rule, item) of the rows that break a rule."""
    rows = rows if where is None else rows.where(where)
    item = F.concat_ws("-", "section", F.col("ordinal").cast("string")) if "ordinal" in rows.columns else F.lit("")
    return rows.select(*_KEYS, F.lit(rule).alias("rule"), item.alias("item"))


def _cited(items: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts that items cite; a paper cites 28, however many it could."""
    return facts.join(small(items.select(F.explode("fact_ids").alias("id")).distinct()), "id", "left_semi")


def structural(items: DataFrame, selections: DataFrame, facts: DataFrame) -> DataFrame:
    """Sizes, domains, scope, balance of letters and answers, bijection, distinct facts."""
    papers = items.where("section <> 'error'")
    sizes = papers.groupBy(*_KEYS).pivot("section", list(SIZES)).count().fillna(0)
    out = [_says(sizes, f"section {s} has {n} items", F.col(s) != n) for s, n in SIZES.items()]
    values = F.map_values("options")
    three = (F.array_sort(F.map_keys("options")) == F.array(*map(F.lit, "ABC"))) & (F.size(F.array_distinct(values)) == 3)
    out.append(_says(papers, "true or false", (F.col("section") == "I") & ~(F.coalesce(F.col("correct")[0].isin("A", "F"), F.lit(False)) & (F.length("question") > 0))))
    out.append(_says(papers, "three options, one right", (F.col("section") == "II") & ~(three & (F.size("correct") == 1) & F.array_contains(F.map_keys("options"), F.col("correct")[0]))))
    out.append(_says(papers, "three options, some right", (F.col("section") == "IV") & ~(three & (F.size("correct") > 0) & (F.size(F.array_except("correct", F.map_keys("options"))) == 0))))
    alike = F.exists(values, lambda a: F.size(F.filter(values, lambda b: X.same_referent(a, b))) > 1)
    out.append(_says(papers, "two options name one answer", F.col("section").isin("II", "IV") & alike))
    one = papers.where("section = 'II'").select(*_KEYS, F.col("correct")[0].alias("letter"), F.element_at("options", F.col("correct")[0]).alias("answer"))
    for column, most in (("letter", L.LETTER_CAP), ("answer", L.ANSWER_CAPS[1])):
        out.append(_says(one.groupBy(*_KEYS, column).count(), f"one {column} too often", F.col("count") > most))
    five = F.array(*map(F.lit, "ABCDE"))
    match = (F.array_sort(F.map_keys("options")) == five) & (F.array_sort("correct") == five) & (F.size(F.array_distinct(values)) == 5) & (F.size("left_column") == 5) & (F.size("fact_ids") == 5)
    out.append(_says(papers, "matching is no bijection", (F.col("section") == "III") & ~F.coalesce(match, F.lit(False))))
    used = papers.select(*_KEYS, F.explode("fact_ids").alias("id"))
    out.append(_says(used.groupBy(*_KEYS, "id").count(), "a fact is used twice", F.col("count") > 1))
    scope = selections.select("paper_id", "book", "chapter").distinct()
    where = _cited(papers, facts.select("id", "evidence")).select("id", F.col("evidence.book").alias("book"), F.col("evidence.chapter").alias("chapter"))
    placed = papers.select(*_KEYS, "section", "ordinal", F.explode("fact_ids").alias("id")).join(where, "id", "left")
    out.append(_says(placed.where("book is null"), "unknown fact"))
    out.append(_says(placed.where("book is not null").join(scope, ["paper_id", "book", "chapter"], "left_anti"), "evidence out of scope"))
    return reduce(DataFrame.unionByName, out)


def passage_text(facts: DataFrame, verses: DataFrame) -> DataFrame:
    """(id, verses_text): the verses that the evidence of each fact spans, in order."""
    span = facts.select("id", F.col("evidence.book").alias("book"), F.col("evidence.chapter").alias("chapter"), F.explode(F.sequence("evidence.verse_start", "evidence.verse_end")).alias("verse"))
    rows = span.join(verses.select("book", "chapter", "verse", "text"), ["book", "chapter", "verse"], "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("id").agg(X.squeeze(joined).alias("verses_text"))


def _true_false(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Affirmations that the cited text doesn't bear out: a true one is a sentence of it, a false
    one is one allowed replacement in the sentence that it makes; both are found anew from the text."""
    names = ["section", "ordinal", *_KEYS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from folioforge.plans.paper import replacement

        def fits(mark: str, said: str, text: str, name: str, known: set[str]) -> bool:
            if mark == "A":
                return said in R.sentences(text)
            source = R.concise(text, name)
            if not source or name == L.OBLIQUE_DEITY:
                return False
            *_, hit = R.whole_word(name).finditer(source)
            before, after = source[: hit.start()], source[hit.end() :]
            new = said[len(before) : len(said) - len(after)]
            return said == before + new + after and new in known and replacement(name, source, (), [new], False) == new

        for b in batches:
            bad = [not fits(*r) for r in zip(b["mark"], b["question"], b["text"], b["object"], map(set, b["targets"]), strict=True)]
            yield b.loc[bad, names]

    rows = items.where("section = 'I'").select("section", "ordinal", *_KEYS, "question", F.col("correct")[0].alias("mark"), F.col("e.evidence.text").alias("text"), F.col("e.object").alias("object"))
    return rows.join(targets, "paper_id").mapInPandas(run, "section string, ordinal int, paper_id string, version int")


def _lists(items: DataFrame) -> DataFrame:
    """Items that ask for a list's members and don't credit every member among their options."""
    names = ["section", "ordinal", *_KEYS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for question, options, correct, text in zip(b["question"], b["options"], b["correct"], b["text"], strict=True):
                found = R.enumeration(text)
                belong = {k for k, v in dict(options).items() if found and v in found[1]}
                bad.append(bool(found) and found[0] == question and belong != set(correct))
            yield b.loc[bad, names]

    rows = items.where("section = 'IV'").select("section", "ordinal", *_KEYS, "question", "options", "correct", F.col("e.evidence.text").alias("text"))
    return rows.mapInPandas(run, "section string, ordinal int, paper_id string, version int")


def evidence(items: DataFrame, facts: DataFrame, verses: DataFrame, selections: DataFrame) -> DataFrame:
    """Whether the corpus bears out every answer, and the evidence is the corpus's own text."""
    papers = items.where("section <> 'error'")
    cited = _cited(papers, facts.select("id", "object", "evidence")).cache()  # each rule reads them
    known = cited.select("id", F.struct("object", "evidence").alias("e"))
    single = papers.where("section <> 'III'").withColumn("id", F.col("fact_ids")[0]).join(known, "id")
    scope = small(selections.select("paper_id", "book", "chapter").distinct())
    targets = facts.join(scope, (F.col("evidence.book") == F.col("book")) & (F.col("evidence.chapter") == F.col("chapter"))).groupBy("paper_id").agg(F.collect_set("object").alias("targets"))
    out = [_says(_true_false(single, targets), "affirmation isn't borne out"), _says(_lists(single), "a member of the list isn't credited")]
    answer = F.element_at("options", F.col("correct")[0])
    out.append(_says(single, "answer isn't in the verse", (F.col("section") == "II") & ~X.mentions(F.col("e.evidence.text"), answer)))
    held = F.forall("correct", lambda c: F.contains(F.col("e.evidence.text"), F.element_at("options", c)))
    out.append(_says(single, "answer isn't in the verse", (F.col("section") == "IV") & ~held))
    rows = papers.where("section = 'III'").select("section", "ordinal", *_KEYS, "options", F.explode(F.arrays_zip("left_column", "correct", "fact_ids")).alias("r"))
    rows = rows.withColumn("id", F.col("r.fact_ids")).join(known, "id")
    both = F.contains("e.evidence.text", F.col("r.left_column")) & F.contains("e.evidence.text", F.element_at("options", F.col("r.correct")))
    out.append(_says(rows, "halves aren't in the verse", ~both))
    used = papers.select(*_KEYS, "section", "ordinal", F.explode("fact_ids").alias("id")).join(known, "id").join(passage_text(cited, verses), "id", "left")
    out.append(_says(used, "evidence isn't the corpus's text", ~X.squeeze(F.col("e.evidence.text")).eqNullSafe(F.col("verses_text"))))
    return reduce(DataFrame.unionByName, out)


def require_sound(violations: DataFrame) -> None:
    """ValidationError with up to 50 violations, if there are any."""
    if bad := violations.orderBy("paper_id", "version", "rule", "item").limit(50).collect():
        raise ValidationError("\n".join(f"{r['paper_id']} V{r['version']} {r['item']}: {r['rule']}" for r in bad))


def coverage(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(paper_id, version, passage, n): how often each chapter is cited."""
    cited = items.select(*_KEYS, F.explode("fact_ids").alias("id")).join(_cited(items, facts).select("id", "evidence"), "id")
    return cited.groupBy(*_KEYS, F.concat_ws(" ", "evidence.book", F.col("evidence.chapter").cast("string")).alias("passage")).agg(F.count(F.lit(1)).alias("n"))


def total_points(scoring: dict[str, int]) -> int:
    return 10 * scoring["section_1"] + 10 * scoring["section_2"] + 5 * scoring["section_3"] + 3 * scoring["section_4"]
