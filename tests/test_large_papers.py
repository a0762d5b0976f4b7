"""Papers over very many facts: as much work as facts, and the same choices as by the plain rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.functions import romanian as R
from folioforge.plans import catalogue
from folioforge.plans.paper import Rivals, papers
from folioforge.plans.validate import coverage, evidence, structural
from tests.corpus_fixture import DEEDS, ENDS
from tests.test_papers import corpus, folder, made  # noqa: F401 (fixtures)
from tests.test_readings import drawn


def test_rivals_agree_with_all_pairs():
    rng = random.Random(2)
    texts = [f"{rng.choice(L.QUALITY_TERMS)} {rng.choice(DEEDS)} {rng.choice(ENDS)}." for _ in range(150)] + [t for t, _ in drawn(150)]
    told = [(name, words) for t in texts for name in L.QUALITY_TERMS for words in R.rival_words(t, name)]
    rivals, clauses = Rivals(told), {c for t in texts for c in (t, " ".join(t.split()[1:]), " ".join(t.split()[2:5]))} | {""}
    want = {(c, n): R.unambiguous(c, n, told) for c in clauses for n in ("Ana", "Domnul", "Israel")}
    assert {k: rivals.unambiguous(*k) for k in want} == want and len(set(want.values())) == 2


def test_the_first_referents_are_all_that_is_read():
    values = iter(["Ana", "Domnul", "Dumnezeu", "Eli", "Saul"])
    assert R.distinct_referents(values, 3) == ["Ana", "Domnul", "Eli"] and next(values) == "Saul"
    assert R.distinct_referents(["Ana", "ana"], 2) is None


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Customers of one nation, so that one paper has 20,000 facts."""
    folder = tmp_path_factory.mktemp("large")
    nations = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    nations.write.parquet(f"{folder}/nation.parquet")
    segment = F.get(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", None))), (F.col("id") % 3).cast("int"))
    spark.range(20_000).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), segment.alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def timed(run, seconds):
    start = time.monotonic()
    out = run()
    assert time.monotonic() - start < seconds
    return out


def test_a_paper_of_very_many_facts_is_allocated(spark, large):
    """Work by pairs of facts took minutes here."""
    rows = timed(lambda: catalogue.paper_allocate(spark, large).collect(), 60)
    assert {(v, s): sum(r["version"] == v and r["section"] == s for r in rows) for v in (1, 2) for s in ("I", "II", "III", "IV", "error")} == {(v, s): n for v in (1, 2) for s, n in (("I", 10), ("II", 10), ("III", 1), ("IV", 3), ("error", 0))}
    spent = [{i for r in rows if r["version"] == v for i in r["fact_ids"]} for v in (1, 2)]
    assert list(map(len, spent)) == [28, 28]


def test_no_paper_without_rows(spark, large):
    facts = spark.createDataFrame([], "pos int, id string, statement string, object string, options array<string>, quality boolean, evidence struct<book:string,chapter:int>")
    from folioforge.operators.candidates import with_candidates

    assert papers(with_candidates(facts), spark.createDataFrame([("a", "b", 1)], "paper_id string, book string, chapter int")).isEmpty()


def test_what_very_many_facts_are_cited_for_is_counted(spark, large):
    rows = timed(lambda: catalogue.paper_coverage(spark, large).collect(), 60)
    assert {v: sum(r["n"] for r in rows if r["version"] == v) for v in (1, 2)} == {1: 28, 2: 28}


def test_papers_of_very_many_facts_are_sound(spark, large):
    assert timed(lambda: catalogue.paper_violations(spark, large).collect(), 120) == []


def test_facts_that_no_paper_cites_are_not_looked_up(corpus, made):  # noqa: F811
    """One that spans more verses than an array holds was an error."""
    items, selections = made
    verses, facts = corpus
    cited = {i for r in items.select("fact_ids").collect() for i in r["fact_ids"]}
    free = next(r["id"] for r in facts.select("id").orderBy("id").collect() if r["id"] not in cited)
    last = F.when(F.col("id") == free, F.lit(2**31 - 1)).otherwise(F.col("evidence.verse_end"))
    wide = facts.withColumn("evidence", F.col("evidence").withField("verse_end", last))
    assert structural(items, selections, wide).isEmpty() and evidence(items, wide, verses, selections).isEmpty()
    assert coverage(items, wide).agg(F.sum("n")).first()[0] == 28 * 4
