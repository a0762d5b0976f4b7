import json

import pytest
from pyspark.sql import functions as F

from folioforge.cli import generate
from folioforge.errors import GenerationError, SelectionError, ValidationError
from folioforge.operators.candidates import with_candidates
from folioforge.operators.facts import facts_for
from folioforge.plans.paper import papers
from folioforge.plans.validate import coverage, evidence, require_sound, structural
from folioforge.sources.config import DEFAULTS, load_config
from folioforge.sources.corpus import manifest_problems, read_corpus, read_manifest
from folioforge.sources.sinks import label, swap_folder
from tests.corpus_fixture import markdown, verse


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    (path / "1samuel-reference-text.md").write_text(markdown(), encoding="utf-8")
    (path / "notes.md").write_text("1 Nimic", encoding="utf-8")
    (path / "verse-counts.json").write_text(json.dumps({"_note": "", "chapters": {"1 Samuel": [30] * 4, "Rut": [5]}}))
    return path


@pytest.fixture(scope="module")
def corpus(spark, folder):
    verses, facts, _ = read_corpus(spark, str(folder))
    return verses.cache(), facts.cache()


@pytest.fixture(scope="module")
def made(spark, corpus):
    rows = [("a", "1 Samuel", c) for c in (1, 2, 3)] + [("b", "1 Samuel", 4)]
    selections = spark.createDataFrame(rows, "paper_id string, book string, chapter int")
    return papers(with_candidates(corpus[1]), selections, versions=2).cache(), selections


def test_every_verse_is_parsed_as_written(corpus):
    got = {(r["chapter"], r["verse"]): r["text"] for r in corpus[0].collect()}
    assert got == {(n // 30 + 1, n % 30 + 1): " ".join(verse(n).split()) for n in range(120)}


def test_manifest_names_what_is_lost(spark, corpus, folder):
    manifest = read_manifest(spark, str(folder / "verse-counts.json"))
    verses = corpus[0].where("not (chapter = 2 and verse = 7)").withColumn("verse", F.expr("if(chapter = 3 and verse = 30, 31, verse)"))
    got = {tuple(r) for r in manifest_problems(verses, manifest).collect()}
    assert got == {("1 Samuel", 2, "missing", 7), ("1 Samuel", 3, "missing", 30), ("1 Samuel", 3, "extra", 31)}
    assert manifest_problems(corpus[0], manifest).isEmpty()


def test_json_corpus(spark, tmp_path):
    fact = {"id": "x", "statement": "s", "subject": "", "predicate": "", "object": "o", "evidence": {"book": "Rut", "chapter": 1, "verse_start": 2, "text": "s"}}
    (tmp_path / "c.json").write_text(json.dumps({"books": {"Rut": {"1": {"1": "a", "2": "s"}}}, "facts": [fact]}))
    verses, facts, translation = read_corpus(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in verses.collect()} == {("Rut", 1, 1, "a"), ("Rut", 1, 2, "s")} and translation
    row = facts.first()
    assert row["quality"] and row["options"] == [] and row["evidence"]["verse_end"] == 2
    (tmp_path / "bare.json").write_text(json.dumps({"Rut": {"1": {"1": "a"}}}))
    assert read_corpus(spark, str(tmp_path / "bare.json"))[0].count() == 1
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "absent"))


def test_options_are_the_first_others_of_the_group(corpus):
    rows = corpus[1].orderBy("pos").collect()
    from folioforge.lexicon import term_group

    for r in rows:
        seen = list(dict.fromkeys(o["object"] for o in rows if o["quality"] and term_group(o["object"]) == term_group(r["object"]) and o["object"] != r["object"]))
        assert r["options"] == [r["object"], *seen[:2]]


def test_scope_errors(spark, corpus):
    verses, facts = corpus
    frame = lambda rows: spark.createDataFrame(rows, "book string, chapter int")
    with pytest.raises(SelectionError, match="Rut"):
        facts_for(facts, verses, frame([("Rut", 1)]))
    with pytest.raises(SelectionError, match="9"):
        facts_for(facts, verses, frame([("1 Samuel", 9)]))
    assert facts_for(facts, verses, frame([("1 Samuel", 2), ("1 Samuel", 2)])).count() == 30


def test_papers_are_sound_and_repeatable(spark, corpus, made):
    items, selections = made
    verses, facts = corpus
    assert items.where("section = 'error'").isEmpty()
    assert structural(items, selections, facts).isEmpty() and evidence(items, facts, verses, selections).isEmpty()
    assert {r[0] for r in coverage(items, facts).groupBy("paper_id", "version").agg(F.sum("n")).select("sum(n)").collect()} == {28}
    again = papers(with_candidates(facts), selections, versions=2)
    assert sorted(map(str, items.collect())) == sorted(map(str, again.collect()))


def test_versions_share_little(made):
    spent = {(r["paper_id"], r["version"]): set(r["f"]) for r in made[0].groupBy("paper_id", "version").agg(F.flatten(F.collect_list("fact_ids")).alias("f")).collect()}
    assert len(spent["a", 1] & spent["a", 2]) <= 7


def breaks():
    return {
        "affirmation": ("section = 'I' and ordinal = 1", "correct", F.when(F.col("correct")[0] == "A", F.array(F.lit("F"))).otherwise(F.array(F.lit("A")))),
        "answer isn't": ("section = 'II' and ordinal = 1", "options", F.transform_values("options", lambda k, v: F.concat(F.lit("Nimeni"), k))),
        "fact is used twice": ("section = 'II' and ordinal = 2", "fact_ids", F.array(F.lit("1 Samuel-1-1"), F.lit("1 Samuel-1-1"))),
        "unknown fact": ("section = 'IV' and ordinal = 1", "fact_ids", F.array(F.lit("nimic"))),
        "out of scope": ("section = 'I' and ordinal = 2", "fact_ids", F.array(F.lit("1 Samuel-4-1"))),
        "some right": ("section = 'IV' and ordinal = 2", "correct", F.array().cast("array<string>")),
        "bijection": ("section = 'III'", "correct", F.array(*map(F.lit, "AABCD"))),
        "halves": ("section = 'III'", "left_column", F.transform("left_column", lambda x: F.concat(x, F.lit("?")))),
    }


@pytest.mark.parametrize("rule", ["affirmation", "answer isn't", "fact is used twice", "unknown fact", "out of scope", "some right", "bijection", "halves"])
def test_broken_papers_are_found(corpus, made, rule):
    where, column, value = breaks()[rule]
    verses, facts = corpus
    items = made[0].where("paper_id = 'a' and version = 1").withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))
    found = structural(items, made[1], facts).unionByName(evidence(items, facts, verses, made[1]))
    assert any(rule in r["rule"] for r in found.collect())
    with pytest.raises(ValidationError):
        require_sound(found)


def test_altered_evidence_is_found(corpus, made):
    verses = corpus[0].withColumn("text", F.concat("text", F.lit("!")))
    assert not evidence(made[0], corpus[1], verses, made[1]).isEmpty()


def test_thin_selections_give_a_reason(spark, corpus):
    selections = spark.createDataFrame([("x", "1 Samuel", 1)], "paper_id string, book string, chapter int")
    rows = papers(with_candidates(corpus[1].where("pos.verse <= 20")), selections).collect()
    assert [r["section"] for r in rows] == ["error"] and "28" in rows[0]["question"]


def test_command_line_writes_all_or_nothing(spark, folder, tmp_path):
    out = generate(spark, "1 Samuel 1-3", str(folder), str(tmp_path), load_config(tmp_path / "none"), 1, 1)
    assert [p.name for p in out] == ["V1"]
    document = json.loads((out[0] / "test.json").read_text(encoding="utf-8"))
    assert document["total_points"] == 85 and sum(document["coverage"].values()) == 28
    assert {p.suffix for p in out[0].iterdir()} == {".json", ".html"} and any("1-3 V1 barem" in p.name for p in out[0].iterdir())
    before = (out[0] / "test.json").read_bytes()

    def fail(staging):
        (staging / "test.json").write_text("x")
        raise OSError("full")

    with pytest.raises(OSError):
        swap_folder(out[0], fail)
    assert (out[0] / "test.json").read_bytes() == before and sorted(p.name.split(".")[1] if p.name[0] == "." else p.name for p in out[0].parent.iterdir()) == ["V1", "V1"]  # the link and what it is turned to
    with pytest.raises(SelectionError):
        generate(spark, "1 Samuel 1-2", str(folder), str(tmp_path), DEFAULTS)
    with pytest.raises(GenerationError):
        raise GenerationError("kept apart from defects")


def test_labels(spark):
    rows = [("p", "1 Samuel", c) for c in (1, 2, 3, 5)] + [("p", "Rut", 1)]
    assert label(spark.createDataFrame(rows, "paper_id string, book string, chapter int")).first()["label"] == "1 Samuel 1-3,5; Rut 1"


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7 # x\ncontest:\n  name: \"Alt\"\n  edition: 3\nscoring:\n  section_1: 9\n")
    config = load_config(tmp_path / "c.yaml")
    assert config["seed"] == 7 and config["contest"] == {"name": "Alt", "edition": 3} and config["scoring"]["section_1"] == 9 and config["scoring"]["section_4"] == 5


def test_targets_by_rank(spark):
    from folioforge.operators.facts import facts_of, preferred_terms

    texts = ["Casa Domnului era a lui Saul.", "Chivotul Domnului sta acolo.", "În zori Hanun a venit.", "Mergea și Hanun cu oastea.", "Oastea cea mare plângea.", "Hanun, Hanun."]
    verses = spark.createDataFrame([("Rut", 1, i, t) for i, t in enumerate(texts, 1)], "book string, chapter int, verse int, text string")
    assert {tuple(r) for r in preferred_terms(verses).collect()} == {("Hanun", 3), ("Domnului", 2)}
    facts = {r["evidence"]["verse_start"]: r for r in facts_of(verses).collect()}
    assert [facts[i]["object"] for i in range(1, 7)] == ["Saul", "Domnului", "Hanun", "Hanun", "plângea", "Hanun"]
    assert [facts[i]["quality"] for i in range(1, 7)] == [True, True, False, False, False, False]
    with pytest.raises(Exception, match="verificabil"):
        facts_of(spark.createDataFrame([("Rut", 1, 1, "a b c")], "book string, chapter int, verse int, text string")).collect()


def test_lookups(spark, corpus):
    from folioforge.sources.corpus import chapter, passage
    from folioforge.sources.corpus import verse as one

    assert chapter(corpus[0], "1 Samuel", 2).count() == 30 and one(corpus[0], "1 Samuel", 2, 3).first()["text"] == " ".join(verse(32).split())
    assert passage(corpus[0], spark.createDataFrame([("1 Samuel", 4)], "book string, chapter int")).count() == 30
