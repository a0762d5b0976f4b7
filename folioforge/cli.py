"""``python -m folioforge.cli --chapters "1 Samuel 1-3"``: papers from a local corpus."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from folioforge.errors import GenerationError, SelectionError, ValidationError
from folioforge.operators.candidates import with_candidates
from folioforge.operators.facts import facts_for
from folioforge.operators.selection import parse_selection, require_minimum
from folioforge.plans.paper import papers
from folioforge.plans.validate import evidence, require_sound, structural
from folioforge.sources.config import load_config
from folioforge.sources.corpus import read_corpus
from folioforge.sources.sinks import paper_documents, write_papers


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Lucrări de concurs dintr-un corpus local.")
    p.add_argument("--chapters", required=True, help="de ex. „1 Samuel 1,3-5; 2 Samuel 1”")
    p.add_argument("--version", type=int, default=1)
    p.add_argument("--versions", type=int, default=1, help="variante care își împart versetele cât se poate")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--corpus", default="data")
    p.add_argument("--output", default="output")
    return p.parse_args(argv)


def generate(spark: SparkSession, chapters: str, corpus: str, output: str, config: dict, first: int = 1, versions: int = 1) -> list[Path]:
    """Scan, select, work out candidates, allocate, check, write; nothing is written if a check fails."""
    chosen = parse_selection(chapters)
    require_minimum(chosen)
    rows = [("paper", book, c) for book, own in chosen.items() for c in own]
    selections = spark.createDataFrame(rows, "paper_id string, book string, chapter int")
    verses, facts, translation = read_corpus(spark, corpus)
    facts = facts_for(facts, verses, selections).cache()
    items = papers(with_candidates(facts), selections, int(config["seed"]), first, versions).cache()
    try:
        if failed := items.where("section = 'error'").first():
            raise GenerationError(failed["question"])
        require_sound(structural(items, selections, facts).unionByName(evidence(items, facts, verses, selections)))
        return list(write_papers(paper_documents(items, facts, selections, config, translation), Path(output)))
    finally:
        items.unpersist()
        facts.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for folder in generate(spark, args.chapters, args.corpus, args.output, load_config(args.config), args.version, args.versions):
            print(folder)
    except (SelectionError, GenerationError, ValidationError, FileNotFoundError) as e:
        print(f"Eroare: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
