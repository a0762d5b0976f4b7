"""Papers out: JSON documents as a table, and folders of files that change all at once."""

from __future__ import annotations

import html
import json
import os
import secrets
import shutil
from collections.abc import Iterator
from contextlib import ExitStack
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.plans.validate import coverage, total_points


def label(selections: DataFrame) -> DataFrame:
    """(paper_id, label): books with their chapters as ranges."""
    books = selections.groupBy("paper_id", "book").agg(X.range_label(F.collect_set("chapter")).alias("r"))
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", "book", "r")))
    return books.groupBy("paper_id").agg(F.array_join(parts, "; ").alias("label"))


def _literal(value: dict) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def paper_documents(items: DataFrame, facts: DataFrame, selections: DataFrame, config: dict, translation: str) -> DataFrame:
    """(paper_id, version, label, document): one JSON text for each paper.

    The time of making is text in UTC. Evidence stands with each fact it comes from.
    """
    known = facts.select("id", F.col("evidence").withField("id", F.col("id")).alias("e"))
    cited = items.select("paper_id", "version", "section", "ordinal", F.posexplode("fact_ids").alias("at", "id")).join(known, "id")
    cited = cited.groupBy("paper_id", "version", "section", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda r: r["e"]).alias("evidence"))
    full = items.join(cited, ["paper_id", "version", "section", "ordinal"])
    item = F.struct("section", "ordinal", "question", "options", "correct", "left_column", "fact_ids", "evidence")
    order = lambda r: F.struct(r["section"], r["ordinal"])  # noqa: E731  maps have no order, so the key is compared
    sign = lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)
    made = full.groupBy("paper_id", "version").agg(F.array_sort(F.collect_list(item), sign).alias("rows"))
    source = selections.groupBy("paper_id", "book").agg(F.array_sort(F.collect_set("chapter")).alias("c")).groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book", "c")))).alias("source"))
    cover = coverage(items, facts).groupBy("paper_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("passage", "n")))).alias("coverage"))
    rows = made.join(source, "paper_id").join(cover, ["paper_id", "version"]).join(label(selections), "paper_id")
    document = F.struct(
        "source", F.lit(int(config["seed"])).alias("seed"), "version", _literal(config["contest"]).alias("contest"), _literal(config["scoring"]).alias("scoring"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.lit("folioforge").alias("generator"),
        F.col("rows").alias("items"), F.lit(total_points(config["scoring"])).alias("total_points"), "coverage", F.lit(translation).alias("translation"),
    )
    return rows.select("paper_id", "version", F.concat_ws(" ", "label", F.concat(F.lit("V"), F.col("version").cast("string"))).alias("label"), F.to_json(document, {"pretty": "true"}).alias("document"))


def render_text(document: dict, answers: bool = False) -> str:
    """A paper as HTML, with its answers or without."""
    out = [f"<h1>{html.escape(str(document.get('contest', {}).get('name', '')))}</h1>"]
    for item in document["items"]:
        out.append(f"<p>{item['section']}-{item['ordinal']}. {html.escape(item['question'] or '')}</p>")
        for i, left in enumerate(item.get("left_column") or [], 1):
            out.append(f"<div>{i}. {html.escape(left)}</div>")
        for key, value in sorted((item.get("options") or {}).items()):
            out.append(f"<div>{key}) {html.escape(value)}</div>")
        if answers:
            out.append(f"<b>{', '.join(item['correct'])}</b>")
    return "\n".join(out) + "\n"


def swap_folder(folder: Path, write) -> Path:
    """``write(new)`` fills a new hidden folder; then ``folder``, a link, is turned to it by one
    rename, and what it was turned to before goes. If anything fails the link is as it was."""
    folder.parent.mkdir(parents=True, exist_ok=True)
    new = folder.parent / f".{folder.name}.{secrets.token_hex(6)}"
    link = new.with_name(f"{new.name}.link")
    before = folder.resolve() if folder.is_symlink() else None
    with ExitStack() as undo:
        undo.callback(shutil.rmtree, new, ignore_errors=True)
        undo.callback(link.unlink, missing_ok=True)
        new.mkdir()
        write(new)
        link.symlink_to(new.name, target_is_directory=True)
        if before is None and folder.is_dir():  # a plain folder of that name, from elsewhere
            raise FileExistsError(folder)
        os.replace(link, folder)
        undo.pop_all()
    if before:
        shutil.rmtree(before, ignore_errors=True)
    return folder


def write_papers(documents: DataFrame, output: Path) -> Iterator[Path]:
    """A folder for each paper and version: test.json, the paper and its key."""
    for row in documents.toLocalIterator():
        document = json.loads(row["document"])

        def write(staging: Path, row=row, document=document) -> None:
            (staging / "test.json").write_text(row["document"], encoding="utf-8")
            (staging / f"{row['label']}.html").write_text(render_text(document), encoding="utf-8")
            (staging / f"{row['label']} barem.html").write_text(render_text(document, True), encoding="utf-8")

        yield swap_folder(output / str(row["paper_id"]) / f"V{row['version']}", write)
