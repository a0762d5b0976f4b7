"""Papers written by the tasks that hold them, and shown by one rename.

Each task attempt writes into a folder of its own. When all tasks are done the driver writes
a manifest that names each paper's folder beside the one that stands, and puts it in its place.
Until then readers see the papers of before, whole; so they do if a task or the job fails.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from folioforge.sources.sinks import render_text

MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: its folder, and (paper, version) with the folder inside of each paper."""

    attempt: str
    papers: list[tuple[str, int, str]]


class PaperWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = Path(path), uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        attempt = f".{self.job}-{uuid.uuid4().hex}"
        papers = []
        for row in rows:
            inside = f"{attempt}/{row['paper_id']}/V{row['version']}"
            folder = self.path / inside
            folder.mkdir(parents=True)
            document = json.loads(row["document"])
            (folder / "test.json").write_text(row["document"], encoding="utf-8")
            (folder / f"{row['label']}.html").write_text(render_text(document), encoding="utf-8")
            (folder / f"{row['label']} barem.html").write_text(render_text(document, True), encoding="utf-8")
            papers.append((str(row["paper_id"]), int(row["version"]), inside))
        return Written(attempt, papers)

    def commit(self, messages: list[Written | None]) -> None:
        before = manifest(self.path)
        now = before | {f"{paper}/V{version}": inside for m in messages if m for paper, version, inside in m.papers}
        new = self.path / f".{self.job}.json"
        self.path.mkdir(parents=True, exist_ok=True)
        new.write_text(json.dumps(now, ensure_ascii=False, indent=1), encoding="utf-8")
        os.replace(new, self.path / MANIFEST)
        for gone in set(before.values()) - set(now.values()):
            shutil.rmtree(self.path / gone, ignore_errors=True)
        held = {inside.split("/")[0] for inside in now.values()}
        self._sweep(lambda name: name not in held)  # attempts that lost or were left by jobs before

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(lambda name: name.startswith(f".{self.job}"))

    def _sweep(self, lost) -> None:
        for folder in self.path.glob(".*-*"):
            if folder.is_dir() and lost(folder.name):
                shutil.rmtree(folder, ignore_errors=True)


class PaperSource(DataSource):
    """``df.write.format("papers").mode("append").save(folder)``; the folder is one that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def writer(self, schema: StructType, overwrite: bool) -> PaperWriter:
        return PaperWriter(self.options["path"])


def manifest(path: Path) -> dict[str, str]:
    """Each paper's folder, by ``<paper>/V<version>``; none before the first job ends."""
    try:
        return json.loads((path / MANIFEST).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}


def write_papers_together(documents: DataFrame, output: Path) -> dict[str, str]:
    """All papers of ``documents`` (paper_id, version, label, document), written where they are and shown at once.

    Papers that stand and aren't written again stay. One job writes to a folder at a time.
    """
    documents.sparkSession.dataSource.register(PaperSource)
    documents.write.format("papers").mode("append").save(str(output))
    return manifest(output)
