"""Files that are read in blocks give the verses of files read whole."""

import random

from folioforge.sources.corpus import read_long_markdown, read_markdown

WORDS = "regele omul cetatea a venit în casa lui David și Saul „vino” 12 oameni poporul".split()


def book(seed: int) -> str:
    rng = random.Random(seed)
    out = ["Titlul cărții", "", "Un titlu, cu virgulă", "1 Era un om."] if seed % 2 else ["Titlul", "Încă un titlu", "1 Era un om, și 2 omul acela avea o casă."]
    verse = 3
    for _ in range(120):
        if rng.random() < 0.1:
            out += rng.choice([[""], ["", " "]]) + [" ".join(rng.choices(WORDS, k=3))]
        if rng.random() < 0.08:
            verse = 1
        text = []
        for _ in range(rng.randint(0, 3)):
            text.append(f"{verse} " + " ".join(["Atunci", *rng.choices(WORDS, k=rng.randint(0, 9)), "apoi."]))
            verse += 1
        out.append(" ".join(text) or "iar rândul merge mai departe.")
    return "\n".join(out) + "\n"


def test_blocks_and_whole_files_agree(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}samuel-reference-text.md").write_text(book(n), encoding="utf-8")
    (tmp_path / "notes-samuel-reference-text.md").write_text("Titlu\n\n1 Nimic.\n", encoding="utf-8")
    rows = lambda df: sorted(tuple(r) for r in df.select("book", "chapter", "verse", "text").collect())
    whole = rows(read_markdown(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows(read_long_markdown(spark, str(tmp_path))) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({c for _, c, _, _ in whole}) > 5
