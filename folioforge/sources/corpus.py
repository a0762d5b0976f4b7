"""Corpora: Markdown or JSON files to verses and facts, checked against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioforge.functions import text as X
from folioforge.tables import settled

MARKDOWN_GLOB = "*samuel-reference-text.md"
#: A verse begins with its number, before a letter or a mark that opens speech.
MARKER = r'(?U)(?<![\w-])(\d{1,3})\s+(?=[A-Za-zĂÂÎȘȚăâîșț„"«])'
EVIDENCE = "struct<book:string,chapter:int,verse_start:int,verse_end:int,text:string>"
FACT = f"struct<id:string,statement:string,subject:string,predicate:string,object:string,evidence:{EVIDENCE},options:array<string>,quality:boolean>"
BOOKS = "map<string,map<string,map<string,string>>>"
DEFAULT_TRANSLATION = "Nespecificată"


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def without_headings(lines: Column) -> Column:
    """A heading is the first line of a paragraph: a line stays if it and the one before have text."""
    full = lambda x: F.regexp_like(x, F.lit(r"(?U)\S"))
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    return F.transform(F.filter(rows, lambda r: (r["i"] > 0) & full(r["line"]) & full(F.get(lines, r["i"] - 1))), lambda r: r["line"])


def read_markdown(spark: SparkSession, path: str, glob: str = MARKDOWN_GLOB) -> DataFrame:
    """verses(book, chapter, verse, text, pos) of all files that match.

    The first line is a title. Files without a book in their name are skipped; a file
    without verses, or none at all, is an error. Chapters are counted by verses 1.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.regexp_extract(F.lower("_metadata.file_name"), r"^([12])samuel-reference-text\.md$", 1).alias("n"), F.split("value", "\r?\n").alias("lines")).where("n <> ''")
    body = F.array_join(without_headings(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))), "\n")
    raw = files.select(F.concat("n", F.lit(" Samuel")).alias("book"), body.alias("raw"))
    numbers = F.regexp_extract_all("raw", F.lit(MARKER), F.lit(1))
    checked = F.when(F.size(numbers) == 0, F.raise_error(F.concat(F.lit("Nu am putut identifica versete în: "), "book")).cast("array<string>")).otherwise(numbers)
    marks = raw.select("book", F.posexplode(F.arrays_zip(checked.alias("verse"), F.slice(F.split("raw", MARKER, -1), F.lit(2), F.size(numbers)).alias("text"))).alias("pos", "m"))
    marks = marks.select("book", "pos", F.col("m.verse").cast("int").alias("verse"), X.squeeze(F.col("m.text")).alias("text"))
    order = W.partitionBy("book").orderBy("pos")
    begun = F.max((F.col("text") != "").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)) == 1
    opened = marks.withColumn("opens", F.when((F.col("verse") == 1) & begun, 1).otherwise(0))
    counted = opened.withColumn("chapter", (1 + F.sum("opens").over(order)).cast("int"))
    return counted.where("text <> ''").select("book", "chapter", "verse", "text", "pos")


def read_long_markdown(spark: SparkSession, path: str, glob: str = MARKDOWN_GLOB) -> DataFrame:
    """verses(book, chapter, verse, text) as ``read_markdown`` gives them, of files of any length.

    Files are read in blocks of lines, and what a line needs to know of those before it (the
    last blank one, the verse it goes on with, the chapters opened so far) comes from scans
    over the blocks. A number that ends a line begins no verse here. Files without a verse
    give none.
    """
    from folioforge.operators.segments import running

    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        F.regexp_extract(F.lower("_metadata.file_name"), r"^([12])samuel-reference-text\.md$", 1).alias("book"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    lines = settled(lines.where("book <> ''"), "lines")
    full = F.regexp_like("value", F.lit(r"(?U)\S"))
    titles = lines.groupBy("book").agg(F.min(F.struct("block", "row")).alias("title"))  # a row a file
    title = F.struct("block", "row") == F.col("title")
    placed = running(lines.join(F.broadcast(titles), "book").withColumn("gap", ~full | title), ["book", "block", "row"], F.col("gap"), F.lit(0))
    body = placed.where(full & (F.col("since") > 1))  # a heading is the first line after a gap
    texts, numbers = F.split("value", MARKER, -1), F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("value", F.lit(MARKER), F.lit(1)))
    parts = body.select("book", "number", F.posexplode(F.arrays_zip(numbers.alias("verse"), texts.alias("text"))).alias("part", "p"))
    parts = parts.select("book", F.col("number").alias("line"), "part", F.col("p.verse").cast("int").alias("verse"), F.col("p.text").alias("text"))
    told = running(parts, ["book", "line", "part"], F.col("verse").isNotNull(), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "text"))), lambda t: t["text"]), "\n")  # one verse's
    verses = told.groupBy("book", F.col("marks").alias("at")).agg(F.max("verse").alias("verse"), X.squeeze(joined).alias("text")).where("verse is not null")
    verses = settled(verses, "verses")
    begins = verses.where("text <> ''").groupBy("book").agg(F.min("at").alias("begin"))
    opened = verses.join(F.broadcast(begins), "book").withColumn("opens", (F.col("verse") == 1) & (F.col("at") > F.col("begin")))
    counted = settled(running(opened, ["book", "at"], F.col("opens"), F.lit(0)), "chapters")
    starts = counted.groupBy("book").agg(F.min(F.col("marks") - F.col("opens").cast("long")).alias("start"))
    chapter = (1 + F.col("marks") - F.col("start")).cast("int")
    return counted.join(F.broadcast(starts), "book").where("text <> ''").select(F.concat("book", F.lit(" Samuel")).alias("book"), chapter.alias("chapter"), "verse", "text")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(verses, facts, translation) of a JSON corpus; without ``books`` the document itself is the books."""
    doc = spark.read.text(path, wholetext=True)
    typed = F.from_json("value", f"translation string, books {BOOKS}, facts array<{FACT}>", {"mode": "FAILFAST"})
    has_books = F.get_json_object("value", "$.books").isNotNull()
    known = doc.select(F.when(has_books, typed).alias("d"), F.when(~has_books, F.from_json("value", BOOKS)).alias("bare"))
    books = known.select(F.explode(F.coalesce("d.books", "bare")).alias("book", "chapters"))
    verses = books.select("book", F.explode("chapters").alias("chapter", "verses")).select("book", F.col("chapter").cast("int").alias("chapter"), F.explode("verses").alias("verse", "text"))
    verses = verses.select("book", "chapter", F.col("verse").cast("int").alias("verse"), "text")
    facts = known.select(F.posexplode("d.facts").alias("pos", "f")).select("pos", "f.*")
    facts = facts.withColumns(
        {
            "options": F.coalesce("options", F.array().cast("array<string>")),
            "quality": F.coalesce("quality", F.lit(True)),
            "evidence": F.col("evidence").withField("verse_end", F.coalesce("evidence.verse_end", "evidence.verse_start")),
        }
    )
    first = doc.select(F.get_json_object("value", "$.translation").alias("t")).first()
    return verses, facts, (first and first["t"]) or DEFAULT_TRANSLATION


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest(book, chapter, expected); the place in the list is the chapter."""
    doc = spark.read.text(path, wholetext=True)
    counts = doc.select(F.explode(F.from_json("value", "chapters map<string,array<int>>")["chapters"]).alias("book", "n"))
    return counts.select("book", F.posexplode("n").alias("at", "expected")).select("book", (F.col("at") + 1).alias("chapter"), "expected")


def manifest_problems(verses: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book, chapter, problem, verse) where the parse and the manifest differ, for books that were parsed."""
    books = verses.select("book").distinct()
    expected = manifest.join(F.broadcast(books), "book", "left_semi")
    want = expected.where("expected > 0").select("book", "chapter", F.explode(F.sequence(F.lit(1), "expected")).alias("verse"), F.lit(1).alias("e"))
    found = verses.select("book", "chapter", "verse", F.lit(1).alias("f")).distinct()
    listed = expected.groupBy("book").agg(F.max("chapter").alias("last"))
    both = want.join(found, ["book", "chapter", "verse"], "full_outer").where("e is null or f is null").join(F.broadcast(listed), "book")
    problem = F.when(F.col("chapter") > F.col("last"), "chapter").when(F.col("f").isNull(), "missing").otherwise("extra")
    return both.select("book", "chapter", problem.alias("problem"), "verse")


def verify(verses: DataFrame, manifest: DataFrame) -> DataFrame:
    """``verses``, if the manifest agrees; else ValueError with every problem."""
    names = {"missing": "lipsesc versetele", "extra": "versete în plus", "chapter": "capitol neașteptat, versetele"}
    bad = manifest_problems(verses, manifest).groupBy("book", "chapter", "problem").agg(F.array_sort(F.collect_list("verse")).alias("v")).orderBy("book", "chapter").collect()
    if bad:
        raise ValueError("Corpusul nu corespunde manifestului:\n" + "\n".join(f"  {r['book']} {r['chapter']}: {names[r['problem']]} {list(r['v'])}" for r in bad))
    return verses


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(verses, facts, translation) of a directory of Markdown, one Markdown file, or JSON."""
    from folioforge.operators.facts import facts_of

    if not path_exists(spark, path):
        raise FileNotFoundError(f"Lipsește corpusul local: {path}")
    if path.lower().endswith(".json"):
        return read_json(spark, path)
    verses = read_markdown(spark, path)
    if verses.isEmpty():
        raise FileNotFoundError(f"Nu există corpusuri Markdown în: {path}")
    folder = path.rsplit("/", 1)[0] if path.lower().endswith(".md") else path
    if path_exists(spark, manifest := f"{folder}/verse-counts.json"):
        verses = verify(verses, read_manifest(spark, manifest))
    return verses, facts_of(verses), "Corpus local"


def passage(verses: DataFrame, selection: DataFrame) -> DataFrame:
    return verses.join(F.broadcast(selection), ["book", "chapter"], "left_semi")


def chapter(verses: DataFrame, book: str, number: int) -> DataFrame:
    return verses.where((F.col("book") == book) & (F.col("chapter") == number))


def verse(verses: DataFrame, book: str, number: int, at: int) -> DataFrame:
    return chapter(verses, book, number).where(F.col("verse") == at)
