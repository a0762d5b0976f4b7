"""The engine's operators over the standard tables, each with its DuckDB twin.

A document stands for a passage, its sentences for verses, (lang, source) for (book,
chapter), a good label for quality, an event for a request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioforge.functions import text as X
from folioforge.operators.admission import admit
from folioforge.operators.near_sets import near_pairs
from folioforge.operators.ordering import drawn_places
from folioforge.operators.selection import selection_frame
from folioforge.tables import settled, small

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 12345


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sentences of a document in DuckDB, which has no lookbehind: ends are marked, then split.
_SENTENCES = r"""sentences AS (
    SELECT doc_id, lang, source, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM (
        SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s
        FROM documents WHERE text IS NOT NULL))"""
_BALANCED = """(len({0}) - len(replace({0}, '«', ''))) = (len({0}) - len(replace({0}, '»', ''))) AND
    CASE WHEN contains({0}, '„') THEN len({0}) - len(replace({0}, '„', '')) = 2 * len({0}) - len(replace({0}, '"', '')) - len(replace({0}, '”', ''))
         ELSE (len({0}) - len(replace({0}, '"', ''))) % 2 = 0 END"""
_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def _word_set(column: str) -> str:
    return f"list_distinct({_TOKENS.format(f'lower({column})')})"


# ---------------------------------------------------------------- text


@_query(f"WITH {_SENTENCES} SELECT doc_id, sentence_no::INT AS sentence_no, sentence FROM sentences")
def sentence_explode(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@_query(
    f"""WITH {_SENTENCES} SELECT doc_id, sentence_no::INT AS sentence_no, sentence AS statement FROM sentences
    WHERE length(sentence) BETWEEN 30 AND 165 AND regexp_matches(sentence, '^\\p{{Lu}}') AND {_BALANCED.format("sentence")} AND NOT contains(sentence, '(')
      AND regexp_matches(sentence, '[.!?]["”»]*$') AND NOT regexp_matches(sentence, '\\?\\s*$')
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(sentence), sentence_no) = 1"""
)
def concise_statement(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    best = docs.select("doc_id", X.concise(F.col("text")).alias("b")).where("b is not null")
    return best.select("doc_id", F.col("b.number").alias("sentence_no"), F.col("b.sentence").alias("statement"))


@_query(f"SELECT doc_id, {_BALANCED.format('text')} AS balanced FROM documents")
def quote_balance(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.quotes_balanced(F.col("text")).alias("balanced"))


TERMS = ["the", "and", "of", "la", "de", "der", "und", "que", "Of", "mail7", "License"]


@_query(
    "SELECT term, lang, count(*) AS n_docs FROM documents, (VALUES "
    + ", ".join(f"('{t}')" for t in TERMS)
    + r") t(term) WHERE regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])' || term || '([^\p{L}\p{M}\p{N}_]|$)') GROUP BY term, lang"
)
def whole_word_mention(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    hits = F.array_compact(F.array(*[F.when(X.mentions(F.col("text"), F.lit(t)), F.lit(t)) for t in TERMS]))
    return docs.select("lang", F.explode(hits).alias("term")).groupBy("term", "lang").agg(F.count(F.lit(1)).alias("n_docs"))


@_query(
    rf"""SELECT term, count(*) AS n FROM (
        SELECT text, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT text, {_TOKENS.format("text")} AS w FROM documents))
    WHERE regexp_full_match(term, '\p{{Lu}}\p{{Ll}}+') AND NOT (i = 0 AND starts_with(text, term)) GROUP BY term HAVING count(*) >= 2"""
)
def frequent_proper_terms(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    proper = F.filter(X.words(F.col("text")), lambda w, i: F.regexp_like(w, F.lit(r"^\p{Lu}\p{Ll}+$")) & ~((i == 0) & F.startswith(F.col("text"), w)))
    return docs.select(F.explode(proper).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@_query(
    rf"""SELECT doc_id, target FROM (
        SELECT doc_id, unnest(w) AS target, unnest(range(len(w))) AS i FROM (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents))
    WHERE regexp_full_match(target, '\p{{L}}{{5,}}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(target) DESC, i) = 1"""
)
def longest_word_target(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rows = F.transform(X.words(F.col("text")), lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w")))
    best = F.array_min(F.filter(rows, lambda r: F.regexp_like(r["w"], F.lit(r"^\p{L}{5,}$"))))
    return docs.select("doc_id", best["w"].alias("target")).where("target is not null")


@_query(
    """SELECT doc_id, line_no::INT AS line_no, line FROM (
        SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no, unnest(list_prepend('', l[:-2])) AS before
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE line_no > 0 AND regexp_matches(line, '\\S') AND regexp_matches(before, '\\S')"""
)
def heading_strip(spark, sf_dir):
    lines = F.split(F.col("text"), "\n", -1)
    docs = _read(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    full = lambda x: F.regexp_like(x, F.lit(r"(?U)\S"))
    rows = F.transform("l", lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    kept = F.filter(rows, lambda r: (r["no"] > 0) & full(r["line"]) & full(F.get("l", r["no"] - 1)))
    return docs.select("doc_id", F.explode(kept).alias("r")).select("doc_id", F.col("r.no").alias("line_no"), "r.line")


@_query(
    rf"""WITH w AS (SELECT doc_id, list_transform({_TOKENS.format("text")}, lambda x: [x]) AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], w), lambda kept, v: CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k:
        lower(k) = lower(v[1]) OR (length(k) >= 4 AND starts_with(lower(v[1]), lower(k))) OR (length(v[1]) >= 4 AND starts_with(lower(k), lower(v[1]))))) = 0
        THEN list_concat(kept, v) ELSE kept END), ' ') AS referents FROM w"""
)
def k_distinct_referents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(X.distinct_referents(X.words(F.col("text")), 3), " ").alias("referents"))


@_query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)")
def first_seen_distinct(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    key = F.lower("text")  # two hashes stand for the text in the shuffle
    return docs.groupBy(F.xxhash64(F.lit(1), key).alias("h1"), F.md5(key).alias("h2")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@_query(
    f"""WITH {_SENTENCES}, stated AS (
        SELECT doc_id, sentence FROM sentences
        WHERE length(sentence) BETWEEN 30 AND 165 AND regexp_matches(sentence, '^\\p{{Lu}}') AND {_BALANCED.format("sentence")} AND NOT contains(sentence, '(')
          AND regexp_matches(sentence, '[.!?]["”»]*$') AND NOT regexp_matches(sentence, '\\?\\s*$')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(sentence), sentence_no) = 1),
    hit AS (SELECT *, regexp_extract(sentence, '^(?s)(.*[^\\p{{L}}\\p{{M}}\\p{{N}}_]|)(the|de|la|der|und|of)(?:[^\\p{{L}}\\p{{M}}\\p{{N}}_].*)?$', 1) AS before,
                   regexp_extract(sentence, '^(?s)(?:.*[^\\p{{L}}\\p{{M}}\\p{{N}}_]|)(the|de|la|der|und|of)(?:[^\\p{{L}}\\p{{M}}\\p{{N}}_].*)?$', 1) AS term FROM stated)
    SELECT doc_id, before || 'SWAP' || substr(sentence, length(before) + length(term) + 1) AS statement FROM hit WHERE term <> ''"""
)
def answer_swap(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    stated = docs.select("doc_id", X.concise(F.col("text"))["sentence"].alias("s")).where("s is not null")
    term = r"(?U)(?<!\w)(?:the|de|la|der|und|of)(?!\w)"
    return stated.where(F.regexp_like("s", F.lit(term))).select("doc_id", F.regexp_replace("s", rf"(?s)^(.*){term}(.*)$", "$1SWAP$2").alias("statement"))


# ---------------------------------------------------------------- joins and scope


@_query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def quality_semi_join(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source").join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@_query(
    """SELECT lang, source, max(doc_id) AS last_doc FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND e.lang = d.lang AND e.source = d.source) GROUP BY lang, source"""
)
def missing_scope_anti(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _read(spark, sf_dir, "labels")
    scope = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("lang", "source").distinct()
    return docs.groupBy("lang", "source").agg(F.max("doc_id").alias("last_doc")).join(scope, ["lang", "source"], "left_anti")


@_query(
    """WITH expected AS (SELECT l_orderkey, unnest(range(1, count(*) + 1))::INT AS line FROM lineitem GROUP BY 1),
    found AS (SELECT DISTINCT l_orderkey, l_linenumber AS line FROM lineitem)
    SELECT l_orderkey, line, CASE WHEN f IS NULL THEN 'missing' ELSE 'extra' END AS problem
    FROM (SELECT l_orderkey, line, 1 AS e FROM expected) e FULL JOIN (SELECT l_orderkey, line, 1 AS f FROM found) f USING (l_orderkey, line) WHERE e IS NULL OR f IS NULL"""
)
def manifest_check(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"))
    # one shuffle by order serves the count and the lines that were found
    found = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_set("line").alias("found"))
    expected = F.sequence(F.lit(1), F.col("n"))
    problem = lambda lines, name: F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(name).alias("problem")))
    wrong = F.concat(problem(F.array_except(expected, "found"), "missing"), problem(F.array_except("found", expected), "extra"))
    return found.select("l_orderkey", F.inline(wrong))


@_query(
    """SELECT a.conv_id, a.turn AS turn_start, a.turn + 1 AS turn_end, string_agg(b.text, ' ' ORDER BY b.turn) AS passage
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 1 WHERE a.role = 'user' GROUP BY ALL"""
)
def turn_interval_concat(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations")
    want = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("turn_start"), (F.col("turn") + 1).alias("turn_end"))
    spans = want.withColumn("turn", F.explode(F.sequence("turn_start", "turn_end")))
    rows = spans.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]).groupBy("conv_id", "turn_start", "turn_end")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("passage"))


_NAMES_OF_BOOKS = {"1 Samuel": "1 Samuel", "2sam": "2 Samuel", "Rut": "Rut", "ioan": "Ioan", "1 SAM": "1 Samuel", "2 samuel": "2 Samuel"}


@_query(
    f"""WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents),
    r AS (
        SELECT doc_id, {list(_NAMES_OF_BOOKS.values())}[(doc_id % 6 + 1)::INT] AS book, unnest(range(n % 40 + 1, n % 40 + doc_id % 4 + 2)) AS chapter FROM d
        UNION SELECT doc_id, {list(_NAMES_OF_BOOKS.values())}[(doc_id % 6 + 1)::INT], n % 7 + 1 FROM d
        UNION SELECT doc_id, 'Rut', n % 3 + 1 FROM d WHERE doc_id % 3 = 0)
    SELECT doc_id AS id, book, chapter::INT AS chapter FROM r"""
)
def selection_expand(spark, sf_dir):
    """Selections as users write them, one for each document and made of its id and length, as chapters."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    name = F.get(F.lit(list(_NAMES_OF_BOOKS)), (F.col("doc_id") % 6).cast("int"))
    first, last = F.col("n") % 40 + 1, F.col("n") % 40 + 1 + F.col("doc_id") % 4
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(";rut "), F.col("n") % 3 + 1)).otherwise("")
    return selection_frame(docs.select(F.col("doc_id").alias("id"), F.concat(name, F.lit(" "), first, F.lit(" - "), last, F.lit(", "), F.col("n") % 7 + 1, more).alias("selection")))


# ---------------------------------------------------------------- windows and orders


@_query(
    f"""SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('{SEED}|1|' || doc_id), doc_id)::INT AS round,
    md5('{SEED}|1|' || lang || '|' || source) AS slot FROM documents"""
)
def round_robin(spark, sf_dir):
    """Sorted by round, then slot, this deals documents out one from each (lang, source) in turn."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    placed = drawn_places(docs, ["lang", "source"], X.hash_order(str(SEED), "1", F.col("doc_id")), "doc_id", "round")
    return placed.select("doc_id", "lang", "source", "round", X.hash_order(str(SEED), "1", F.col("lang"), F.col("source")).alias("slot"))


@_query(f"SELECT doc_id, ['A', 'B', 'C'][(row_number() OVER (PARTITION BY lang, source ORDER BY md5('{SEED}|letters|' || doc_id), doc_id) % 3 + 1)::INT] AS letter FROM documents")
def balanced_letters(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    placed = drawn_places(docs, ["lang", "source"], X.hash_order(str(SEED), "letters", F.col("doc_id")), "doc_id")
    return placed.select("doc_id", F.element_at(F.array(*map(F.lit, "ABC")), F.col("place") % 3 + 1).alias("letter"))


@_query(
    """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS island FROM d),
    r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, island)
    SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS label FROM r GROUP BY l_orderkey"""
)
def range_collapse(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("n"))
    return lines.select("l_orderkey", X.range_label(F.col("n")).alias("label"))


@_query(
    """SELECT conv_id, turn, (1 + sum(CASE WHEN role = 'user' AND before IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section
    FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""
)
def running_section_number(spark, sf_dir):
    order = W.partitionBy("conv_id").orderBy("turn")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    opens = F.when((F.col("role") == "user") & F.lag("role").over(order).isNotNull(), 1).otherwise(0)
    return turns.withColumn("o", opens).select("conv_id", "turn", (1 + F.sum("o").over(order)).alias("section"))


@_query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 3")
def keep_recent(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("rn", F.row_number().over(order))
    return rows.where("rn > 3").select("event_id", "user_id")


@_query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (
        SELECT event_id, user_id, rn, true AS admitted, [t] AS kept FROM e WHERE rn = 1
        UNION ALL
        SELECT e.event_id, e.user_id, e.rn, len(list_filter(kept, lambda k: k >= e.t - 86400000000)) < 5,
               CASE WHEN len(list_filter(kept, lambda k: k >= e.t - 86400000000)) < 5 THEN list_append(kept, e.t) ELSE kept END
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, user_id, admitted FROM r"""
)
def admission_limit(spark, sf_dir):
    return admit(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", limit=5, seconds=86_400)


# ---------------------------------------------------------------- distractors

_PART_GROUPS = """first_seen AS (SELECT p_brand, p_type, min(p_partkey) AS pos FROM part GROUP BY ALL)"""


def _by_brand(parts: DataFrame) -> DataFrame:
    """(p_brand, seen): the types of each brand in order of their first part; types are a dimension."""
    first = parts.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos"))
    return first.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("pos", "p_type"))).alias("seen"))


@_query(
    f"""WITH {_PART_GROUPS}, top AS (SELECT * FROM first_seen QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pos) <= 3),
    other AS (SELECT p.p_partkey, t.p_type AS o, t.pos FROM part p JOIN top t ON p.p_brand = t.p_brand AND p.p_type <> t.p_type QUALIFY row_number() OVER (PARTITION BY p.p_partkey ORDER BY t.pos) <= 2)
    SELECT p.p_partkey, p.p_type || coalesce('|' || string_agg(o, '|' ORDER BY pos), '') AS options FROM part p LEFT JOIN other USING (p_partkey) GROUP BY p.p_partkey, p.p_type"""
)
def option_seed(spark, sf_dir):
    """Own value, then the first two others of its group: the three first-seen of a group are enough."""
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    top = _by_brand(parts).select("p_brand", F.transform(F.slice("seen", 1, 3), lambda s: s["p_type"]).alias("top"))
    others = F.slice(F.filter("top", lambda t: t != F.col("p_type")), 1, 2)
    return parts.join(top, "p_brand").select("p_partkey", F.array_join(F.concat(F.array("p_type"), others), "|").alias("options"))


@_query(
    f"""WITH {_PART_GROUPS}, d AS (
        SELECT a.p_brand, a.p_type, b.p_type AS o, b.pos FROM first_seen a JOIN first_seen b USING (p_brand)
        WHERE split_part(a.p_type, ' ', 1) <> split_part(b.p_type, ' ', 1) AND split_part(a.p_type, ' ', -1) <> split_part(b.p_type, ' ', -1)
        QUALIFY row_number() OVER (PARTITION BY a.p_brand, a.p_type ORDER BY b.pos) <= 2)
    SELECT p_brand, p_type, string_agg(o, '|' ORDER BY pos) AS distractors FROM d GROUP BY ALL"""
)
def distractor_theta(spark, sf_dir):
    seen = _by_brand(_read(spark, sf_dir, "part"))
    end = lambda v, i: F.element_at(F.split(v, " "), i)
    each = seen.select("p_brand", "seen", F.explode("seen").alias("own")).select("p_brand", "seen", F.col("own.p_type").alias("p_type"))
    fit = F.filter("seen", lambda s: (end(s["p_type"], 1) != end(F.col("p_type"), 1)) & (end(s["p_type"], -1) != end(F.col("p_type"), -1)))
    out = each.select("p_brand", "p_type", F.array_join(F.transform(F.slice(fit, 1, 2), lambda s: s["p_type"]), "|").alias("distractors"))
    return out.where("distractors <> ''")


@_query(
    f"""WITH {_PART_GROUPS}, n AS (SELECT *, len(string_split(p_type, ' ')) + length(p_type) // 8 AS w FROM first_seen), d AS (
        SELECT a.p_brand, a.p_type, b.p_type AS o, abs(a.w - b.w) AS gap, b.pos FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type <> b.p_type
        QUALIFY row_number() OVER (PARTITION BY a.p_brand, a.p_type ORDER BY abs(a.w - b.w), b.pos) <= 3)
    SELECT p_brand, p_type, string_agg(o, '|' ORDER BY gap, pos) AS closest FROM d GROUP BY ALL"""
)
def word_count_closeness(spark, sf_dir):
    size = lambda v: F.size(F.split(v, " ")) + F.floor(F.char_length(v) / 8)
    seen = _by_brand(_read(spark, sf_dir, "part"))
    each = seen.select("p_brand", "seen", F.explode("seen").alias("own")).select("p_brand", "seen", F.col("own.p_type").alias("p_type"))
    others = F.filter("seen", lambda s: s["p_type"] != F.col("p_type"))
    ranked = F.array_sort(F.transform(others, lambda s: F.struct(F.abs(size(s["p_type"]) - size(F.col("p_type"))).alias("gap"), s["pos"].alias("pos"), s["p_type"].alias("t"))))
    out = each.select("p_brand", "p_type", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["t"]), "|").alias("closest"))
    return out.where("closest <> ''")


@_query(
    """WITH t AS (
        SELECT a.c_custkey, b.c_custkey AS replacement, CASE WHEN a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey THEN 1 WHEN a.c_mktsegment = b.c_mktsegment THEN 2 WHEN a.c_nationkey = b.c_nationkey THEN 3 ELSE 4 END AS tier
        FROM customer a JOIN (
            SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) <= 2) b ON a.c_custkey <> b.c_custkey)
    SELECT c_custkey, replacement, tier::INT AS tier FROM t QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY tier, replacement) = 1"""
)
def tiered_replacement(spark, sf_dir):
    """The first other customer of the best tier: the two first of each tier's group are enough."""
    people = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")

    def firsts(by: list[str], name: str) -> DataFrame:
        rank = W.partitionBy(*by).orderBy("c_custkey")
        few = people.withColumn("r", F.row_number().over(rank)).where("r <= 2")
        return few.groupBy(*by).agg(F.array_sort(F.collect_list("c_custkey")).alias(name))

    first = lambda name: F.get(F.filter(name, lambda k: k != F.col("c_custkey")), F.lit(0))
    out = people.join(firsts(["c_mktsegment", "c_nationkey"], "both"), ["c_mktsegment", "c_nationkey"], "left")
    out = out.join(F.broadcast(firsts(["c_mktsegment"], "segment")), "c_mktsegment", "left")  # a row a segment
    out = out.join(F.broadcast(firsts(["c_nationkey"], "nation")), "c_nationkey", "left")  # a row a nation
    lowest = people.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k")).agg(F.array_sort(F.collect_list("k")).alias("all"))
    out = out.join(F.broadcast(lowest)).withColumn("any", first("all"))  # one row
    found = [first("both"), first("segment"), first("nation"), F.col("any")]
    tier = F.lit(None).cast("int")
    for i in range(3, -1, -1):
        tier = F.when(found[i].isNotNull(), i + 1).otherwise(tier)
    return out.select("c_custkey", F.coalesce(*found).alias("replacement"), tier.alias("tier")).where("replacement is not null")


# ---------------------------------------------------------------- likeness


def _prefix_words(sets: DataFrame, key: str, least: Callable) -> DataFrame:
    """(key, n, w, word): each set with the rarest words that any partner must share one of."""
    each = sets.select(key, F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(df, "word").withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("df", "word")))
    return sets.join(ranked, key).where(F.col("r") <= F.size("w") - least(F.size("w")) + 1).select(key, "w", "word")


@_query(
    f"""WITH s AS (SELECT doc_id, {_word_set("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.word = b.word AND a.doc_id < b.doc_id AND b.n * 10 >= 7 * a.n AND a.n * 10 >= 7 * b.n GROUP BY ALL)
    SELECT a, b, c AS common FROM p WHERE 10 * c >= 7 * greatest(n, m)"""
)
def near_duplicate_pairs(spark, sf_dir):
    """Pairs whose word sets share 0.7 of the larger one."""
    docs = _read(spark, sf_dir, "documents").where("text is not null and doc_id is not null")
    return near_pairs(docs.select(F.col("doc_id").cast("long").alias("key"), F.transform(X.word_set(F.col("text")), lambda w: F.xxhash64(w)).alias("members")).where("size(members) > 0"))


@_query(
    f"""WITH {_SENTENCES}, q AS (SELECT item_id, {_word_set("text")} AS w FROM benchmark), e AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM q),
    r AS (SELECT doc_id, sentence_no, unnest({_word_set("sentence")}) AS word FROM sentences),
    c AS (SELECT item_id, n, doc_id, sentence_no, count(*) AS c FROM e JOIN r USING (word) GROUP BY ALL)
    SELECT item_id, item_id IN (SELECT item_id FROM c WHERE 10 * c >= 7 * n) AS ambiguous FROM q"""
)
def containment_ambiguity(spark, sf_dir):
    """Whether some sentence holds 0.7 of an item's words. Items are a dimension: each sentence
    meets only those that one of its words is a rare word of."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", X.word_set(F.col("text")).alias("w"))
    prefix = small(settled(_prefix_words(items, "item_id", lambda n: F.ceil(n * 7 / 10)), "prefix-words"))
    docs = _read(spark, sf_dir, "documents")
    told = docs.select(F.explode(X.sentences(F.col("text"))).alias("s")).select(X.word_set(F.col("s")).alias("r"))
    met = told.select("r", F.explode("r").alias("word")).join(prefix, "word")
    hit = met.where(10 * F.size(F.array_intersect("w", "r")) >= 7 * F.size("w")).select("item_id").distinct().withColumn("hit", F.lit(True))
    return items.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("ambiguous"))


@_query(
    rf"""WITH {_SENTENCES}, g AS (
        SELECT doc_id, count(*) AS n, list([list_filter({_word_set("sentence")}, lambda x: NOT regexp_full_match(x, '_+'))] ORDER BY sentence_no) AS w FROM sentences GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(len(list_reduce(list_prepend([]::VARCHAR[][], w), lambda kept, v: CASE WHEN len(v[1]) > 0 AND len(list_filter(kept, lambda k:
        10 * len(list_intersect(k, v[1])) >= 7 * greatest(len(k), len(v[1])))) = 0 THEN list_concat(kept, v) ELSE kept END)), 0)::BIGINT AS n_claimed
    FROM documents LEFT JOIN g USING (doc_id)"""
)
def greedy_ledger(spark, sf_dir):
    """How many of a document's sentences a running ledger of stems takes."""
    told = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.sentences(F.col("text")), F.array().cast("array<string>")).alias("s"))
    return told.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(X.ledger(F.col("s"))).cast("long").alias("n_claimed"))


# ---------------------------------------------------------------- counts and checks


@_query("SELECT lang || ' ' || source AS passage, count(*) AS n FROM documents GROUP BY 1")
def coverage(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", "lang", "source").alias("passage"), "n")


@_query("SELECT user_id, max(n) AS most, max(n) > 4 AS over_cap FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def histogram_cap(spark, sf_dir):
    n = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.max("n").alias("most")).select("user_id", "most", (F.col("most") > 4).alias("over_cap"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_query(
    """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, count(*) = count(DISTINCT o_orderpriority) AND count(*) = 5 AS bijection
    FROM orders GROUP BY o_custkey"""
)
def bijection_check(spark, sf_dir):
    g = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("priorities"))
    return g.select("*", ((F.col("n") == F.col("priorities")) & (F.col("n") == 5)).alias("bijection"))


# ---------------------------------------------------------------- whole papers

_NAMES = ["Samuel", "David", "Saul", "Ionatan", "Abner", "Ioab", "Natan", "Absalom", "Ana", "Penina", "Eli", "Goliat", "Isai", "Domnul"]
_DEEDS = ["a adus grâu din câmpul cel mare", "a zidit o casă lângă poarta cetății", "a chemat poporul la munte", "a trimis daruri scumpe preoților", "a păzit turma toată noaptea", "a citit legea înaintea adunării", "a trecut râul spre dimineață", "a găsit o fântână veche", "a cumpărat un ogor roditor", "a deschis porțile templului", "a plantat măslini pe deal"]
_ENDS = ["cu mare bucurie", "fără nicio teamă", "în luna a treia", "după multe zile", "la porunca regelui", "spre seară târziu", "cu toată casa sa"]


def _customer_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verses made of customers: a nation is a book, a market segment a chapter."""
    people, nations = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    name, deed, end = pick(_NAMES, key), pick(_DEEDS, key * 7 + F.floor(key / 14)), pick(_ENDS, key * 3 + F.floor(key / 19))
    told = F.when(key % 3 == 0, F.concat(F.lit("În anul acela bogat "), name, F.lit(" "), deed, F.lit(" "), end, F.lit(", iar bătrânii cetății au lăudat fapta bună.")))
    told = told.otherwise(F.concat(F.lit("Regele "), name, F.lit(" "), deed, F.lit(" "), end, F.lit(". Toți oamenii locului au cinstit fapta lui "), pick(_NAMES, key * 5 + 3), F.lit(".")))
    held = people.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    chapters = held.select("n_name", "c_mktsegment").distinct().select(F.col("n_name").alias("book"), F.col("c_mktsegment").alias("segment"), F.dense_rank().over(W.partitionBy("n_name").orderBy("c_mktsegment")).alias("chapter"))
    placed = held.join(F.broadcast(chapters), (F.col("n_name") == F.col("book")) & F.col("c_mktsegment").eqNullSafe(F.col("segment")))  # a row a nation and segment
    return placed.select("book", "chapter", key.cast("int").alias("verse"), told.alias("text"))


def _customer_papers(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    from folioforge.operators.candidates import with_candidates
    from folioforge.operators.facts import facts_of
    from folioforge.plans.paper import papers

    verses = keep(_customer_verses(spark, sf_dir), "verses")
    facts = keep(facts_of(verses), "facts")
    selections = keep(verses.select(F.col("book").alias("paper_id"), "book", "chapter").distinct(), "selections")
    return papers(with_candidates(facts), selections, SEED, 1, 2), selections, facts, verses


@_query()
def paper_allocate(spark, sf_dir):
    """Two versions of a paper for each nation."""
    return _customer_papers(spark, sf_dir)[0].drop("options")


@_query()
def paper_violations(spark, sf_dir):
    """What the checks find in those papers: no row."""
    from folioforge.plans.validate import evidence, structural

    items, selections, facts, verses = _customer_papers(spark, sf_dir, settled)  # else the rules' plan repeats those plans, and takes the driver's memory
    items = settled(items, "papers")  # each rule reads them
    return structural(items, selections, facts).unionByName(evidence(items, facts, verses, selections))


@_query()
def paper_coverage(spark, sf_dir):
    from folioforge.plans.validate import coverage as cited

    items, _, facts, _ = _customer_papers(spark, sf_dir)
    facts = facts.cache()  # read for the papers, and again for what they cite
    return cited(settled(items, "papers"), facts)
