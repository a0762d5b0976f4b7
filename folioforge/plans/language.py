"""Readings that lean on word classes, over the documents, each beside its DuckDB twin.

The documents' prose is invented, so its function words stand for the classes. The twins
look at pairs of words by their places; they know no automaton.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.functions import readings as G
from folioforge.functions import text as X
from folioforge.plans.catalogue import _SENTENCES, _TOKENS, _query, _read

WORDS = G.Lexicon(
    free_clitics=("on", "por"), object_clitics=(("mail", ("me",)), ("non", ("commercial",))), verbal_clitic="la", patient_marker="of", dative_article="der", dative=r"\w{3,}(?:ent|ung|ion)", articled="er|en|os",
    auxiliaries=("is", "ist", "est"), verb_endings=("ed", "ing", "ar", "er"), before_noun=("the", "un", "el"), after_noun=("und", "que"), no_noun=("of", "de", "la", "die", "by"), names=("License",),
    edges=("the", "of", "and", "de", "la", "und", "der"), oblique=("by", "de", "der"),
)
LISTS = {"short": r"\p{L}{4,5}", "long": r"\p{L}{6,9}"}
LAST = r"\s+(?:and|und|et|y)\s+"
JOIN = rf"(?:\s*,\s*|{LAST})"
HANGING, SUBORDINATE = ("the", "of", "and", "de", "la", "und", "der"), ("que", "with")


def _once(docs, reading):
    """(doc_id, found) where a reading finds something; a filter on a plain column would read each text twice."""
    return docs.select("doc_id", F.explode(F.array(reading)).alias("found")).where("found is not null")


def _held(text):
    """(open, points) of each sentence; the whole text's named nouns are worked out once."""
    one = lambda s, named: X.let(G.tokens(s), lambda t: F.struct(G.patient_missing(t, WORDS).alias("open"), G.points_outside(t, named, WORDS).alias("points")))
    return X.let(G.named_nouns(G.tokens(text), WORDS), lambda named: F.transform(X.sentences(text), lambda s: one(s, named)))


# ---------------------------------------------------------------- the twins' parts


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _gaps(column: str) -> str:
    return rf"regexp_extract_all({column}, '([^\p{{L}}\p{{M}}\p{{N}}_]*)[\p{{L}}\p{{M}}\p{{N}}_]+', 1)"


_AUX = f"(regexp_matches(lw, '({'|'.join(WORDS.verb_endings)})$') OR lw IN {_in(WORDS.auxiliaries)})"
#: Words by place: those before it and the gap; all rules look at these.
_PLACES = rf"""placed AS (
    SELECT *, lower(word) AS lw, lag(word) OVER p AS pw, lower(lag(word) OVER p) AS plw, lead(word) OVER p AS nw, lead(gap) OVER p AS ngap, lead(lower(word)) OVER p AS nlw FROM (
        SELECT doc_id, sentence_no, unnest(w) AS word, unnest(g) AS gap, unnest(range(len(w))) AS i FROM (
            SELECT doc_id, sentence_no, {_TOKENS.format("sentence")} AS w, {_gaps("sentence")} AS g FROM sentences))
    WINDOW p AS (PARTITION BY doc_id, sentence_no ORDER BY i))"""
_BLANK, _NEXT_BLANK = r"regexp_full_match(gap, '\s*')", r"regexp_full_match(ngap, '\s*')"
_BOUND = " OR ".join(f"(gap = '-' AND plw = '{host}' AND lw IN {_in(bound)})" for host, bound in WORDS.object_clitics)
_READ = rf"""clitics AS (
    SELECT doc_id, sentence_no, bool_or(coalesce({_BOUND} OR lw IN {_in(WORDS.free_clitics)} OR (plw = '{WORDS.verbal_clitic}' AND {_BLANK} AND {_AUX}), false)) AS clitic,
           bool_or(coalesce((lw = '{WORDS.patient_marker}' AND {_NEXT_BLANK}) OR (
               (regexp_full_match(lw, '[\p{{L}}\p{{M}}\p{{N}}_]{{3,}}(ent|ung|ion)') OR (lw = '{WORDS.dative_article}' AND {_NEXT_BLANK})) AND (plw IS NULL OR NOT regexp_matches(plw, '({WORDS.articled})$'))), false)) AS object
    FROM placed GROUP BY ALL),
pointed AS (
    SELECT doc_id, sentence_no, word FROM placed WHERE {_BLANK} AND plw IN {_in(WORDS.before_noun)}
    UNION SELECT doc_id, sentence_no, word FROM placed WHERE {_NEXT_BLANK} AND nlw IN {_in(WORDS.after_noun)}),
whole AS (
    SELECT *, lead(word, 1) OVER p AS w1, lead(gap, 1) OVER p AS g1, lead(word, 2) OVER p AS w2, lead(gap, 2) OVER p AS g2 FROM (
        SELECT doc_id, lower(word) AS lw, unnest(w) AS word, unnest(g) AS gap, unnest(range(len(w))) AS i FROM (SELECT doc_id, '' AS word, {_TOKENS.format("text")} AS w, {_gaps("text")} AS g FROM documents))
    WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
named AS (
    SELECT DISTINCT doc_id, lower(word) AS noun FROM whole WHERE regexp_full_match(g1, '\s*')
      AND regexp_matches(CASE WHEN lower(w1) = '{WORDS.dative_article}' AND regexp_full_match(coalesce(g2, 'x'), '\s*') THEN w2 ELSE w1 END, '^\p{{Lu}}')),
outside AS (
    SELECT DISTINCT doc_id, sentence_no FROM pointed p WHERE lower(word) NOT IN {_in(WORDS.no_noun)} AND word NOT IN {_in(WORDS.names)} AND upper(left(word, 1)) || lower(substr(word, 2)) NOT IN {_in(WORDS.names)}
      AND NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = p.doc_id AND n.noun = lower(p.word)))"""


@_query(
    f"""WITH {_SENTENCES}, {_PLACES}, {_READ}
    SELECT doc_id, count(sentence_no) AS n_sentences, count(*) FILTER (WHERE clitic AND NOT object) AS n_patient_missing, count(o.doc_id) AS n_points_outside,
           count(*) FILTER (WHERE sentence_no IS NOT NULL AND NOT coalesce(clitic AND NOT object, false) AND o.doc_id IS NULL) AS n_standing
    FROM documents LEFT JOIN sentences s USING (doc_id) LEFT JOIN clitics c USING (doc_id, sentence_no) LEFT JOIN outside o USING (doc_id, sentence_no) GROUP BY doc_id"""
)
def sentences_standing_alone(spark, sf_dir):
    """How many sentences of each document have a clitic without its object, a demonstrative whose noun nothing names, and neither."""
    docs = _read(spark, sf_dir, "documents")
    read = docs.select("doc_id", _held(F.col("text")).alias("r"))
    read = read.select("doc_id", F.coalesce("r", F.array().cast("array<struct<open:boolean,points:boolean>>")).alias("r"))
    count = lambda test: F.size(F.filter("r", test)).cast("long")
    return read.select(
        "doc_id", F.size("r").cast("long").alias("n_sentences"), count(lambda x: x["open"]).alias("n_patient_missing"), count(lambda x: x["points"]).alias("n_points_outside"),
        count(lambda x: ~x["open"] & ~x["points"]).alias("n_standing"),
    )


@_query(
    rf"""WITH {_SENTENCES}, names AS (
        SELECT doc_id, name FROM (SELECT doc_id, unnest(w) AS name, unnest(range(len(w))) AS i FROM (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents))
        WHERE regexp_full_match(name, '\p{{L}}{{5,}}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, i) = 1),
    cut AS (SELECT doc_id, sentence_no, sentence, name, {_TOKENS.format("sentence")} AS w, {_gaps("sentence")} AS g, list_position({_TOKENS.format("sentence")}, name) AS pos FROM sentences JOIN names USING (doc_id)),
    tails AS (
        SELECT doc_id, sentence_no, name, CASE WHEN pos > 1 THEN lower(w[pos - 1]) ELSE '' END AS before,
               substr(sentence, (list_sum(list_transform(w[:pos], lambda x: length(x))) + list_sum(list_transform(g[:pos], lambda x: length(x))))::BIGINT + 1) AS tail FROM cut WHERE pos > 0),
    clauses AS (
        SELECT *, trim(regexp_extract(tail, '^[^,;:.!?]*'), ' ,;:-–—„”"''!?.') AS clause, regexp_matches(tail, '^[^,;:.!?]*:\s*[„«"]') AS speech, regexp_matches(tail, '^[^,;:.!?]*:\s*(„[^"”]*["”]|«[^»]*»|"[^"]*")') AS reported FROM tails),
    read AS (SELECT *, {_TOKENS.format("clause")} AS w, list_filter(regexp_split_to_array(clause, '\s+'), lambda x: x <> '') AS s FROM clauses)
    SELECT doc_id, name, clause FROM read WHERE before NOT IN {_in(WORDS.oblique)} AND NOT speech AND NOT reported AND length(clause) >= 10 AND len(s) BETWEEN 2 AND 14
      AND lower(s[1]) NOT IN {_in(WORDS.edges)} AND trim(lower(s[-1]), '-') NOT IN {_in(WORDS.edges)} AND NOT list_contains(w, name)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no) = 1"""
)
def told_of_target(spark, sf_dir):
    """The first clause after a document's longest word that begins and ends on no function word and doesn't name it again."""
    docs = _read(spark, sf_dir, "documents")
    rows = F.transform(X.words(F.col("text")), lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w")))
    name = F.array_min(F.filter(rows, lambda r: F.regexp_like(r["w"], F.lit(r"^\p{L}{5,}$"))))["w"]
    told = lambda n: F.struct(n.alias("name"), G.name_predicate(F.col("text"), n, lambda c: F.lit(True), oblique_name="", lex=WORDS).alias("clause"))
    return _once(docs, X.let(name, told)).select("doc_id", "found.name", "found.clause").where("clause is not null")


@_query(
    rf"""WITH {_SENTENCES}, clauses AS (
        SELECT doc_id, sentence_no, unnest(range(len(c))) AS clause_no, trim(unnest(c), ' ,;:-–—„”"''!?.') AS clause FROM (SELECT doc_id, sentence_no, regexp_split_to_array(sentence, '[,;]') AS c FROM sentences)),
    short AS (
        SELECT *, list_filter(regexp_split_to_array(clause, '\s+'), lambda x: x <> '') AS w FROM clauses WHERE length(clause) BETWEEN 12 AND 70 AND NOT regexp_matches(clause, '[.,;:"„”«»!?()]')),
    cuts AS (SELECT doc_id, sentence_no, clause_no, w, unnest(range(1, len(w))) AS k FROM short WHERE len(w) BETWEEN 3 AND 10 AND lower(w[1]) <> 'and'),
    fit AS (
        SELECT *, abs(2 * k - len(w)) AS far, array_to_string(w[:k], ' ') AS l, array_to_string(w[k + 1:], ' ') AS r FROM cuts
        WHERE lower(w[k]) NOT IN {_in(HANGING)} AND lower(w[k + 1]) NOT IN {_in(HANGING + SUBORDINATE)} AND length(w[k]) > 2 AND length(w[k + 1]) > 2 AND k <= 8 AND len(w) - k <= 8)
    SELECT doc_id, l AS left_half, r AS right_half FROM fit WHERE length(l) >= 6 AND length(r) >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no, clause_no, far, k) = 1"""
)
def clause_halves(spark, sf_dir):
    """The first short clause of each document that can be cut, cut nearest its middle."""
    docs = _read(spark, sf_dir, "documents")
    half = G.clause_halves(F.col("text"), lambda c: F.lit(True), linkers=("and",), hanging=HANGING, subordinate=SUBORDINATE)
    return _once(docs, half).select("doc_id", F.col("found.left").alias("left_half"), F.col("found.right").alias("right_half"))


def _list_sql() -> str:
    read = ", ".join(f"regexp_extract(sentence, '{G.list_pattern(p, JOIN, LAST).replace(chr(39), chr(39) * 2)}', ['head', 'list']) AS r{i}" for i, p in enumerate(LISTS.values()))
    one = lambda i: f"SELECT doc_id, sentence_no, {i} AS kind, rtrim(r{i}.head, ' ,') AS head, regexp_split_to_array(r{i}.list, '{JOIN}') AS members FROM read WHERE r{i}.list <> ''"
    return rf"""WITH {_SENTENCES}, read AS (SELECT doc_id, sentence_no, {read} FROM sentences WHERE NOT regexp_matches(sentence, '["„”«»]')),
    found AS ({" UNION ALL ".join(one(i) for i in range(len(LISTS)))})
    SELECT doc_id, head || ' {L.BLANK}' AS stem, array_to_string(members, '|') AS members FROM found
    WHERE len(list_distinct(members)) = len(members) AND length(head) BETWEEN 12 AND {L.STEM_CHARS[1]} AND coalesce(lower({_TOKENS.format("head")}[-1]) NOT IN ('of', 'de'), true)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no, kind) = 1"""


@_query(_list_sql())
def ending_lists(spark, sf_dir):
    """The first sentence of each document that ends in a list of words of one kind, and the list."""
    docs = _read(spark, sf_dir, "documents")
    found = G.enumeration(F.col("text"), lambda s: F.lit(True), kinds=LISTS, join=JOIN, last=LAST, no_end=("of", "de"))
    return _once(docs, found).select("doc_id", "found.stem", F.array_join("found.members", "|").alias("members"))
