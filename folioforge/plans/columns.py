"""Plain columns of names, sentences and words over the documents, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.functions import text as X
from folioforge.plans.catalogue import _SENTENCES, _TOKENS, _query, _read

#: Names that documents are given by their id and length: all known ones, their other cases, and words that are no names.
_GIVEN = [*dict.fromkeys(L.QUALITY_TERMS), "piatră", "munte", "DAVID", "Davidoiu", "samuel", "Anania", "Domnul"]
_NUMERALS = list(L.NUMERALS)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _class_sql(v: str) -> dict[str, str]:
    return {
        "term_group": f"CASE WHEN {v} IN {_in(L.PEOPLE)} THEN 'person' WHEN {v} IN {_in(L.PLACES)} THEN 'place' WHEN {v} IN {_in(L.DEITY)} THEN 'deity' ELSE 'other' END",
        "role": f"CASE WHEN {v} IN {_in(L.DEITY + L.COLLECTIVE + L.PEOPLE)} THEN 'agent' WHEN {v} IN {_in(L.PLACES)} THEN 'place' ELSE 'other' END",
        "swap_class": f"CASE WHEN {v} IN {_in(L.DEITY)} THEN 'deity' WHEN {v} IN {_in(L.COLLECTIVE)} THEN 'collective' ELSE 'ordinary' END",
    }


@_query(
    f"""WITH d AS (
        SELECT doc_id, coalesce(n_chars, 0) AS n, {_GIVEN}[(doc_id % {len(_GIVEN)} + 1)::INT] AS a, {_GIVEN}[((doc_id // 7 + coalesce(n_chars, 0)) % {len(_GIVEN)} + 1)::INT] AS b FROM documents),
    r AS (SELECT *, {_class_sql("a")["role"]} AS role, {_class_sql("b")["role"]} AS other, lower(a) AS la, lower(b) AS lb FROM d)
    SELECT doc_id, a AS name, b AS rival, {_class_sql("a")["term_group"]} AS term_group, role, {_class_sql("a")["swap_class"]} AS swap_class, CASE WHEN a IN {_in(L.FEMININE)} THEN 'f' ELSE 'm' END AS gender,
        a IN {_in(L.QUALITY_TERMS)} AS quality, a <> '{L.OBLIQUE_DEITY}' AS safe, role = other OR role = 'other' OR other = 'other' AS compatible,
        (length(la) <= length(lb) AND length(la) >= 4 AND starts_with(lb, la)) OR (length(la) > length(lb) AND length(lb) >= 4 AND starts_with(la, lb)) AS inflected,
        la = lb OR (a IN {_in(L.DEITY)} AND b IN {_in(L.DEITY)}) OR (length(la) <= length(lb) AND length(la) >= 4 AND starts_with(lb, la)) OR (length(la) > length(lb) AND length(lb) >= 4 AND starts_with(la, lb)) AS same_referent,
        a || ' ' || (n % 150 + 1) || ':' || (n % 30 + 1) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-' || (n % 30 + 1 + doc_id % 3) END AS reference FROM r"""
)
def name_classes(spark, sf_dir):
    """What is known of two names that each document is given, and whether one can stand for the other."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    pick = lambda i: F.get(F.lit(_GIVEN), (i % len(_GIVEN)).cast("int"))
    d = docs.select("doc_id", "n", pick(F.col("doc_id")).alias("name"), pick(F.floor(F.col("doc_id") / 7) + F.col("n")).alias("rival"))
    a, b = F.col("name"), F.col("rival")
    first = F.col("n") % 30 + 1
    return d.select(
        "doc_id", "name", "rival", X.term_group(a).alias("term_group"), X.role(a).alias("role"), X.swap_class(a).alias("swap_class"), X.gender(a).alias("gender"), a.isin(L.QUALITY_TERMS).alias("quality"),
        X.safe_to_swap(a).alias("safe"), X.compatible_kind(a, b).alias("compatible"), X.inflection(a, b).alias("inflected"), X.same_referent(a, b).alias("same_referent"),
        X.reference(a, F.col("n") % 150 + 1, first, first + F.col("doc_id") % 3).alias("reference"),
    )


_W = r"[\p{L}\p{M}\p{N}_]"
_NO_W = r"[^\p{L}\p{M}\p{N}_]"
_HEAD = r"list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')[1]"
_VALUES = "CASE lower(numeral) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in L.NUMERALS.items()) + " END"
_KINDS = " ".join(f"WHEN regexp_full_match(member, '{p}') THEN '{k}'" for k, p in L.MEMBER_KINDS.items())
#: What a list's member could be; a sentence is given one by its place and length.
_MEMBERS = ["trei fii", "vase de aur", "cu harfe", "carne din carnea tale", "trei case", "o sută de pâini", "vase de lemn", "cinci sute de oi pregătite", "harfe"]


@_query(
    rf"""WITH {_SENTENCES}, s AS (SELECT *, {_HEAD} AS head, {_NUMERALS}[(length(sentence) % {len(_NUMERALS)} + 1)::INT] AS numeral, {_MEMBERS}[((length(sentence) + sentence_no) % {len(_MEMBERS)} + 1)::INT] AS member FROM sentences)
    SELECT doc_id, sentence_no::INT AS sentence_no,
        NOT regexp_matches(sentence, '(?i)(^|{_NO_W})ca\s+(și\s+)?(în\s+)?(celelalte|mai\s+înainte|de\s+obicei|alt[ăa]\s+dat[ăa])($|{_NO_W})') AS no_anaphora,
        NOT regexp_matches(sentence, '(?i)(^|{_NO_W})(ei|ele)(\s*$|\s+[^\s,;.!?]|[^\s,;.!?\p{{L}}\p{{M}}\p{{N}}_])') AS closed,
        regexp_matches(sentence, '^:\s*[„«"]') AS opens_quote,
        CASE WHEN head IS NULL THEN 'empty' WHEN lower(head) IN {_in(L.SUBORDINATE)} THEN 'subordinate' WHEN regexp_matches(head, '^\p{{Lu}}') THEN 'capitalised' ELSE 'plain' END AS register,
        NOT regexp_matches(sentence, '[.,;:"„”«»!?()]') AND lower(head) NOT IN {_in(L.LINKERS)} AS clean,
        len(list_filter({_TOKENS.format("sentence")}, lambda x: x = {_TOKENS.format("sentence")}[1])) = 1 AS sole,
        ({_VALUES})::INT AS value, CASE {_KINDS} END AS kind FROM s"""
)
def sentence_columns(spark, sf_dir):
    """What each sentence leans on, how it begins, whether its first word stands in it once, and the kinds of a numeral and a list member that it is given."""
    docs = _read(spark, sf_dir, "documents")
    s = docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    s = s.select("*", X.words(F.col("sentence")).alias("words"))  # a column, so that a sentence is read once and not for each of its words
    t, words = F.col("sentence"), F.col("words")
    n = F.char_length(t)
    first = F.get(words, F.lit(0))
    numeral, member = F.get(F.lit(_NUMERALS), n % len(_NUMERALS)), F.get(F.lit(_MEMBERS), (n + F.col("sentence_no")) % len(_MEMBERS))
    sole = F.size(words) - F.size(F.array_remove(words, first)) == 1
    return s.select(
        "doc_id", "sentence_no", X.no_anaphora(t).alias("no_anaphora"), X.plural_pronouns_closed(t).alias("closed"), X.opens_quote(t).alias("opens_quote"), X.register(t).alias("register"), X.clean_member(t).alias("clean"),
        F.when(first.isNull(), False).otherwise(sole).alias("sole"), X.numeral_value(numeral).cast("int").alias("value"), X.member_kind(member).alias("kind"),
    )
