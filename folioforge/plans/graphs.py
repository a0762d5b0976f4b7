"""Ledgers over whole scopes, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators.ledger import ledger
from folioforge.plans.catalogue import _BALANCED, _SENTENCES, _query, _read, _word_set


@_query(
    rf"""WITH {_SENTENCES}, stated AS (
        SELECT doc_id, lang, source, list_filter({_word_set("sentence")}, lambda x: NOT regexp_full_match(x, '_+')) AS w FROM sentences
        WHERE length(sentence) BETWEEN 30 AND 165 AND regexp_matches(sentence, '^\p{{Lu}}') AND {_BALANCED.format("sentence")} AND NOT contains(sentence, '(')
          AND regexp_matches(sentence, '[.!?]["”»]*$') AND NOT regexp_matches(sentence, '\?\s*$')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(sentence), sentence_no) = 1),
    scopes AS (SELECT lang, source, list([{{'id': doc_id, 'w': w}}] ORDER BY doc_id) AS v FROM stated GROUP BY lang, source),
    kept AS (
        SELECT unnest(list_reduce(list_prepend([]::STRUCT(id BIGINT, w VARCHAR[])[], v), lambda kept, s: CASE WHEN len(s[1].w) > 0 AND len(list_filter(kept, lambda k:
            10 * len(list_intersect(k.w, s[1].w)) >= 7 * greatest(len(k.w), len(s[1].w)))) = 0 THEN list_concat(kept, s) ELSE kept END)).id AS doc_id FROM scopes)
    SELECT lang, source, doc_id, doc_id IN (SELECT doc_id FROM kept) AS taken FROM stated"""
)
def corpus_ledger(spark, sf_dir):
    """Which documents' statements a running ledger of their (lang, source) takes, by ascending id."""
    docs = _read(spark, sf_dir, "documents")
    stated = docs.select("doc_id", "lang", "source", F.explode(F.array(X.concise(F.col("text"))["sentence"])).alias("s")).where("s is not null")  # read once
    found = ledger(stated.select(F.struct("lang", "source").alias("group"), F.col("doc_id").alias("id"), X.word_set(F.col("s")).alias("words")))
    return found.select("group.lang", "group.source", F.col("id").alias("doc_id"), "taken")
