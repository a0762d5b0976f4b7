"""Operators for corpora beyond one task, over the standard tables, each beside its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators.assignment import assign
from folioforge.operators.digests import differences
from folioforge.operators.judged import write_judged
from folioforge.operators.phrases import mentions
from folioforge.operators.segments import running, shortest_prefixes
from folioforge.operators.spent import running_union
from folioforge.plans.catalogue import _TOKENS, _query, _read, frequent_proper_terms
from folioforge.tables import shared_dir

_GAPS = r"regexp_extract_all(text, '([^\p{L}\p{M}\p{N}_]*)[\p{L}\p{M}\p{N}_]+', 1)"
#: Terms as ``frequent_proper_terms`` finds them.
_TERMS = rf"""terms AS (SELECT term, count(*) AS n FROM (
        SELECT text, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT text, {_TOKENS.format("text")} AS w FROM documents))
    WHERE regexp_full_match(term, '\p{{Lu}}\p{{Ll}}+') AND NOT (i = 0 AND starts_with(text, term)) GROUP BY term HAVING count(*) >= 2)"""


@_query(
    rf"""WITH {_TERMS}, told AS (SELECT doc_id, {_TOKENS.format("text")} AS w, {_GAPS} AS g FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(list_append(g[2:], NULL)) AS gap, unnest(list_append(w[2:], NULL)) AS after FROM told),
    pairs AS (SELECT word || ' ' || after AS phrase FROM words WHERE gap = ' ' AND regexp_full_match(word, '\p{{Lu}}\p{{Ll}}+') AND regexp_full_match(after, '\p{{Lu}}?\p{{Ll}}+') GROUP BY 1 HAVING count(*) >= 3),
    hits AS (SELECT doc_id, CASE WHEN gap = ' ' AND word || ' ' || after IN (SELECT phrase FROM pairs) THEN word || ' ' || after WHEN word IN (SELECT term FROM terms) THEN word END AS phrase FROM words)
    SELECT phrase, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM hits WHERE phrase IS NOT NULL GROUP BY phrase"""
)
def dictionary_mentions(spark, sf_dir):
    """How often and in how many documents each frequent term and pair of words is met, the longer one first."""
    docs = _read(spark, sf_dir, "documents")

    def pairs(t):
        each = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.struct(a["word"].alias("a"), b["gap"].alias("gap"), b["word"].alias("b")))
        fit = lambda p: F.regexp_like(p["a"], F.lit(r"^\p{Lu}\p{Ll}+$")) & (p["gap"] == " ") & F.regexp_like(p["b"], F.lit(r"^\p{Lu}?\p{Ll}+$"))
        return F.transform(F.filter(each, fit), lambda p: F.concat_ws(" ", p["a"], p["b"]))

    from folioforge.functions.readings import tokens

    two = docs.select(F.explode(X.let(tokens(F.col("text")), pairs)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    found = mentions(docs, frequent_proper_terms(spark, sf_dir).select("term").union(two.select("phrase")), "doc_id", "text")
    each = found.groupBy("phrase", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("phrase").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_docs"))


@_query(
    rf"""WITH {_TERMS}, low AS (SELECT DISTINCT lower(term) AS low FROM terms WHERE length(term) >= 4),
    begun AS (SELECT low, unnest(range(4, length(low) + 1)) AS k FROM low)
    SELECT b.low AS term, arg_min(r.low, k) AS root FROM begun b JOIN low r ON r.low = left(b.low, k) GROUP BY b.low"""
)
def term_families(spark, sf_dir):
    """Each frequent term in lower case with the shortest term of four letters or more that begins it."""
    found = shortest_prefixes(frequent_proper_terms(spark, sf_dir), "term")
    return found.select(F.col("low").alias("term"), "root")


@_query(
    r"""WITH l AS (
        SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line, unnest(list_prepend('', s[:-2])) AS before FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    m AS (SELECT doc_id, line_no, length(line) AS n, regexp_matches(line, '\S') AND NOT regexp_matches(before, '\S') AS head, row_number() OVER (ORDER BY doc_id, line_no) AS number FROM l),
    r AS (SELECT *, lag(n) OVER (ORDER BY number) AS prior FROM m)
    SELECT doc_id, line_no::INT AS line_no, number, (count(*) FILTER (WHERE head) OVER (ORDER BY number)) AS headings, number - max(CASE WHEN head THEN number END) OVER (ORDER BY number) AS since_heading,
           (1 + sum(CASE WHEN n <= prior THEN 1 ELSE 0 END) OVER (ORDER BY number))::BIGINT AS chapter FROM r"""
)
def running_lines(spark, sf_dir):
    """All lines of all documents as one stream: place, headings so far, lines since the last one, and chapters, one for each fall in length."""
    lines = F.split(F.col("text"), "\n", -1)
    full = lambda x: F.regexp_like(x, F.lit(r"(?U)\S"))
    told = lambda l: F.transform(l, lambda x, i: F.struct(i.alias("line_no"), F.char_length(x).alias("n"), (full(x) & ((i == 0) | ~full(F.get(l, i - 1)))).alias("head")))  # noqa: E731, E741
    each = _read(spark, sf_dir, "documents").select("doc_id", F.inline(X.let(lines, told)))
    found = running(each, ["doc_id", "line_no"], F.col("head"), F.col("n"))
    return found.select("doc_id", "line_no", "number", F.col("marks").alias("headings"), F.col("since").alias("since_heading"), "chapter")


_CHANGED = "(l_orderkey * 7 + l_linenumber) % {}"


@_query(
    f"""WITH new AS (
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_CHANGED.format(4999)} = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE {_CHANGED.format(5003)} <> 0
        UNION ALL SELECT l_orderkey, l_linenumber + 100, l_partkey, l_quantity FROM lineitem WHERE {_CHANGED.format(5009)} = 0),
    old AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
    SELECT *, 'old' AS side FROM (FROM old EXCEPT ALL FROM new) UNION ALL SELECT *, 'new' FROM (FROM new EXCEPT ALL FROM old)"""
)
def table_differences(spark, sf_dir):
    """What lineitem and a copy of it, with lines lost, changed and added, don't share."""
    old = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    at = lambda m: (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % m == 0
    kept = old.where(~at(5003)).withColumn("l_quantity", F.when(at(4999), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return differences(old, kept.union(old.where(at(5009)).withColumn("l_linenumber", F.col("l_linenumber") + 100)), "l_orderkey")


@_query(
    """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, o_custkey FROM orders WHERE o_custkey IS NOT NULL),
    f AS (SELECT o_custkey, min(month) AS month FROM m GROUP BY o_custkey), n AS (SELECT month, count(*) AS n_new FROM f GROUP BY month), c AS (SELECT month, count(*) AS n_customers FROM m GROUP BY month)
    SELECT month, n_customers, coalesce(n_new, 0) AS n_new, (sum(coalesce(n_new, 0)) OVER (ORDER BY month))::BIGINT AS n_running FROM c LEFT JOIN n USING (month)"""
)
def running_customers(spark, sf_dir):
    """Customers of each month of orders, those without an order before, and all so far."""
    found = running_union(_read(spark, sf_dir, "orders"), F.trunc(F.col("o_orderdate").cast("date"), "month"), F.col("o_custkey"))
    return found.select(F.col("period").alias("month"), F.col("n_keys").alias("n_customers"), "n_new", "n_running")


_SHAPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SHAPE_SHARE, _ANSWER_CAP = 6, 3


@_query(
    f"""WITH seats AS (SELECT count(*) // {_SHAPE_SHARE} AS cap FROM orders),
    items AS (
        SELECT o_orderkey, md5('deal|' || o_orderkey) || '|' || o_orderkey AS p, dense_rank() OVER (ORDER BY o_custkey)::INT AS a,
               list_transform([0, o_orderkey % 3 + 1, o_orderkey % 2 + 3], lambda d: ((list_position({_SHAPES}, o_orderpriority) - 1 + d) % 5 + 1)::INT) AS o FROM orders),
    dealt AS (
        SELECT list({{'o': o, 'a': a, 's': []::INT[], 'c': []::INT[], 'out': []::INT[]}} ORDER BY p) AS v, list(o_orderkey ORDER BY p) AS ids, max(a) AS m, any_value(cap) AS cap FROM items, seats),
    passed AS (
        SELECT ids, list_reduce(list_prepend({{'o': []::INT[], 'a': 0::INT, 's': [0, 0, 0, 0, 0]::INT[], 'c': list_transform(range(m), lambda x: 0::INT), 'out': []::INT[]}}, v), lambda acc, x:
            {{'o': []::INT[], 'a': CASE WHEN acc.c[x.a] < {_ANSWER_CAP} THEN coalesce(list_filter(x.o, lambda k: acc.s[k] < cap)[1], 0) ELSE 0 END::INT,
              's': list_transform(acc.s, lambda y, i: CASE WHEN acc.c[x.a] < {_ANSWER_CAP} AND i = coalesce(list_filter(x.o, lambda k: acc.s[k] < cap)[1], 0) THEN y + 1 ELSE y END::INT),
              'c': CASE WHEN acc.c[x.a] < {_ANSWER_CAP} AND len(list_filter(x.o, lambda k: acc.s[k] < cap)) > 0 THEN list_concat(list_append(acc.c[:x.a - 1], acc.c[x.a] + 1), acc.c[x.a + 1:]) ELSE acc.c END::INT[],
              'out': list_append(acc.out, CASE WHEN acc.c[x.a] < {_ANSWER_CAP} THEN coalesce(list_filter(x.o, lambda k: acc.s[k] < cap)[1], 0) ELSE 0 END::INT)}}) AS r FROM dealt)
    SELECT unnest(ids) AS o_orderkey, {_SHAPES}[nullif(unnest(r.out), 0)] AS shape FROM passed"""
)
def capped_assignment(spark, sf_dir):
    """Orders dealt to priorities in a drawn order: each takes the first of three that has a seat left, three orders a customer at most."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    seats = orders.count() // _SHAPE_SHARE
    own = F.array_position(F.lit(_SHAPES), F.col("o_orderpriority")) - 1
    steps = F.array(F.lit(0), F.col("o_orderkey") % 3 + 1, F.col("o_orderkey") % 2 + 3)
    liked = F.transform(steps, lambda d: F.get(F.lit(_SHAPES), ((own + d) % 5).cast("int")))
    drawn = F.concat_ws("|", X.hash_order("deal", F.col("o_orderkey")), "o_orderkey")
    dealt = assign(orders.select(F.col("o_orderkey").alias("id"), drawn.alias("priority"), liked.alias("shapes"), F.col("o_custkey").alias("answer")), {s: seats for s in _SHAPES}, _ANSWER_CAP)
    return dealt.select(F.col("id").alias("o_orderkey"), "shape")


_RULES = {
    "orders": {
        "price": "o_totalprice IS NULL OR o_totalprice > 400000", "status": "o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')", "priority A": "o_orderpriority = '1-URGENT'", "priority B": "o_orderpriority = '2-HIGH'",
        "early": "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    },
    "lineitem": {"number": "l_linenumber < 1 OR l_linenumber > 6", "quantity": "l_quantity > 49", "flag A": "l_returnflag = 'A'", "flag N": "l_returnflag = 'N'", "net": "l_extendedprice * (1 - l_discount) < 1000"},
}


@_query(
    " UNION ALL ".join(
        f"SELECT '{table}' AS checked, '{name}' AS rule, count(*) FILTER (WHERE {rule}) AS n FROM {table}" for table, rules in _RULES.items() for name, rule in ({"rows": "true"} | rules).items()
    )
)
def violations_while_writing(spark, sf_dir):
    """How many rows of orders and lineitem break each rule, counted by the job that writes them."""
    at = f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}"
    found = [(t, name, n) for t, rules in _RULES.items() for name, n in write_judged(_read(spark, sf_dir, t), f"{at}/{t}", {k: F.expr(v) for k, v in rules.items()}).items()]
    return spark.createDataFrame(found, "checked string, rule string, n long")
