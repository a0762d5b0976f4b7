"""Operators over whole corpora against their sequential versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.operators import assignment, digests, judged, ordering, phrases, segments, spent
from folioforge.operators import ledger as B


def plain_ledger(stems):
    taken, out = {}, {}
    for group, i, words in sorted(stems, key=lambda s: s[1]):
        w, kept = set(words or []), taken.setdefault(group, [])
        out[i] = bool(w) and not any(10 * len(w & k) >= 7 * max(len(w), len(k)) for k in kept)
        if out[i]:
            kept.append(w)
    return out


def run_ledger(spark, stems):
    df = spark.createDataFrame(stems, "group string, id long, words array<string>")
    return {r["id"]: r["taken"] for r in B.ledger(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_ledger_equals_the_sequential_one(spark, seed):
    """Clusters of near stems, in which some are refused by ones that are refused themselves."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [rng.sample(words, rng.randint(1, 12)) for _ in range(25)]
    stems = []
    for i in range(400):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        stems.append((rng.choice(["a", "b", None]), 1000 - 2 * i, w + w[:1]))
    stems += [("a", 1, []), ("a", 3, None), (None, 5, ["w1"]), (None, 7, ["w1"]), ("b", 9, ["w1", "w2"]), ("b", 11, ["w1"])]
    got = run_ledger(spark, stems)
    assert got == plain_ledger(stems) and 50 < sum(got.values()) < 350


def test_a_chain_alternates(spark):
    """Each stem is like its neighbours only, so every other one is taken, over many rounds."""
    stems = [("g", i, [f"w{j}" for j in range(3 * i, 3 * i + 13)]) for i in range(12)]
    got = run_ledger(spark, stems)
    assert got == plain_ledger(stems) == {i: i % 2 == 0 for i in range(12)}


def test_no_stems(spark):
    assert run_ledger(spark, []) == {} and run_ledger(spark, [("a", 1, ["x", "y"])]) == {1: True}
    assert B.refused(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_hold_every_like_pair(spark, monkeypatch):
    """Where no frequent words are left to tell sets apart."""
    rng = random.Random(8)
    sets = [("g", i, sorted(rng.sample([f"w{j}" for j in range(9)], rng.randint(2, 8)))) for i in range(80)]
    distinct = {tuple(s[2]): s for s in reversed(sets)}.values()
    df = spark.createDataFrame(list(distinct), "group string, id long, words array<string>")
    got = {tuple(r) for r in B.like_pairs(df).collect()}
    want = {(a[1], b[1]) for a in distinct for b in distinct if a[1] < b[1] and 10 * len({*a[2]} & {*b[2]}) >= 7 * max(len(a[2]), len(b[2]))}
    assert got == want and want


def plain_mentions(docs, terms):
    terms = {t for t in terms if t and re.fullmatch(r"\w(.*\w)?", t, re.S)}
    out = []
    for i, text in docs:
        words = list(re.finditer(r"\w+", text or ""))
        for place, a in enumerate(words):
            for b in reversed(words[place:]):
                if text[a.start() : b.end()] in terms:
                    out.append((i, place, text[a.start() : b.end()]))
                    break
    return sorted(out)


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_mentions_take_the_longest_phrase(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rng = random.Random(4)
    terms = ["Ana", "Ana Maria", "Ana Maria Popa", "Maria", "a-b", "a", "Ana  Maria", "New York", "York", "Popa Ana", " x", "x.", "", None, "șarpe", "Ana", "\U0001f600"]
    bits = ["Ana", "Maria", "Popa", "a", "b", "New", "York", "șarpe", "Anatol", "x"]
    docs = [(i, "".join(rng.choice(bits) + rng.choice([" ", " ", " ", "-", "  ", ". "]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (None, "Ana"), (103, "Ana Maria Popa " * 500)]
    df, dictionary = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "t string")
    got = [tuple(r) for r in phrases.mentions(df, dictionary, "id", "text").collect()]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(plain_mentions(docs[:-2], terms) + [(None, 0, "Ana")] + plain_mentions(docs[-1:], terms), key=key)


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "Ana are mere")], "id long, text string")
    assert phrases.mentions(docs, spark.createDataFrame([(None,), ("",)], "t string"), "id", "text").count() == 0


@pytest.mark.parametrize("splits", [1, 7, 40])
def test_running_numbers_over_splits(spark, splits):
    rng = random.Random(splits)
    for share in (0.0, 0.04, 0.5):
        rows = [(i, rng.choice([True, None]) if rng.random() < share else False, rng.choice([None, 0, 1, 2, 3]), "x") for i in range(150)]
        df = spark.createDataFrame(rows, "i int, m boolean, v int, number string").drop("number").repartition(3)
        want, marks, since, chapter, before = [], 0, None, 1, None
        for n, (i, m, v, _) in enumerate(rows, 1):
            marks, since = marks + bool(m), 0 if m else since if since is None else since + 1
            chapter += before is not None and (v or 0) <= before
            before = v or 0
            want.append((i, n, marks, since, chapter))
        got = segments.running(df, ["i"], F.col("m"), F.col("v"), splits)
        assert sorted(tuple(r) for r in got.select("i", "number", "marks", "since", "chapter").collect()) == want
    assert segments.running(df.limit(0), ["i"], F.col("m"), F.col("v"), splits).count() == 0


@pytest.mark.parametrize("splits", [1, 9])
def test_shortest_prefixes_over_splits(spark, splits):
    rng = random.Random(6)
    terms = ["".join(rng.choice("aA" if i < 5 else "aBé") for i in range(rng.randint(2, 9))) for _ in range(300)] + ["abcd", "ABCDE", "abcdef", "abce", "Abc", None, ""]
    low = {t.lower() for t in terms if t and len(t) >= 4}
    want = {t: min((r for r in low if t.startswith(r)), key=len) for t in low}
    got = segments.shortest_prefixes(spark.createDataFrame([(t,) for t in terms], "t string"), "t", splits=splits).collect()
    assert {r["low"]: r["root"] for r in got} == want and len(got) == len(want)
    assert segments.shortest_prefixes(spark.createDataFrame([("abc",)], "t string"), "t", splits=splits).count() == 0


def test_digest_trees_find_all_differences(spark):
    rng = random.Random(12)
    old = [(rng.choice([None, rng.randint(-500, 500), 10**12 + rng.randint(0, 9), -(2**55)]), rng.choice(["a", None, ""]), rng.randint(0, 2)) for _ in range(400)]
    new = [r for r in old if rng.random() > 0.03] + [(r[0], "z", r[2]) for r in old[:9]] + old[:5]
    schema = "k long, side0 string, v int"
    a, b = (spark.createDataFrame(t, schema) for t in (old, new))
    x, y = Counter(old), Counter(new)
    want = sorted([(*r, "old") for r in (x - y).elements()] + [(*r, "new") for r in (y - x).elements()], key=repr)
    assert sorted((tuple(r) for r in digests.differences(a, b, "k", 8, 4).collect()), key=repr) == want
    assert digests.differences(a, a, "k").count() == 0 and digests.differences(a, a.limit(0), "k").count() == len(old) and digests.differences(a.limit(0), a.limit(0), "k").count() == 0


def test_few_differences_touch_few_nodes(spark):
    rows = spark.range(0, 20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    changed = rows.withColumn("v", F.when(F.col("k").isin(5, 13_333), 9).otherwise(F.col("v")))
    leaves, compared = digests.differing_leaves(digests.digest_tree(rows, "k", 8, 8), digests.digest_tree(changed, "k", 8, 8), 8)
    assert sorted(r[0] for r in leaves.collect()) == [0, 13_333 // 8]
    assert sum(compared) < 200  # of 2 x 2500 leaves and the nodes above them


def test_running_unions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 4, 9]), rng.choice([None, rng.randint(0, 40), 2**40 + rng.randint(0, 9), 32_768 * rng.randint(1, 4)])) for _ in range(200)]
    seen, want = set(), []
    for p in (None, 1, 2, 4, 9):
        own = {k for q, k in rows if q == p and k is not None}
        want.append((p, len(own), len(own - seen), len(own | seen)))
        seen |= own
    got = spent.running_union(spark.createDataFrame(rows, "p int, k long"), F.col("p"), F.col("k")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0] or 0) == want


def plain_assignment(items, caps, answer_cap):
    held, used, out = Counter(), Counter(), {}
    for i, _, shapes, answer in sorted(items, key=lambda r: r[1]):
        free = [s for s in shapes if held[s] < caps.get(s, 0)] if answer_cap and (answer is None or used[answer] < answer_cap) else []
        out[i] = free[0] if free else None
        if free:
            held[free[0]] += 1
            used[answer] += answer is not None
    return out


def test_assignment_equals_the_single_pass(spark):
    rng = random.Random(5)
    for caps, cap in (({"a": 20, "b": 7, "c": 0}, 3), ({"a": 500}, 2), ({"a": 9, "b": 9, "c": 9, "d": 9}, 1), ({"a": 3}, 0)):
        items = [(i, f"{rng.randrange(10**6):06d}-{i}", rng.sample("abcdx", rng.randint(0, 4)), rng.choice([None, "hot", "hot", f"n{rng.randint(0, 20)}"])) for i in range(150)]
        got = assignment.assign(spark.createDataFrame(items, "id long, priority string, shapes array<string>, answer string"), caps, cap).collect()
        assert {r["id"]: r["shape"] for r in got} == plain_assignment(items, caps, cap)
    assert assignment.assign(spark.createDataFrame([], "id long, priority string, shapes array<string>, answer string"), {"a": 1}, 1).count() == 0


def test_judged_while_written(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, t string")
    found = judged.write_judged(df, str(tmp_path / "t"), {"large": F.col("k") > 1, "c": F.col("t") == "c", "none": F.col("k") > 9})
    assert found == {"rows": 3, "large": 2, "c": 1, "none": 0} and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert judged.write_judged(df.limit(0), str(tmp_path / "t"), {"large": F.col("k") > 1}) == {"rows": 0, "large": 0}


def test_drawn_places_equal_one_sort(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", None]), f"{rng.randrange(5000):08x}"[::-1]) for i in range(400)]
    got = ordering.drawn_places(spark.createDataFrame(rows, "i int, g string, d string"), ["g"], F.col("d"), "i").collect()
    want = {}
    for g in ("a", None):
        want |= {i: n for n, (i, _, _) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1)}
    assert {r["i"]: r["place"] for r in got} == want
