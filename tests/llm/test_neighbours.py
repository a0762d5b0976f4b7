"""Centroids, spelling variants and fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import centroids, fingerprints, spelling

# ---------------------------------------------------------------- centroids


def plain_means(rows, k, rounds, dims, scale=64, salt="1"):
    """Sorted (id, cluster, distance) and the centroids."""
    sound = lambda x: x is not None and math.isfinite(x) and abs(x) < 2**27 // scale
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(map(sound, v))]
    starts = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in starts]

    def assign():
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return [(i, v, *min((far(v, c), j) for j, c in enumerate(cents))) for i, v in kept]

    for _ in range(rounds):
        groups = {}
        for _, v, _, j in assign():
            groups.setdefault(j, []).append(v)
        cents = [tuple(sum(x) // len(x) for x in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, j, d) for i, _, d, j in assign()), key=repr), [list(c) for c in cents]


def clustered(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    out, cents = centroids.cluster_vectors(df, "vec_id", "e", **more)
    return out, sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=repr), cents.tolist()


def test_exponion_equals_a_full_search(spark):
    rng = random.Random(5)
    far = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in far[i % 9]]) for i in range(400)]
    out, got, cents = clustered(spark, rows, k=9, rounds=4, dimensions=4)
    assert (got, cents) == plain_means([(i, np.float32(v).tolist()) for i, v in rows], 9, 4, 4)
    assert out.agg(F.avg("scanned")).first()[0] < 6  # of 9, and 1 more for the own one


def test_ties_repeats_and_unsound_vectors(spark):
    rng = random.Random(7)
    lattice = [(rng.choice([i, 3, None]), [float(rng.randint(-1, 1)) / 64 for _ in range(3)]) for i in range(150)]
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [math.nan, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0]), (906, [0.0] * 4), (907, [3e38, 0.0, 0.0]), (908, [-0.001, 0.0, 0.001])]
    for k in (1, 2, 7, 40):
        _, got, cents = clustered(spark, lattice + odd, k=k, rounds=3, dimensions=3)
        assert (got, cents) == plain_means(lattice + odd, k, 3, 3)


def test_few_and_no_vectors(spark):
    _, got, cents = clustered(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], k=5, dimensions=2)
    assert sorted(r[2] for r in got) == [0, 0] and len(cents) == 2
    assert clustered(spark, [(1, [1.0])], k=5, dimensions=2)[1:] == ([], [])
    _, got, _ = clustered(spark, [(None, [1.0, 2.0])] * 3, k=2, dimensions=2)
    assert got == [(None, 0, 0)] * 3
    with pytest.raises(ValueError):
        clustered(spark, [(1, [1.0])], dimensions=65)


def test_cluster_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], "x") for i in range(60)] + [(60, [1.0] * 63, "y"), (61, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").write.parquet(str(tmp_path / "embeddings.parquet"))
    want, cents = plain_means([(i, v and np.float32(v).tolist()) for i, v, _ in rows], 16, 3, 64)
    got = centroids.op11_exponion(spark, str(tmp_path)).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == want
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


# ---------------------------------------------------------------- spelling


def plain_words(docs, least=7):
    """The words of (id, text) rows with each its count."""
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            at = h % len(low)
            word = low[:at] + low[at + 1 :] if h % 31 == 0 else low
            found[word] += len(word) >= least
    return +found


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    x, y = sorted((a, b), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_forms(counts, least_count=2, ratio=10):
    n = {w: c for w, c in counts.items() if c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out, key=repr)


def forms(spark, counts, **more):
    df = spark.createDataFrame([(w,) for w, c in counts.items() for _ in range(c)], "word string")
    return sorted((tuple(r) for r in spelling.spelling_forms(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("block_words", [3, 50_000])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_neighbourhoods_equal_all_pairs(spark, block_words, broadcast_rows):
    """Dense words over three letters, with runs of one letter, blocks cut down to a letter."""
    rng = random.Random(block_words)
    counts = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 2, 3, 20, 40, 400]) for _ in range(300)}
    counts |= {"a" * i: 2 * i for i in range(1, 9)} | {"": 5, "\U0001f600b": 2, "\U0001f600a": 30}
    assert forms(spark, counts, block_words=block_words, broadcast_rows=broadcast_rows) == plain_forms(counts)


def test_chunks_and_slices(spark, monkeypatch):
    rng = random.Random(11)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 7))): rng.choice([2, 25, 300]) for _ in range(400)}
    monkeypatch.setattr(spelling, "CANDIDATES_AT_ONCE", 50)
    words = sorted(counts)
    whole = np.zeros(len(words), np.int64)
    pairs = set()
    for size in (5, 6, 7):
        rows = [i for i, w in enumerate(words) if len(w) in (size, size + 1)]
        a, b = spelling.near_rows([words[i] for i in rows], whole[rows], np.full(len(rows), size), np.zeros(len(rows), int), np.full(len(rows), size + 1))
        got = [(rows[x], rows[y]) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got))
        pairs |= set(got)
    assert pairs == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_edit(x, y)}


def test_long_words_and_no_words(spark):
    long = "ab" * 2500
    counts = {long: 30, long[:-1]: 3, long[:2499] + "z" + long[2500:]: 2, "abcdefg": 2}
    assert forms(spark, counts) == plain_forms(counts)
    assert forms(spark, {}) == [] and forms(spark, {"once": 1}) == []
    assert spelling.spelling_forms(spark.createDataFrame([(None,), (None,)], "word string")).count() == 0


def test_spelling_query(spark, tmp_path):
    rng = random.Random(2)
    stems = ["election", "Élection", "elections", "elektion", "nationale", "short"]
    docs = [(i, " ".join(rng.choice(stems[:1] * 30 + stems).upper() if rng.random() < 0.2 else rng.choice(stems[:1] * 30 + stems) for _ in range(40)), 1) for i in range(60)]
    docs += [(None, "elections elections×", 0), (61, None, 0), (62, "", 0), (61, "election,ELECTION;elec-tion", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == plain_forms(plain_words([d[:2] for d in docs])) and any(r[1] for r in got)


# ---------------------------------------------------------------- fingerprints


def plain_signature(text, samples):
    counts = Counter(w for w in re.split(r"[ \t-\r]+", (text or "").lower()) if w)
    signed = lambda x: x.to_bytes(8, "little")
    unit = lambda x, width: ((x & ((1 << width) - 1)) + 0.5) * 2.0**-width
    out = []
    for k in range(samples):
        found = []
        for w, n in counts.items():
            term = xxhash.xxh64(w.encode(), seed=42).intdigest()
            start = xxhash.xxh64(k.to_bytes(4, "little"), seed=42).intdigest()
            first = xxhash.xxh64(signed(term), seed=start).intdigest()
            second = xxhash.xxh64(signed(first), seed=start).intdigest()
            r = -math.log(unit(first, 21) * unit(first >> 21, 21))
            b = unit(first >> 42, 22)
            ln_c = math.log(-math.log(unit(second, 32) * unit(second >> 32, 32)))
            t = math.floor(math.log(n) / r + b)
            rank = math.floor((ln_c - r * (t - b + 1) + 128) * (1 << 22))
            found.append((rank << 32) | ((second ^ (t * 2654435761)) & 0xFFFFFFFF))
        out.append(min(found) & 0xFFFFFFFF if found else None)
    return out


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def plain_edited(docs):
    """(id, n_chars, sha256 of the edited text, text, edited, next) by ascending id, rows of one id by text."""
    own = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, after) in zip(own, own[1:] + own[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return out


ODD_TEXTS = [None, "", "  \n\t", "one", "One one ONE two", "Été \U0001f600\U0001f600 x", "a" * 3001, "two\x00words here"]


@pytest.mark.parametrize("docs_per_cell", [3, 250])
def test_fingerprints_equal_the_plain_version(spark, docs_per_cell):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(3 * i - 40, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(40)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000, "last one here"), (-(2**62), "first one there")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, cell string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df, "doc_id", "text", samples=8, docs_per_cell=docs_per_cell).collect()}
    want = plain_edited(docs)
    assert len(got) == len(want)
    text_of = lambda s: "".join(f"{x:08x}" for x in s if x is not None)
    for i, n, sha, text, edited, after in want:
        a, b, c = (plain_signature(t, 8) for t in (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, text_of(a), text_of(b))
        assert (r["near_edited"], r["near_next"]) == (alike(a, b), alike(a, c))


def test_repeated_and_null_ids(spark):
    """Each row once, in a closed round by id; hot ids in parts, whose order is that of a hash."""
    rng = random.Random(4)
    docs = [(rng.choice([None, 5, 5, i]), f"text {rng.randint(0, 30)} of {i % 7}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for per_cell in (10, 1000):
        rows = fingerprints._with_next(df.select(F.col("doc_id").alias("id"), "text"), per_cell).where("guest = 0").collect()
        assert sorted((r["id"] or -1, r["text"]) for r in rows) == sorted((i or -1, t) for i, t in docs)
        assert Counter(r["next"] for r in rows) == Counter(t for _, t in docs)
        last = {}
        for r in rows:
            last.setdefault(r["id"], set()).add(r["next"])
        after = sorted({i for i, _ in docs if i is not None})
        for i, j in zip(after, after[1:], strict=False):  # some row of each id is followed by one of the next
            assert last[i] & {t for x, t in docs if x == j}
    assert fingerprints.edited_fingerprints(df, "doc_id", "text", samples=4, docs_per_cell=10).count() == len(docs)
    assert fingerprints.edited_fingerprints(df.limit(0), "doc_id", "text", samples=4).count() == 0
    (one,) = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "only this text")], "doc_id int, text string"), "doc_id", "text", samples=4).collect()
    assert one["near_next"] == 1.0
    with pytest.raises(ValueError):
        fingerprints.edited_fingerprints(df.select(F.col("doc_id").cast("string"), "text"), "doc_id", "text")


def test_agreement_is_generalised_jaccard(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(80)]
    texts = [" ".join(rng.choices(vocabulary[: rng.randint(2, 80)], k=rng.randint(10, 300))) for _ in range(60)]
    out = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", samples=64).collect()
    prints = {r["doc_id"]: [r["fingerprint"][i : i + 8] for i in range(0, 512, 8)] for r in out}
    errors = []
    for i in range(60):
        for j in range(i):
            a, b = Counter(texts[i].split()), Counter(texts[j].split())
            errors.append(alike(prints[i], prints[j]) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 5 * 0.5 / 8


def test_fingerprint_query(spark, tmp_path):
    docs = [(i, t, "en", "s", 1) for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op13_weighted_sampling(spark, str(tmp_path)).collect()
    want = plain_edited([d[:2] for d in docs])
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(w[:3] for w in want)
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert all(by[i] == by[i + len(ODD_TEXTS)] for i in range(len(ODD_TEXTS)))
