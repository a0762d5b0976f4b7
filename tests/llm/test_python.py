"""Audio, quality, joins, languages, leaks and packing against plain versions."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import audio, common, components, decontaminate, language_id, ngram_join, packing, quality, shingles, tokens

RNG = np.random.default_rng(7)
SYLLABLES = {"xx": ["ba", "co", "di", "fu", "ge", "li", "mo", "na"], "yy": ["sch", "tze", "kra", "pfo", "wun", "gol", "ber", "ich"]}


def prose(lang: str, n: int, rng=RNG) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)) + "."


# ---------------------------------------------------------------- audio


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(data):
    payload = audio.payload_of(data)
    assert payload.startswith(data) and len(payload) % 576 == 0 < len(payload) and set(payload[len(data) :]) <= {255}
    assert audio.decode_media(audio.encode_media(payload)) == payload


def test_odd_media_is_refused():
    for bad in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", audio.encode_media(b"ab")[:20]):
        with pytest.raises((ValueError, Exception)):
            audio.decode_media(bad)


def test_resampler_keeps_tones_and_stops_aliases():
    t = np.arange(12000) / 12000
    for hz, gain in ((500, 1), (2500, 1), (5500, 0)):
        y = audio.resample(np.sin(2 * np.pi * hz * t).astype(np.float32))
        want = gain * np.sin(2 * np.pi * hz * np.arange(8000) / 8000)
        assert len(y) == 8000 and np.abs(y[100:-100] - want[100:-100]).max() < 0.03


def test_log_mel_by_definition():
    x = RNG.standard_normal(1000).astype(np.float32)
    bank, window = audio._mel_bank()
    want = [np.log((np.abs(np.fft.rfft(x[i * 128 : i * 128 + 256] * window)) ** 2) @ bank + 1e-6) for i in range(1 + (1000 - 256) // 128)]
    assert np.allclose(audio.log_mel(x), want, atol=3e-3)


def plain_features(data):
    """The feature string by definition: every output sample, frame and band on its own."""
    back = data + bytes([255]) * (576 - len(data) if not data else -len(data) % 576)
    x = [(b - 128) / 128 for b in back]
    k = np.arange(-24, 25)
    h = np.sinc(k / 3) / 3 * 2 * np.hamming(49)
    y = [sum(x[i] * h[3 * m - 2 * i + 24] for i in range(max(0, (3 * m - 24) // 2), min(len(x), (3 * m + 24) // 2 + 1)) if abs(3 * m - 2 * i) <= 24) for m in range(-(-len(x) * 2 // 3))]
    bank, window = audio._mel_bank()
    frames = [y[at : at + 256] for at in range(0, len(y) - 255, 128)] or [y + [0] * (256 - len(y))]
    mel = np.array([np.rint(256 * np.log(np.abs(np.fft.rfft(np.array(f) * window)) ** 2 @ bank + 1e-6)) for f in frames])
    level = mel.mean(axis=1) / 256 * 10 / np.log(10)
    level -= np.median(level)
    on, spans = False, []
    for i, v in enumerate(level):
        if v >= 1 and not on:
            on = True
            spans.append([i, i])
        if v <= -1:
            on = False
        if on:
            spans[-1][1] = i
    crc = 0
    for at in range(0, len(mel), 64 * 256):
        part = mel[at : at + 64 * 256]
        part = np.r_[part, np.zeros((-len(part) % 64, 24))]
        crc = zlib.crc32(part.astype("<i2").tobytes(), crc)
    active = sum(((b * 128 + 256) - a * 128) / 8000 for a, b in spans)
    return f"frames={len(mel)};mels=24;spans={len(spans)};active={active:.3f};mel={crc:08x}"


def test_feature_by_definition(spark, tmp_path):
    texts = [None, "", "a", "The cat sat on the mat. " * 90, prose("yy", 400) + "   " * 900 + prose("xx", 300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in audio.op1_audio_features(spark, str(tmp_path)).collect():
        assert r["feature"] == plain_features((texts[r["doc_id"]] or "").encode())
        assert len(r["span_starts"]) == len(r["span_ends"]) and r["n_tensors"] >= 1 and r["tensor_bytes"] > 6144 * r["n_tensors"]


def test_hysteresis():
    level = np.array([0, 0, 5, 0.5, 0.5, -5, 0.5, 5, -5, 0, 0, 0, 0])
    mel = np.repeat((level / (10 / np.log(10)))[:, None], audio.MELS, axis=1)
    assert [(round(s * 8000 / 128), round((e * 8000 - 256) / 128)) for s, e in audio.active_spans(mel)] == [(2, 4), (7, 7)]


def test_audio_features(spark):
    texts = ["", None, "x" * 576, "șț" * 9000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(9, "a", 1)], "doc_id long, text string, media int")
    rows = {r["doc_id"]: r for r in audio.audio_features(df).collect()}
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), rows[i]
        payload = audio.payload_of(data)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        stored = audio.read_tensors(r["tensors"][0])
        assert stored.schema.field("tensor").type == audio.TENSOR
        frames = sum(audio.read_tensors(x)["frames"].to_numpy().sum() for x in r["tensors"])
        assert f"frames={frames};" in r["feature"]
        starts, ends = stored["start_s"].to_numpy(), stored["end_s"].to_numpy()
        assert (starts < ends).all() and (np.diff(starts) > 0).all()
    assert rows[4][1:] == rows[9][1:] and rows[0][1:] == rows[1][1:]
    assert audio.audio_features(df.limit(0)).count() == 0


# ---------------------------------------------------------------- components and the join


def plain_components(nodes, links):
    low = {n: n for n in nodes}
    find = lambda x: x if low[x] == x else find(low[x])
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(20)] + [(200, 200), (7, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = plain_components({x for e in edges for x in e}, edges)
    assert {r["u"]: r["v"] for r in components.components(df).collect()} == {n: r for n, r in want.items() if n != r}
    split = components.components(df, broadcast_rows=3, hub=4)
    assert {r["u"]: r["v"] for r in split.collect()} == {n: r for n, r in want.items() if n != r}
    assert components.components(df.limit(0)).count() == 0
    a, b = np.array([0, 1, 4]), np.array([1, 2, 5])
    assert ngram_join.local_components(a, b, 6).tolist() == [0, 0, 0, 3, 4, 4]


def plain_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    c = len(a & b)
    return bool(c) and 100 * c >= 75 * (len(a) + len(b) - c)


def corpus_of_copies():
    rng = np.random.default_rng(3)
    docs = [None, "", " \n\t", "one", "One", "one two three four", "ONE two  three\nfour", "É a b c d", "é a b c d"]
    for size in (7, 12, 40, 120):
        for _ in range(4):
            words = prose("xx", size, rng).split()
            docs.append(" ".join(words))
            for _ in range(5):
                own = list(words)
                for _ in range(rng.integers(0, 4)):
                    own[rng.integers(len(own))] = "changed" + str(rng.integers(99))
                docs.append(" ".join(own[: len(own) - int(rng.integers(0, 3))]))
    chain = prose("yy", 60, rng).split()
    docs += [" ".join(chain[i : i + 40]) for i in range(0, 20, 2)]  # neighbours link, ends don't
    passage = prose("yy", 30, rng)
    docs += [prose("xx", 30, rng) + " " + passage for _ in range(12)]
    return docs + docs[20:24] * 3


@pytest.mark.parametrize(("pack", "block"), [(1 << 20, 1 << 21), (300, 150)])
def test_similarity_components(spark, monkeypatch, pack, block):
    monkeypatch.setattr(ngram_join, "PACK", pack)
    docs = corpus_of_copies()
    sets = [plain_set(d) for d in docs]
    want = plain_components(range(len(docs)), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if linked(sets[i], sets[j])])
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, cls string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df, block_shingles=block).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert len(set(want.values())) < len(docs) - 60


def test_similarity_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.similarity_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (5, 5)], key=str)
    assert ngram_join.similarity_components(df.limit(0)).count() == 0


def test_links_through_rows_without_an_id(spark):
    words = prose("xx", 60, np.random.default_rng(41)).split()
    near = lambda n: " ".join(words[n : n + 48])
    rows = [(1, near(0)), (None, near(5)), (9, near(10)), (4, near(3) + " x"), (None, "only here and in no other row")]
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(5), 2) if linked(sets[i], sets[j])]
    root = plain_components(range(5), links)
    want = sorted((str(i), str(min((rows[k][0] for k in range(5) if root[k] == root[n] and rows[k][0] is not None), default=None))) for n, (i, _) in enumerate(rows))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (0, 1) in links and (1, 2) in links and (0, 2) not in links and got == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_occurrence_search_finds_every_component(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(int(rng.integers(2, 5))):
        base = rng.choice(400, int(rng.integers(5, 80)), replace=False)
        for _ in range(int(rng.integers(1, 14))):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15])]
            sets.append(np.unique(np.r_[keep, rng.choice(400, int(rng.integers(1, 6)))]).astype(np.uint64))
    root = ngram_join.OccurrenceIndex(sets).run()
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if linked(set(sets[i].tolist()), set(sets[j].tolist()))]
    want = plain_components(range(len(sets)), links)
    assert {frozenset(np.flatnonzero(root == r).tolist()) for r in root.tolist()} == {frozenset(n for n in want if want[n] == r) for r in want.values()}


def test_merge_is_the_same_by_heap_and_by_sort():
    lists = [np.sort(RNG.choice(40, 12, replace=False)) for _ in range(5)]
    few = ngram_join._merge(lists, 2)
    many = ngram_join._merge(lists + [np.arange(100, 200)], 2)
    assert few[0].tolist() == many[0].tolist() and few[1].tolist() == many[1].tolist()


def test_shingles_of_long_texts_go_in_parts(monkeypatch):
    text = prose("xx", 3000)
    whole = shingles.shingle_set(text)
    monkeypatch.setattr(shingles, "chunks", lambda d: tokens.chunks(d, 50))
    assert (shingles.shingle_set(text) == whole).all() and len(whole) == len(plain_set(text))


# ---------------------------------------------------------------- languages and quality


def test_language_id(spark):
    rows = [(i, prose(lang, 30), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(rows + [(900, "balico", None), (901, None, "xx"), (902, "123 ...", "xx"), (903, "", "yy"), (905, "日本", "xx")], "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 4 <> 1"))
    assert sorted(model.languages) == ["xx", "yy"]
    got = {r["doc_id"]: r for r in language_id.identify(df, model, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["xx", "und", "und", "und"] and got[905]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, none, ["doc_id"]).collect()} == {"und"}


def test_filter_holds_every_gram_and_few_others():
    grams = [np.unique(RNG.integers(0, 1 << 32, 500, dtype=np.uint32)) for _ in range(11)]
    model = language_id.build([(f"l{i}", g) for i, g in enumerate(grams)])
    for i, g in enumerate(grams):
        word, bit = divmod(i, 64)
        assert (model.masks_of(g)[:, word] >> np.uint64(bit) & np.uint64(1)).all()
    other = model.masks_of(RNG.integers(0, 1 << 32, 20_000, dtype=np.uint32))
    rate = np.mean(other[:, 0] & np.uint64(1) > 0)
    assert abs(rate - model.false_rates[0]) < 0.01


class PlainModel:
    """The same model from dictionaries, one n-gram at a time."""

    def __init__(self, texts):
        counts = {quality.ORDER: {}}
        for data in texts:
            for g in self.grams(data):
                counts[quality.ORDER][g] = counts[quality.ORDER].get(g, 0) + 1
        for k in range(quality.ORDER - 1, 0, -1):
            counts[k] = {}
            for g in counts[k + 1]:
                counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
        self.size, self.counts, self.contexts, self.d = sum(counts[quality.ORDER].values()), counts, {}, {}
        for k, own in counts.items():
            n = [sum(v == i for v in own.values()) for i in range(1, 5)]
            d = [0, 0.5, 1.0, 1.5]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                d = [0, *(min(i, max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3))]
            self.d[k] = d
            for g, v in own.items():
                total, freed = self.contexts.get((k, g[:-1]), (0, 0.0))
                self.contexts[k, g[:-1]] = total + v, freed + d[min(v, 3)]

    @staticmethod
    def grams(data):
        c = quality._START + data.translate(quality.CLASS_TABLE)
        return [c[i : i + quality.ORDER] for i in range(len(data))]

    def p(self, g):
        if not g:
            return 1 / quality.CLASSES
        k, below = len(g), self.p(g[1:])
        if (k, g[:-1]) not in self.contexts:
            return below
        total, freed = self.contexts[k, g[:-1]]
        v = self.counts[k].get(g, 0)
        return (v - self.d[k][min(v, 3)]) / total + freed / total * below


def plain_bits(own, pooled, data):
    share = quality.POOLED_BYTES / (own.size + quality.POOLED_BYTES) if own else 1.0
    return sum(-np.log2(max(share * pooled.p(g) + ((1 - share) * own.p(g) if own else 0), 1e-12)) for g in PlainModel.grams(data))


@pytest.mark.parametrize("group", [1 << 25, 2_000])
def test_perplexity_and_decision_by_brute_force(spark, group, monkeypatch):
    """Against dictionaries, with one shard and with many, salted ones."""
    rng = np.random.default_rng(43)
    trusted = [(prose("xx" if i % 3 else "yy", 60, rng), "xx" if i % 3 else "yy") for i in range(60)] + [("tiny text", "zz"), (None, "xx"), ("b c", None)]
    df = spark.createDataFrame(trusted, "text string, lang string")
    monkeypatch.setattr(quality, "GROUP_BYTES", group)
    monkeypatch.setattr(quality, "CELLS", 4096)
    held = {r["text"] for r in df.where(F.pmod(F.xxhash64("text"), F.lit(quality.HELD_OUT)) == 0).collect()}
    fitted = [(t, x) for t, x in trusted if t and t not in held]
    of = {x: PlainModel([t.encode() for t, y in fitted if y == x]) for x in ("xx", "yy", "zz") if any(y == x for _, y in fitted)}
    pooled = PlainModel([t.encode() for t, _ in fitted])
    bits = lambda t, x: plain_bits(of.get(x), pooled, t.encode())
    rows = [(1, prose("xx", 30, rng), "xx"), (2, prose("yy", 30, rng), "xx"), (3, "%&/ $$$ 42 " * 9, "yy"), (4, "ba co", None), (5, "ȘȚ! x", "new"), (6, "", "xx"), (7, None, None), (8, "tiny text", "zz"), (1, prose("yy", 20, rng), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = quality.fit(df)
    got = {(r["doc_id"], r["text"]): r for r in quality.score(docs, model.levels, "text", "lang", "b", "n", group).collect()}
    for i, t, x in rows:
        assert got[i, t]["n"] == len((t or "").encode()) and abs(got[i, t]["b"] - bits(t or "", x)) <= 2e-3 * max(1, got[i, t]["b"])
    # limits by definition: the quantile of held-out rates, mixed with the pooled excess
    out = [(t, x) for t, x in trusted if t in held]
    rated = {x: [(bits(t, x), len(t.encode())) for t, y in out if y == x] for x in {y for _, y in out if y}}
    rated[quality.POOLED] = [(plain_bits(None, pooled, t.encode()), len(t.encode())) for t, _ in out]
    mean = {x: sum(b for b, _ in v) / sum(n for _, n in v) for x, v in rated.items()}
    rate = lambda b, n, x: (b + quality.PRIOR_BYTES * mean[x]) / (n + quality.PRIOR_BYTES)
    rates = {x: [rate(b, n, x) for b, n in v] for x, v in rated.items()}
    spread = {x: 3.0902323 * float(np.std(v, ddof=1)) if len(v) > 1 else 0.0 for x, v in rates.items()}
    top = {x: max(max(v) - mean[x], spread[x]) for x, v in rates.items()}  # the quantile of so few is the largest
    limit = {x: mean[x] + max(0, top[x] if x == quality.POOLED else (len(v) * top[x] + quality.POOLED_DOCS * top[quality.POOLED]) / (len(v) + quality.POOLED_DOCS)) for x, v in rated.items()}
    assert {r["lang"] for r in model.limits.collect()} == set(mean) and all(abs(r["mean"] - mean[r["lang"]]) < 2e-3 and abs(r["limit"] - limit[r["lang"]]) < 3e-3 for r in model.limits.collect())
    decided = {(r["doc_id"], r["text"]): r for r in quality.classify(docs, df).collect()}
    for i, t, x in rows:
        r, own = decided[i, t], x if x in mean else quality.POOLED
        assert r["perplexity"] is None if not t else abs(r["perplexity"] - 2 ** (bits(t, x) / len(t.encode()))) < 4e-3 * r["perplexity"]
        assert r["accepted"] == (not t or rate(bits(t, x), len(t.encode()), own) <= limit[own])
    assert not decided[3, rows[2][1]]["accepted"] and decided[1, rows[0][1]]["accepted"]


def test_probabilities_sum_to_one():
    model = PlainModel([prose("xx", 300).encode()])
    context = quality._START[: quality.ORDER - 4] + b"\x02\x01\x35"
    assert abs(sum(model.p(context + bytes([c])) for c in range(quality.CLASSES)) - 1) < 1e-9


@pytest.mark.parametrize("chunk", [4, 7, 1 << 20])
def test_texts_in_chunks_have_all_their_ngrams(monkeypatch, chunk):
    texts = pa.chunked_array([[b"some words", b"", None], [b"a text over many chunks " * 5, b"x", b"some words"]])
    whole = [np.concatenate([*quality.grams_of(t.as_py() or b""), np.empty(0, quality.GRAM)]) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", chunk)
    got = [[] for _ in whole]
    for rows, starts, grams in quality._some_texts(texts, [0, 1, 3, 4, 5]):
        for row, part in zip(rows, np.split(grams, starts[1:]), strict=True):
            got[row] += part.tolist()
    assert got == [w.tolist() for w in whole]
    assert quality._all_distinct(texts, [0, 3, 5]).tolist() == sorted({g for i in (0, 3, 5) for g in whole[i].tolist()})
    assert not len(quality._all_distinct(texts, [1, 2]))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    assert common.scratch_dir(Session(spark_master="yarn", **{"spark.checkpoint.dir": "hdfs:/x"})) == "hdfs:/x"
    assert common.scratch_dir(Session(spark_master="local[2]")).startswith("file:")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session(spark_master="local-cluster[2,1,1024]"))


def test_quality_keeps_prose_and_drops_noise(spark):
    rng = np.random.default_rng(17)
    good = [(i, prose("xx", 80, rng), "xx") for i in range(300)]
    bad = [(1000 + i, prose("xx", 60, rng).upper().replace(" ", "!! "), "xx") for i in range(5)]
    df = spark.createDataFrame(good + bad + [(2000, None, "xx"), (2001, "", None)], "doc_id long, text string, lang string").withColumn("_bits", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(0, 0, 0), (1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_rows(df, labels)
    assert trusted.count() == 249
    got = {r["doc_id"]: r for r in quality.classify(df, trusted).collect()}
    assert len(got) == 307 and {r["_bits"] for r in got.values()} == {"x"}
    assert not any(got[1000 + i]["accepted"] for i in range(5)) and sum(got[i]["accepted"] for i in range(250)) >= 246 and sum(got[i]["accepted"] for i in range(250, 300)) >= 46
    assert got[2000]["accepted"] and got[2000]["perplexity"] is None and got[2001]["accepted"]
    assert all(r["accepted"] for r in quality.classify(df, df.limit(0)).collect()) and quality.classify(df.limit(0), trusted).count() == 0


def test_texts_of_other_languages_meet_the_pooled_limit(spark):
    rng = np.random.default_rng(23)
    good = [(i, prose("xx" if i % 2 else "yy", 400, rng), "xx" if i % 2 else "yy") for i in range(80)]
    noise = "".join(map(chr, rng.integers(33, 127, 900)))
    df = spark.createDataFrame([*good, (100, noise, None), (101, noise, "zz"), (102, noise, "xx"), (103, prose("xx", 200, rng), None), (104, prose("yy", 200, rng), "zz")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(df, df.where("doc_id < 80")).collect()}
    assert [got[i] for i in range(100, 103)] == [False] * 3 and got[103] and got[104]


# ---------------------------------------------------------------- leaks


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.lists(st.sampled_from([b"a", b"b", b"c", b"e"]), max_size=30))
def test_subsequence(a, b):
    assert decontaminate.common_subsequence(a, b) == plain_lcs(a, b)


def test_leaks(spark):
    rng = np.random.default_rng(11)
    items = [(i, prose("xx", int(rng.integers(15, 60)), rng)) for i in range(20)] + [(20, None), (21, "")]
    docs, want = [], set()
    for i in range(120):
        words = prose("xx", int(rng.integers(1, 300)), rng).split()
        if i < 60:
            j = i % 20
            own = items[j][1].split()
            if i >= 20:  # reworded: some words changed or left out
                own = [w for k, w in enumerate(own) if k % 9 != 4] if i < 40 else [f"new{k}" if k % 7 == 3 else w for k, w in enumerate(own)]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = own
            want.add((i, j))
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame([*docs, (500, None), (501, ""), (502, "...")], "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    brute = {(i, j) for i, t in docs for j, own in items[:20] if plain_lcs(*([w for p in decontaminate.words_of(x.encode()) for w in p] for x in (own, t))) >= 0.95 * len(own.split()) and own.split()[0] in t}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 2 and len(brute & want - got) == 0
    left = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()}
    assert left == {r["doc_id"] for r in df.collect()} - {i for i, _ in got}
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.3, 0.35])
def test_leaks_that_are_only_reworded(spark, share):
    rng = np.random.default_rng(29)
    rare = lambda: "".join(rng.choice(SYLLABLES["xx"], 6))
    items = [(i, " ".join(rare() if rng.random() < 0.5 else w for w in prose("xx", int(rng.integers(15, 60)), rng)[:-1].split())) for i in range(40)]
    docs = []
    for i, t in items:
        own = t.split()
        for k in rng.choice(len(own), int(share * len(own)), replace=False):
            own[k] = "".join(rng.choice(SYLLABLES["yy"], 5))
        words = prose("xx", 120, rng).split()
        docs.append((i, " ".join([*words[:60], *own, *words[60:]])))
    docs += [(100 + i, prose("xx", 200, rng)) for i in range(100)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    brute = {(i, j) for i, t in docs for j, own in items if i == j and plain_lcs(own.encode().split(), t.encode().split()) >= decontaminate.SUBSEQUENCE * len(own.split())}
    assert len(brute) == 40 and len(brute & got) >= 39 and len(got - brute) <= 1


def test_singular_directions(spark):
    docs = spark.createDataFrame([(i, prose("xx" if i % 2 else "yy", 200)) for i in range(60)], "doc_id long, text string")
    space = decontaminate.fit_space(docs)
    rows = []
    for r in docs.collect():
        f = decontaminate.codes_of(r["text"].encode()) % decontaminate.FEATURES
        for i in range(0, len(f), 64):
            own = (np.bincount(f[i : i + 64], minlength=decontaminate.FEATURES) > 0) * space.idf
            rows.append(own / max(np.linalg.norm(own), 1e-9))
    rows = np.array(rows)
    s = np.linalg.svd(rows, compute_uv=False)
    u, _ = np.linalg.qr(space.project / np.maximum(space.idf[:, None], 1e-9))
    assert np.linalg.norm(rows @ u) ** 2 > 0.75 * (s[: decontaminate.RANK] ** 2).sum()


def plain_space(texts, items):
    """The space and the items of a corpus, without Spark."""
    words = decontaminate.Codes(np.concatenate([decontaminate.codes_of(t.encode()) for _, t in items]))
    batch = list(decontaminate._batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])])))
    n = np.zeros(decontaminate.FEATURES + 1 + len(words.codes), np.int64)
    for r in decontaminate._frequencies(words)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])])):
        n[r.column(0).to_numpy()] += r.column(1).to_numpy()
    idf = np.log((1 + n[decontaminate.FEATURES]) / (1 + n[: decontaminate.FEATURES])).astype(np.float32)
    project = np.random.default_rng(1).standard_normal((decontaminate.FEATURES, 48)).astype(np.float32) * idf[:, None]
    space = decontaminate.Space(idf, project, dict(zip(words.codes.tolist(), n[decontaminate.FEATURES + 1 :].tolist(), strict=True)))
    return batch, space, decontaminate.make_items(items, space)


def test_cosine_proposes_the_candidates():
    rng = np.random.default_rng(31)
    items = [(i, prose("xx", int(rng.integers(15, 60)), rng)) for i in range(20)]
    texts = [prose("xx", int(rng.integers(1, 300)), rng) + (" " + items[i % 20][1] if i < 40 else "") for i in range(150)]
    batches, space, groups = plain_space(texts, items)
    number, found = {}, {}
    for cosine in (decontaminate.COSINE, -2.0, 1.5):
        found[cosine] = {}
        number[cosine] = sum(decontaminate.search_batch(b, groups, space, found[cosine], cosine) for b in batches)
    windows = sum(-(-(-(-n // decontaminate.BLOCK)) // max(1, g.blocks // 4)) * len(g.ids) for b in batches for n in b.lens.tolist() for g in groups)
    assert number[-2.0] == windows and number[1.5] == 0 and not found[1.5]
    assert number[decontaminate.COSINE] < windows / 4 and set(found[decontaminate.COSINE]) == set(found[-2.0]) and len(found[-2.0]) >= 40


def test_long_texts_and_large_benchmarks_go_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(37)
    items = [(i, prose("xx", 30, rng)) for i in range(12)]
    long = " ".join(prose("xx", 400, rng) + " " + t for _, t in items)
    df = spark.createDataFrame([(1, long), (1, long), (None, items[3][1]), (7, "a")] + [(100 + i, "ba") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(df, bench).select("doc_id", "item_id", "common_words").collect()), key=str)
    assert len(whole) == 25 and whole.count((1, 5, 30)) == 2
    sliced = sorted(map(tuple, decontaminate.find_leaks(df, bench, slice_bytes=600).select("doc_id", "item_id", "common_words").collect()), key=str)
    assert sliced == whole
    batches, space, groups = plain_space([long], items)
    one, parts = {}, {}
    for b in batches:
        decontaminate.search_batch(b, groups, space, one)
    monkeypatch.setattr(decontaminate, "SEGMENT", 512)
    small = list(decontaminate._batches(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([long])], ["i", "t"])]), decontaminate.overlap_of(groups)))
    assert len(small[0].lens) > 10 and max(small[0].lens) <= 512
    for b in small:
        decontaminate.search_batch(b, groups, space, parts)
    assert set(one) == set(parts) and len(one) == 12


# ---------------------------------------------------------------- tokens and packing

TEXTS = ["a<|endoftext|>b   x", "é ́a", "it's  I'LL\x1cfoo\x85bar　 z", "ΣΑΣ Σ", "", "  ", "<|startoftext|> <|ENDOFTEXT|> THE", "don't' s", ").", "a.. b., ÀB. ǅ. ﬁ, İ. İx", "日本語, 한국어. ½ ² x²", prose("yy", 300)]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aAbÉéșȘ.,' \n0Σ<|endoftx>", max_size=60)))
def test_words_encode_as_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    e = tokens.encoder(packing.default_tokenizer())
    (got,) = [x for x in e.encode([text.encode()])]
    assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_store_is_bounded(monkeypatch):
    e = tokens.WordEncoder(packing.default_tokenizer(), most_words=50)
    texts = [prose("xx", 40).encode() for _ in range(20)]
    one = [next(e.encode([t])) for t in texts]
    monkeypatch.setattr(tokens, "CHUNK", 60)
    assert [next(e.encode([t])) for t in texts] == one and len(e.store) < 400


def check_packing(rows, capacity, lengths):
    by, pieces = {}, {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, n in lengths.items():
        own = sorted(pieces[doc])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(x for *_, x in own) == n
        assert all(length == capacity for *_, length in own[:-1]) and [s for _, s, _ in own] == [capacity * i for i in range(len(own))]
    return len(by)


@pytest.mark.parametrize("group", [20_000, 25])
def test_packing(spark, group):
    texts = [*TEXTS, None, *(prose("xx", int(n)) for n in RNG.integers(1, 160, 150))]
    e = tokens.WordEncoder(packing.default_tokenizer()).tokenizer
    ids = {i: [*e.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    capacity = 128
    rows = packing.pack(packing.pieces_of(df, packing.default_tokenizer(), capacity), capacity, group).collect()
    n = check_packing(rows, capacity, {i: len(x) for i, x in ids.items()})
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    counts = np.bincount([r["length"] for r in rows], minlength=capacity + 1)
    assert n <= packing.lower_bound(counts, capacity) * 1.05 + 2
    kept = packing.pieces_of(df, packing.default_tokenizer(), capacity, keep_ids=True).where("doc_id = 11").orderBy("piece").collect()
    assert [x for r in kept for x in r["ids"]] == ids[11]
    assert packing.pack(packing.pieces_of(df.limit(0), packing.default_tokenizer(), capacity), capacity).count() == 0


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two three")] * 200 + [(3, None)] * 30, "doc_id long, text string")
    rows = packing.pack(packing.pieces_of(df, packing.default_tokenizer(), 16), 16, 20).collect()
    assert len(rows) == 230 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 230


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_bounds_hold(lengths):
    lengths, capacity = np.array(lengths), 30
    bins = packing.best_fit_decreasing(lengths, capacity)
    assert np.bincount(bins, weights=lengths).max() <= capacity

    def least(left, room, most):
        if not left:
            return len(room)
        best, seen = most, set()
        for i, r in enumerate(room):
            if r >= left[0] and r not in seen:
                seen.add(r)
                best = min(best, least(left[1:], [*room[:i], r - left[0], *room[i + 1 :]], best))
        return min(best, least(left[1:], [*room, capacity - left[0]], best)) if len(room) + 1 < best else best

    exact = least(sorted(lengths.tolist(), reverse=True), [], int(bins.max()) + 1)
    assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= exact <= bins.max() + 1
