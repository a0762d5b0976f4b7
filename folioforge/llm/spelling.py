"""Spelling variants by full neighbourhood generation.

Every word emits all distinct words that one deletion, replacement or insertion over the
observed alphabet makes of it. A candidate that stands in the vocabulary is a near word:
the lookup alone decides and no distance is worked out.

The candidates of a large vocabulary are far too many to shuffle, and the vocabulary itself
to send to every task. So words are dealt to blocks: two words that differ by an edit in
one half agree in the other half, which names the block; a word emits an edit's candidates
in the block that this edit can't leave, and looks them up among the words there. An edit
has one place (that of a letter put beside its like is the leftmost) and so one block.
A block with too many words is cut by halving the stretch in which its words may differ,
down to one letter, where a block holds at most as many words as two letters can make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker, settle

#: Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word has at least so many letters and occurrences, and its form so many times its own.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Blocks of more words are cut; the most hot blocks that are broadcast.
BLOCK_WORDS, BROADCAST_ROWS = 50_000, 200_000
#: Words that are looked up together, and candidates that are made at once.
CHUNK_WORDS, CANDIDATES_AT_ONCE = 40_000, 1 << 20

_NEAR = "word string, n long, n_near long, form_n long, form string"


def lower_ascii(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("[A-Z]")), F.translate(text, UPPER, LOWER)).otherwise(text)


def spoiled_words(docs: DataFrame, id_col: str, text_col: str, one_in: int = 31, least: int = LEAST_LETTERS) -> DataFrame:
    """(word): the runs of letters of all texts, A-Z lower-cased, of at least ``least`` letters.

    Where ``one_in`` divides the crc32 of ``<id>:<run>``, the run loses its letter at that
    crc32 modulo its length. A null id counts as empty, a null text has no words.
    """
    # shorter runs can't become words, and a run of enough letters is matched whole
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", lower_ascii(F.col("run")).alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return low.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """(key, word, n, l, lo, hi): the block of words that may differ from place ``lo`` to ``hi`` only."""
    tail = F.greatest(F.col("l") - F.col("hi"), F.lit(0))
    agree = [F.substring("word", F.lit(1), F.col("lo")), F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise("")]
    return rows.select(F.xxhash64("l", "lo", "hi", *agree).alias("key"), "word", "n", "l", "lo", "hi")


def blocks(vocabulary: DataFrame, block_words: int = BLOCK_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each word in the blocks of both its halves, for partners of its length and one letter
    more (``l`` is its length) and for those one letter shorter (``l`` is theirs)."""
    size = F.char_length("word")
    lengths = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where("l >= 0")
    zone = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    middle = F.floor(F.col("l") / 2)
    rows = _keyed(lengths.select("*", F.inline(F.array(zone(F.lit(0), middle), zone(middle, F.col("l") + 1)))))
    done = None
    while True:
        hot = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > block_words).select("key"), "hot-blocks")
        n_hot = hot.limit(broadcast_rows + 1).count()
        if not n_hot:
            return rows if done is None else done.unionByName(rows)
        rows = settle(rows, "blocks")
        of = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        wide = F.col("hi") - F.col("lo") > 1
        cold = rows.join(of, "key", "left_anti").unionByName(rows.join(of, "key", "left_semi").where(~wide))
        done = cold if done is None else done.unionByName(cold)
        half = F.floor((F.col("lo") + F.col("hi")) / 2)
        cut = rows.join(of, "key", "left_semi").where(wide)
        rows = _keyed(cut.select("word", "n", "l", F.inline(F.array(zone(F.col("lo"), half), zone(half, F.col("hi"))))))


# ---------------------------------------------------------------- candidates of many words at once

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _letter_numbers(letters: np.ndarray) -> np.ndarray:
    """A scattered 64-bit number for each code point."""
    with np.errstate(over="ignore"):
        x = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class _Words:
    """Words of whole blocks, with sums of their letters' numbers times powers, from which a
    candidate's sum takes a few operations; and the table in which sums are looked up."""

    def __init__(self, words: list[str], keys: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.words, self.keys, self.lo = words, keys, low.astype(np.int64)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.hi = high.astype(np.int64)
        power = np.ones(int(self.size.max(initial=0)) + 2, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.concatenate([power[:1], np.full(len(power) - 1, _BASE, dtype=np.uint64)]), out=power)
            place = np.arange(len(self.letters)) - np.repeat(self.start[:-1], self.size)
            self.power, self.number = power, _letter_numbers(self.letters)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.number * power[place], dtype=np.uint64)])
            self.whole = self.sums[self.start[1:]] - self.sums[self.start[:-1]]
            self.salt = _letter_numbers(keys.view(np.uint64))
        found = self.signs(self.whole, np.arange(len(words)))
        self.order = np.argsort(found, kind="stable")
        self.sorted = found[self.order]
        self.shift = np.uint64(64 - min(24, max(10, int(len(words) * 16).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[(found >> self.shift).astype(np.int64)] = True

    def signs(self, sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums ^ self.salt[rows]) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))

    def before(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.sums[self.start[rows] + places] - self.sums[self.start[rows]]

    def look_up(self, sums: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the candidates stand in the table, the row of the word there)."""
        signs = self.signs(sums, rows)
        at = np.flatnonzero(keep & self.seen[(signs >> self.shift).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.sorted, signs[at]), len(self.sorted) - 1)
        same = self.sorted[found] == signs[at]
        return at[same], self.order[found[same]]

    def equal(self, rows, places, letters, others, step: int) -> np.ndarray:
        """Whether the word of ``others`` is that of ``rows`` edited at its place: a lookup of sums becomes one of
        words. ``step`` is 0 for a replacement, 1 for an insertion, -1 for a deletion."""
        same = (self.size[others] == self.size[rows] + step) & (self.keys[others] == self.keys[rows])
        for p in range(int(self.size[others].max(initial=0))):
            live = np.flatnonzero(same & (self.size[others] > p))
            if not len(live):
                break
            r, at = rows[live], places[live]
            own = p if step == 0 else p - (p > at) if step == 1 else p + (p >= at)
            want = self.letters[np.minimum(self.start[r] + own, len(self.letters) - 1)]
            if step >= 0:
                want = np.where(at == p, letters[live], want)
            same[live] = self.letters[self.start[others[live]] + p] == want
        return same


def _spread(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with each place from ``first`` up to ``last``."""
    n = np.maximum(last - first, 0)
    return np.repeat(rows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def near_rows(words: list[str], keys: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of one block each) in which the second word is an edit of the first within the block's zone."""
    t = _Words(words, keys, low, high)
    alphabet = np.unique(t.letters)
    numbers = _letter_numbers(alphabet)
    rows_at_once = max(1, CANDIDATES_AT_ONCE // max(1, len(alphabet)))
    own, short = np.flatnonzero(t.size == lengths), np.flatnonzero(t.size == lengths + 1)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def settled(rows, places, letters, at, others, step) -> None:
        ok = t.equal(rows, places, letters, others, step)
        pairs.append((rows[ok], others[ok]))

    def slices(rows, places, n):
        return ((rows[i : i + n], places[i : i + n]) for i in range(0, len(rows), n))

    with np.errstate(over="ignore"):
        for step in (0, 1):
            for rows, places in slices(*_spread(own, t.lo[own], np.minimum(t.hi[own], t.size[own] + step)), rows_at_once):
                if step == 0:
                    unlike = t.letters[t.start[rows] + places]
                    rest = t.whole[rows] - t.number[t.start[rows] + places] * t.power[places]
                else:  # not beside its like on the left
                    unlike = np.where(places > 0, t.letters[np.maximum(t.start[rows] + places - 1, 0)], np.uint32(0xFFFFFFFF))
                    front = t.before(rows, places)
                    rest = front + (t.whole[rows] - front) * np.uint64(_BASE)
                sums = rest[:, None] + t.power[places][:, None] * numbers[None, :]
                each = np.repeat(np.arange(len(rows)), len(alphabet))
                at, others = t.look_up(sums.ravel(), rows[each], (alphabet[None, :] != unlike[:, None]).ravel())
                settled(rows[each[at]], places[each[at]], alphabet[at % len(alphabet)], at, others, step)
        for rows, places in slices(*_spread(short, t.lo[short], np.minimum(t.hi[short], t.size[short])), CANDIDATES_AT_ONCE):
            here = t.start[rows] + places
            first = (places == 0) | (t.letters[np.maximum(here - 1, 0)] != t.letters[here])
            front = t.before(rows, places)
            sums = front + (t.whole[rows] - t.before(rows, places + 1)) * np.uint64(_BACK)
            at, others = t.look_up(sums, rows, first)
            settled(rows[at], places[at], None, at, others, -1)
    return tuple(np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))


def _found(table: pa.Table) -> pa.RecordBatch:
    """What whole blocks find: for each row with near words their number and the best of them."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    number = lambda name: table.column(name).to_numpy()
    a, b = near_rows(words, number("key"), number("l"), number("lo"), number("hi"))
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))] = np.arange(len(words))
    by = np.lexsort((rank[b], a))
    rows, first, counts = np.unique(a[by], return_index=True, return_counts=True)
    best = b[by][first]
    made = [[words[i] for i in rows], n[rows], counts, n[best], [words[i] for i in best]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "n_near", "form_n", "form"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; blocks of one word have no partner."""
    enter_worker("spelling")
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK_WORDS:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], side="left"))
            if whole:
                yield from _alone(table.slice(0, whole))
            held = table.slice(whole).to_batches()
    if held:
        yield from _alone(pa.Table.from_batches(held))


def _alone(table: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = table.column("key").to_numpy()
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    if shared.any():
        yield _found(table.filter(pa.array(shared)).combine_chunks())


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms, by doubling steps; a chain's counts grow RATIO times a step, so it is short."""
    state = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = state.select(F.col("word").alias("_via"), F.col("root").alias("_end"))
        if state.join(ends, F.col("root") == F.col("_via"), "left_semi").isEmpty():
            return state
        state = settle(state.join(ends, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_end", "root").alias("root")), "roots")


def spelling_forms(words: DataFrame, *, least_count: int = LEAST_COUNT, ratio: int = RATIO, block_words: int = BLOCK_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct ``words`` (one column ``word``) that occur ``least_count`` times.

    ``n_near`` counts the words one edit away. ``form`` is the one of them with the largest
    count (ties: the first in code-point order), if that is at least ``ratio`` times the
    word's own, else null; ``root`` is the end of the chain of forms. Null words don't count;
    an empty word is one like others; no words give an empty table.
    """
    vocabulary = settle(words.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count), "vocabulary")
    dealt = blocks(vocabulary, block_words, broadcast_rows).repartition("key").sortWithinPartitions("key")
    none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    each = dealt.mapInArrow(_search, _NEAR).unionByName(none)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    near = each.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    fit = -F.col("best.less") >= ratio * F.col("n")
    near = settle(near.select("word", "n", "n_near", F.when(fit, F.col("best.form")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n")), "near-words")
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Forms of all words of ``documents`` with at least 7 letters and 2 occurrences."""
    return spelling_forms(spoiled_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


#: DuckDB has no crc32, so it is worked out from the bytes; near words by shared deletions instead of all edits.
SPELLING_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS step, i AS c FROM range(256) t(i) UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
    SELECT id, run, count(*) AS times, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM (
        SELECT id, translate(run, '{UPPER}', '{LOWER}') AS run FROM (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}')) AS run FROM documents))
    GROUP BY ALL),
marked AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) % 256) + 1], c // 256)), 4294967295)::BIGINT AS h FROM runs, crc),
spoiled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM marked),
vocabulary AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM spoiled WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
    SELECT a.word AS w, b.word AS v, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM cut a JOIN vocabulary v ON a.d = v.word
    UNION SELECT v.word, a.word, a.n FROM cut a JOIN vocabulary v ON a.d = v.word),
counted AS (SELECT w, v, m, count(*) OVER (PARTITION BY w) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY m DESC, v) = 1),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN v END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM vocabulary LEFT JOIN counted ON w = word),
chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
