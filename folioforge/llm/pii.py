"""Personal data: exact base spans, and further ones by boosted trees over candidates.

DataFrame functions alone touch the rows. Generators propose overlapping spans with
recall in mind. Three kinds of evidence that don't depend on one another vote on each
candidate: its form once written out plainly, the words before it, and a second generator
or measure of its kind. Two votes make a weak label, so that obfuscated addresses, local
numbers, misread cards and secrets can be positive although no base rule holds. Trees are
fitted on the table of all distinct feature rows of all candidates, each also with one kind
of evidence masked; each kind's threshold is calibrated on the documents of another fold.
A small table is summed on the driver, a large one by Spark, with the same trees. The trees
become a column expression that selects spans to add; base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import plain_name, settle

#: The kinds of base spans, then that which only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
#: The base patterns, written so that no search looks twice at the same run: a match
#: begins at a run's start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = (EMAIL, IP, CARD, PHONE)
#: A text without these has no match of the pattern.
NEEDS: tuple[Callable[[Column], Column], ...] = (
    lambda t: F.contains(t, F.lit("@")),
    lambda t: t.rlike(r"[0-9]\.[0-9]"),
    lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    lambda t: F.contains(t, F.lit("+")),
)
#: A secret's name and sign, which aren't part of its span.
NAMED = r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private)?[_-]?key)s?[\"']?\x20?[=:]\x20?[\"']?"
#: Generators: (kind, pattern). They overlap with one another and with the base.
GENERATORS = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]++)++"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20?(?:@|[(\[{]at[)\]}])|\x20at(?=\x20[a-z0-9-]++\x20dot\x20))\x20?(?:[a-z0-9-]+(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20))+(?:com|org|net|edu|info|[a-z]{2})(?![a-z0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9.]*[0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\[?\.\]?[0-9]{1,3}\[?\.\]?[0-9]{1,3}\[?\.\]?[0-9]{1,3}(?![0-9.]*[0-9])"),
    ("card", r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{2,6}){2,5}(?![0-9])"),
    ("card", r"(?<![0-9.])[3-6][0-9]{3}(?:[\x20./-][0-9]{4}){2,3}(?:[\x20./-][0-9]{1,3})?(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+/.-])(?:\([0-9]{2,4}\)|00[0-9]{2,3}|0[0-9]{2,4}|[2-9][0-9]{2})[\x20.-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9/])"),
    ("secret", NAMED + r"[^\s\"',;]{6,256}"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+=*"),
)
#: A text without a match of this has no candidate.
ANY_SIGN = (
    r"@|[0-9][0-9\x20().,/+\[\]-]{5,}[0-9]|(?i:[(\[{]at[)\]}]|\x20at\x20[a-z0-9-]++\x20dot\x20)"
    r"|[0-9][A-Za-z_/+-]|[A-Za-z_/+-][0-9]|(?i:(?:pass|pwd|secret|token|credential|key)[a-z]{0,8}[\"']?\x20?[=:])"
)
#: Words near a candidate that speak for its kind, in 32 characters before it.
CUES = {
    "email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|addr|server", "card": r"(?i)card|visa|account|iban|pay", "phone": r"(?i)phone|tel|call|mobile|fax",
    "secret": r"(?i)(?:pass|pwd|secret|token|credential|key)[a-z]{0,8}[\"']?\s?[=:]?\s?[\"']?$",
}
CONTEXT = 32
#: The three last are the evidence, each masked in turn; MASK stands for a masked one.
FEATURES = ("kind", "digits", "separators", "letters", "width", "before", "after", "head", "tail", "written", "form", "cue", "second")
VIEWS, MASK = (None, 10, 11, 12), -1
#: Fitting: distinct feature rows up to which the driver sums them (more are summed by Spark),
#: rounds, depth, rate, and the precision that a kind's threshold must reach on the other fold.
DRIVER_ROWS, ROUNDS, DEPTH, RATE, PRECISION = 80_000, 24, 3, 0.3, 0.97
#: Scores and gradients are whole numbers of 1 / UNIT, so that a sum is the same in any order; scores with the same
#: upper bits are a bin of at most 1 << BIN_BITS different ones.
UNIT_BITS, BIN_BITS = 20, 14
UNIT = 1 << UNIT_BITS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(lens: Column, block: int = 32) -> Column:
    """For each element the sum of those before it, by blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), lambda b: total(F.slice(lens, b * block + 1, F.lit(block))))
    return let(
        blocks,
        lambda s: let(
            F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))),
            lambda before: F.transform(
                lens,
                lambda _, i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(lens, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        ),
    )


def found(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, match) of all matches, in code points."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(v: Column) -> Column:
        lens = F.transform(v["hits"], lambda m, i: F.char_length(m) + F.char_length(F.get(v["gaps"], i)))
        at = let(lens, lambda x: _sums_before(x))
        return let(
            at,
            lambda a: F.transform(
                v["hits"],
                lambda m, i: let(
                    F.get(a, i) + F.char_length(F.get(v["gaps"], i)),
                    lambda s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(m)).alias("end"), m.alias("match")),
                ),
            ),
        )

    return let(both, lambda v: F.when(F.size(v["hits"]) > 0, place(v)).otherwise(none))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = (F.char_length(digits) - i) % 2 == 1
        return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _parts_fit(match: Column, separators: str = r"\.") -> Column:
    def fits(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.char_length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(match, separators), fits)


def _valid(kind: int, match: Column) -> Column:
    n = F.char_length(_digits(match))
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return _parts_fit(match)
    if kind == 2:
        return F.when(n.between(14, 19), let(_digits(match), luhn)).otherwise(F.lit(False))
    return n.between(10, 15)


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, by start and then kind; leftmost non-overlapping in each kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def of(kind: int) -> Column:
        return F.when(NEEDS[kind](text), F.filter(found(text, BASE[kind], kind), lambda s: _valid(kind, s["match"]))).otherwise(none)

    return F.array_sort(F.concat(*map(of, range(BASE_KINDS))))


def _class_of(c: Column) -> Column:
    """0 no character or blank, 1 digit, 2 letter, 3 other."""
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike("[0-9]"), 1).when(c.rlike(r"\p{L}"), 2).otherwise(3)


def _proposed(text: Column) -> Column:
    """Spans (start, kind, end, match, generator) of all generators."""

    def of(g: int) -> Column:
        kind, pattern = GENERATORS[g]
        # a secret's name is cut off, so that the span is its value
        lead = (lambda m: F.char_length(F.regexp_extract(m, "^" + NAMED, 0))) if pattern.startswith(NAMED) else (lambda m: F.lit(0))
        return F.transform(
            found(text, pattern, KINDS.index(kind)),
            lambda s: let(
                lead(s["match"]),
                lambda n: F.struct((s["start"] + n).alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.substring(s["match"], n + 1, F.char_length(s["match"])).alias("match"), F.lit(g).alias("by")),
            ),
        )

    return F.concat(*map(of, range(len(GENERATORS))))


def _plain(m: Column, kind: Column) -> Column:
    """The match with its obfuscation undone."""
    email = F.regexp_replace(F.regexp_replace(m, r"(?i)\x20?[(\[{]at[)\]}]\x20?|\x20at\x20", "@"), r"(?i)\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\x20?\.\x20?", ".")
    return F.when(kind == 0, F.replace(email, F.lit(" "), F.lit(""))).when(kind == 1, F.regexp_replace(m, r"[^0-9]+", ".")).otherwise(m)


def _in_form(plain: Column, kind: Column, d: Column) -> Column:
    """Whether the plain form is what such data looks like."""
    n = F.char_length(d)
    grouped = plain.rlike(r"^(?:\+|00|\(|0)") | plain.rlike(r"^[2-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
    slug = plain.rlike("[a-z]{7}") | (plain.rlike("[-_/+]") & ~plain.rlike("[A-Z]"))
    return (
        F.when(kind == 0, plain.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"))
        .when(kind == 1, _parts_fit(plain) & ~plain.rlike(r"^0"))
        .when(kind == 2, F.when(n.between(13, 19), luhn(d)).otherwise(F.lit(False)))
        .when(kind == 3, n.between(7, 15) & grouped)
        .otherwise(plain.rlike("[0-9].*[0-9]") & plain.rlike("[A-Za-z].*[A-Za-z]") & ~slug)
    )


def candidates(text: Column) -> Column:
    """Spans with features, the weak label that two votes of three make among them last."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string,by:int>>")

    def describe(s: Column) -> Column:
        m, kind, d = s["match"], s["kind"], _digits(s["match"])
        plain = _plain(m, kind)
        before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        context = F.substring(text, start + 1, s["start"] - start)
        cue = F.lit(False)
        for k, name in enumerate(KINDS):
            cue = F.when(kind == k, context.rlike(CUES[name])).otherwise(cue)
        agrees = F.lit(False)
        for g in range(len(GENERATORS) - 2):  # those come in pairs of one kind
            agrees = F.when(s["by"] == g, m.rlike(GENERATORS[g ^ 1][1])).otherwise(agrees)
        mixed = (F.char_length(m) >= 16) & (F.size(F.array_distinct(F.split(m, ""))) >= 9)
        second = F.when(kind == 4, mixed).otherwise(agrees)
        form = _in_form(plain, kind, d)
        votes = form.cast("int") + cue.cast("int") + second.cast("int")
        return F.struct(
            s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"),
            F.array(
                kind, F.least(F.char_length(d), F.lit(20)), F.least(F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(6)),
                m.rlike("[A-Za-z]").cast("int"), F.least(F.char_length(m) / 4, F.lit(10)).cast("int"), _class_of(before),
                _class_of(F.substring(text, s["end"] + 1, F.lit(1))),
                F.least(F.char_length(F.regexp_extract(m, "^[^0-9]*([0-9]*)", 1)), F.lit(6)), F.least(F.char_length(F.regexp_extract(m, "([0-9]*)$", 1)), F.lit(6)),
                (plain == m).cast("int"), form.cast("int"), cue.cast("int"), second.cast("int"),
            ).alias("features"),
            (votes >= 2).cast("int").alias("label"),
        )

    return F.when(text.rlike(ANY_SIGN), F.transform(_proposed(text), describe)).otherwise(F.transform(none, describe))


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """start + the leaves, in units of 1 / UNIT; a tree is (feature, cut, left, right), a leaf is a number."""

    start: int
    trees: list
    thresholds: dict[int, int]

    def score(self, x: list[int]) -> int:
        return self.start + sum(_leaf(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        def walk(t) -> Column:
            return F.when(F.get(x, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3])) if isinstance(t, tuple) else F.lit(t).cast("long")

        total = F.lit(self.start).cast("long")
        for t in self.trees:
            total = total + walk(t)
        return total


def _leaf(t, x) -> int:
    while isinstance(t, tuple):
        t = t[2] if x[t[0]] <= t[1] else t[3]
    return t


class HeldRows:
    """Feature rows (fold, view, x, p, n) summed on the driver: fold 0 fits, whole rows of fold 1 judge."""

    def __init__(self, rows: list):
        self.fit = [(tuple(r["x"]), r["p"], r["n"]) for r in rows if r["fold"] == 0]
        self.judge = [(tuple(r["x"]), r["p"], r["n"]) for r in rows if r["fold"] == 1 and r["view"] == 0]

    def totals(self) -> tuple[int, int]:
        return sum(r[1] for r in self.fit), sum(r[2] for r in self.fit)

    def begin(self, model: Trees) -> None:
        """A round's gradients and curvatures."""
        self.at = [s + _leaf(model.trees[-1], r[0]) for s, r in zip(self.at, self.fit, strict=True)] if model.trees else [model.start] * len(self.fit)
        self.slopes = []
        for (_, p, n), s in zip(self.fit, self.at, strict=True):
            q = math.floor(UNIT / (1 + math.exp(-s / UNIT)) + 0.5)
            self.slopes.append((p * UNIT - n * q, n * (q * (UNIT - q) >> UNIT_BITS)))

    def sums(self, splits: dict, nodes: list[int]) -> dict:
        """{node: {feature: {value: (gradient, curvature)}}}; the children of a split node k are 2k and 2k + 1."""
        out: dict = {k: {f: {} for f in range(len(FEATURES))} for k in nodes}
        for (x, _, _), (g, h) in zip(self.fit, self.slopes, strict=True):
            k = 1
            while k in splits:
                k = 2 * k + (x[splits[k][0]] > splits[k][1])
            for f, by in out.get(k, {}).items():
                a, b = by.get(x[f], (0, 0))
                by[x[f]] = (a + g, b + h)
        return out

    def thresholds(self, model: Trees) -> dict[int, int]:
        found: dict[int, int] = {}
        for kind in range(len(KINDS)):
            by: dict[int, list[int]] = {}
            for x, p, n in self.judge:
                if x[0] == kind:
                    own = by.setdefault(model.score(x), [0, 0])
                    own[0] += p
                    own[1] += n
            good = every = 0
            for s in sorted(by, reverse=True):
                good, every = good + by[s][0], every + by[s][1]
                if good >= PRECISION * every:
                    found[kind] = s
        return found


class SpreadRows:
    """The same over a table of any number of feature rows; only sums by node, feature and value reach the driver."""

    def __init__(self, table: DataFrame):
        self.fit = table.where("fold = 0").select("x", "p", "n")
        self.judge = table.where("fold = 1 AND view = 0").select("x", "p", "n")

    def totals(self) -> tuple[int, int]:
        r = self.fit.agg(F.sum("p"), F.sum("n")).first()
        return r[0] or 0, r[1] or 0

    def begin(self, model: Trees) -> None:
        at = self.fit.withColumn("s", model.column(F.col("x")))
        q = at.withColumn("q", F.floor(F.lit(UNIT) / (1 + F.exp(-F.col("s") / UNIT)) + 0.5))
        curve = F.shiftright(F.col("q") * (F.lit(UNIT) - F.col("q")), UNIT_BITS)
        self.slopes = q.select("x", (F.col("p") * UNIT - F.col("n") * F.col("q")).alias("g"), (F.col("n") * curve).alias("h"))

    def sums(self, splits: dict, nodes: list[int]) -> dict:
        def node(k: int) -> Column:
            return F.when(F.get("x", F.lit(splits[k][0])) <= splits[k][1], node(2 * k)).otherwise(node(2 * k + 1)) if k in splits else F.lit(k)

        each = self.slopes.withColumn("node", node(1)).where(F.col("node").isin(*nodes)).select("node", "g", "h", F.posexplode("x").alias("f", "v"))
        out: dict = {k: {f: {} for f in range(len(FEATURES))} for k in nodes}
        for r in each.groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r["node"]][r["f"]][r["v"]] = (r["g"], r["h"])
        return out

    def thresholds(self, model: Trees) -> dict[int, int]:
        each = self.judge.select(F.get("x", F.lit(0)).alias("kind"), model.column(F.col("x")).alias("s"), "p", "n")
        each = each.groupBy("kind", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("bin", F.shiftright("s", BIN_BITS))
        higher = Window.partitionBy("kind").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        bins = each.groupBy("kind", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        above = bins.select("kind", "bin", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_above") for c in "pn"])
        inside = Window.partitionBy("kind", "bin").orderBy(F.desc("s"))
        upto = each.select("kind", "bin", "s", *[F.sum(c).over(inside).alias(c) for c in "pn"]).join(above, ["kind", "bin"])
        good = upto.where(F.col("p") + F.col("p_above") >= PRECISION * (F.col("n") + F.col("n_above")))
        return {r["kind"]: r["s"] for r in good.groupBy("kind").agg(F.min("s").alias("s")).collect()}


def _best(by_feature: dict) -> tuple | None:
    """(feature, cut, sums on the left, sums on the right) of most gain."""
    value = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + 1)
    g, h = (sum(s[i] for s in by_feature[0].values()) for i in (0, 1))
    most, best = 1e-6, None
    for f, by in by_feature.items():
        left = (0, 0)
        for cut in sorted(by)[:-1]:
            left = (left[0] + by[cut][0], left[1] + by[cut][1])
            right = (g - left[0], h - left[1])
            gain = value(*left) + value(*right) - value(g, h)
            if gain > most:
                most, best = gain, (f, cut, left, right)
    return best


def _grow(rows: HeldRows | SpreadRows):
    """A tree level by level: a pass over the rows for each."""
    splits: dict = {}
    ends: dict = {}
    nodes = [1]
    for _ in range(DEPTH):
        table, nodes, before = rows.sums(splits, nodes), [], nodes
        for k in before:
            ends.setdefault(k, tuple(sum(s[i] for s in table[k][0].values()) for i in (0, 1)))
            if best := _best(table[k]):
                splits[k], ends[2 * k], ends[2 * k + 1] = best[:2], *best[2:]
                nodes += [2 * k, 2 * k + 1]
        if not nodes:
            break

    def tree(k: int):
        g, h = ends[k]
        return (*splits[k], tree(2 * k), tree(2 * k + 1)) if k in splits else round(RATE * g / (h / UNIT + 1))

    return tree(1)


def boost(rows: HeldRows | SpreadRows) -> Trees:
    """Logistic boosting of trees over all rows, then each kind's lowest score from which PRECISION
    holds on the other fold; without one, the kind adds nothing."""
    p, n = rows.totals()
    model = Trees(round(UNIT * math.log((p + 1) / (n - p + 1))), [], {})
    for _ in range(ROUNDS if 0 < p < n else 0):
        rows.begin(model)
        model.trees.append(_grow(rows))
    model.thresholds = rows.thresholds(model)
    return model


def _views(c: Column) -> Column:
    """A candidate's feature row as it is, and with each kind of evidence masked in turn."""
    masked = lambda at: F.transform(c["features"], lambda x, i: F.when(i == at, F.lit(MASK)).otherwise(x))
    return F.array(*[F.struct(F.lit(v).alias("view"), (c["features"] if at is None else masked(at)).alias("x"), c["label"].alias("label")) for v, at in enumerate(VIEWS)])


def feature_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(fold, view, x, p, n): all distinct feature rows of all candidates of all rows; n counts
    the candidates, p those of positive label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(2))
    each = df.select(fold.alias("fold"), F.explode(candidates(text)).alias("c"))
    # equal candidates are summed before their masked views are made
    own = each.groupBy("fold", "c.features", "c.label").agg(F.count(F.lit(1)).alias("n"))
    views = own.select("fold", "n", F.explode(_views(F.struct("features", "label"))).alias("v"))
    return views.groupBy("fold", "v.view", "v.x").agg(F.sum(F.col("n") * F.col("v.label")).alias("p"), F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Trees:
    """Trees from the candidates of one fold, in all views; thresholds from the whole features of the other."""
    table = settle(feature_rows(df, text_col, id_col), "feature-rows")
    return boost(HeldRows(table.collect()) if table.count() <= DRIVER_ROWS else SpreadRows(table))


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Trees | None = None) -> DataFrame:
    """``df`` with base and spans: arrays of (start, kind, end), sorted.

    spans holds base and each candidate over its kind's threshold that lies in no base
    span and overlaps no accepted one before it (the longer of two that begin together).
    Null and empty text have none, and so has an empty table. Rows are taken one by one, so
    repeated rows come out alike and long texts need no other. Other columns stay, but for
    ones named base or spans, which are replaced.
    """
    model = model or fit(df, text_col, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    own, extra = (plain_name(df, n) for n in ("_base", "_added"))
    out = df.withColumn(own, F.transform(base_spans(text), bare))
    if model.thresholds:
        high = lambda c: let(
            c["kind"], lambda k: model.column(c["features"]) >= F.element_at(F.create_map(*[F.lit(v) for pair in model.thresholds.items() for v in pair]), k)
        )
        chosen = F.filter(candidates(text), lambda c: c["kind"].isin(*model.thresholds) & high(c))
        # base spans and candidates by start, base first, the longer first: one pass decides
        mark = lambda s, tag: F.struct(s["start"].alias("start"), F.lit(tag).alias("tag"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))
        ordered = F.array_sort(F.concat(F.transform(F.col(own), lambda s: mark(s, 0)), F.transform(chosen, lambda c: mark(c, 1))))
        span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), (-c["minus"]).alias("end"))

        def step(acc: Column, c: Column) -> Column:
            end = -c["minus"]
            free = (c["tag"] == 1) & (end > acc["base"]) & (c["start"] >= acc["last"])
            return F.struct(
                F.when(c["tag"] == 0, F.greatest(acc["base"], end)).otherwise(acc["base"]).alias("base"), F.when(free, end).otherwise(acc["last"]).alias("last"),
                F.when(free, F.concat(acc["spans"], F.array(span(c)))).otherwise(acc["spans"]).alias("spans"),
            )

        start = F.struct(F.lit(0).alias("base"), F.lit(0).alias("last"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))
        added = F.aggregate(ordered, start, step, lambda acc: acc["spans"])
        out = out.withColumn(extra, added)
        spans = F.array_sort(F.concat(F.col(own), F.col(extra)))
    else:
        spans = F.col(own)
    return out.withColumn("spans", spans).withColumn("base", F.col(own)).drop(own, extra)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with their base spans, counted and digested, and all spans found."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [number("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])]
    more = [number("spans", BASE_KINDS).alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *more)
