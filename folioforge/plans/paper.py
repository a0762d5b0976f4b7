"""Allocation: each paper spends 28 distinct facts on four sections.

The choice is sequential by nature: a fact is spent once, stems must differ from all
before, and answers are capped. So papers run side by side, one group each, over
candidates that were worked out before; within a paper the scarcest shape goes first.
A group stays in Arrow: few of its facts are looked at, and only those are read in full.
Every order that looks random is an order by md5 of seed, version and what is ordered.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.errors import GenerationError
from folioforge.functions import romanian as R
from folioforge.tables import small

ITEMS = "paper_id string, version int, section string, ordinal int, question string, options map<string,string>, correct array<string>, left_column array<string>, fact_ids array<string>"
_ARROW_ITEMS = pa.schema([
    ("paper_id", pa.string()), ("version", pa.int32()), ("section", pa.string()), ("ordinal", pa.int32()), ("question", pa.string()), ("options", pa.map_(pa.string(), pa.string())),
    ("correct", pa.list_(pa.string())), ("left_column", pa.list_(pa.string())), ("fact_ids", pa.list_(pa.string())),
])
#: Facts of a group that are held as Python values at a time.
READ_FACTS = 5_000
_MORE = "Adăugați încă un capitol la selecție."


class StemLedger:
    """The word sets of the stems taken so far. Strictly, a stem that shares OVERLAP of the larger
    set with one of them is refused; else only the same set is."""

    def __init__(self) -> None:
        self.taken: list[frozenset[str]] = []

    def claim(self, stem: str, strict: bool = True) -> bool:
        words, limit = R.word_set(stem), L.OVERLAP if strict else 1.0
        if not words or any(len(words & t) >= limit * max(len(words), len(t)) for t in self.taken):
            return False
        self.taken.append(words)
        return True


class Rivals:
    """What is told of whom, by words. A clause that shares OVERLAP of its words with some words told
    has one of its rarest among them, so only those that hold one are looked at."""

    def __init__(self, told: Iterable[tuple[str, frozenset[str]]]) -> None:
        self.by: dict[str, dict[str, list[frozenset[str]]]] = defaultdict(lambda: defaultdict(list))
        self.met: Counter[str] = Counter()
        self.any = False
        for who, words in dict.fromkeys(told):
            self.any = True
            self.met.update(words)
            for w in words:
                self.by[w][who].append(words)

    def unambiguous(self, clause: str, name: str) -> bool:
        """No one else is told of in OVERLAP of the clause's words."""
        own = frozenset(re.findall(r"\w+", clause.lower()))
        least = L.OVERLAP * len(own)
        rare = sorted(own, key=self.met.__getitem__)[: len(own) - math.ceil(least) + 1]
        told = ((who, words) for w in rare if w in self.by for who, words in self.by[w].items())
        return bool(own) and not any(any(len(own & other) >= least for other in words) for who, words in told if not R.same_referent(who, name))


@dataclass(frozen=True, slots=True)
class Candidate:
    """A fact; what it can become is read when it is asked for."""

    id: str
    chapter: tuple[str, int]
    object: str
    quality: bool
    row: int
    facts: Facts

    @property
    def shape(self) -> dict:
        return self.facts.shape(self.row)

    @property
    def statement(self) -> str:
        return self.shape["statement"]

    @property
    def options(self) -> list[str]:
        return self.shape["options"]

    def stem(self, name: str) -> R.Stem | None:
        s = self.shape[name]
        return R.Stem(**s) if s is not None else None

    def blank(self, rivals: Rivals | None) -> R.Stem | None:
        """The first blank that doesn't lead, or leads and can only mean this name."""
        for s in self.shape["blanks"]:
            b = R.Stem(**s)
            if not b.tail or (rivals and rivals.any and rivals.unambiguous(b.tail, self.object)):
                return b
        return None

    def clear_wh(self, rivals: Rivals) -> R.Stem | None:
        s = self.stem("wh")
        return s if s and rivals.unambiguous(s.segment, self.object) else None


class Facts:
    """The facts of a group in corpus order, and what all versions ask of them together."""

    def __init__(self, group: pa.Table) -> None:
        pos = group["pos"].combine_chunks()
        keys = pos.flatten() if pa.types.is_struct(pos.type) else [pos]
        order = pc.sort_indices(pa.table(keys, [str(i) for i in range(len(keys))]), sort_keys=[(str(i), "ascending") for i in range(len(keys))]).to_pylist()
        self.group, self.names = group, [n for n in group.column_names if n not in ("paper_id", "pos", "id", "book", "chapter", "object", "quality")]
        column = {n: group[n].to_pylist() for n in ("id", "book", "chapter", "object", "quality")}
        self.all = [Candidate(column["id"][i], (column["book"][i], column["chapter"][i]), column["object"][i], bool(column["quality"][i]), i, self) for i in order]
        self.quality = [f for f in self.all if f.quality]
        self.objects = list(dict.fromkeys(f.object for f in self.quality))
        self.numerals, self.places = (list(dict.fromkeys(v for held in self._of(n) for v in held)) for n in ("numerals", "places"))
        self.rivals = Rivals((f.object, frozenset(w)) for f, told in zip(self.quality, self._of("rivals"), strict=True) for w in told)
        self.plain_blank, self.has_list = (group[n].to_pylist() for n in ("plain_blank", "has_list"))
        self._clear: dict[int, bool] = {}
        self.shape = lru_cache(maxsize=READ_FACTS)(self._shape)

    def _of(self, name: str) -> Iterator[list]:
        """A column's lists for the quality facts, in corpus order."""
        column, rows = self.group[name], [f.row for f in self.quality]
        for at in range(0, len(rows), READ_FACTS):
            yield from (v or [] for v in column.take(pa.array(rows[at : at + READ_FACTS], pa.int64())).to_pylist())

    def _shape(self, row: int) -> dict:
        held = {n: self.group[n][row].as_py() for n in self.names}
        return held | {n: held[n] or [] for n in ("options", "blanks", "numerals", "places", "list_members")}

    def for_ii(self, f: Candidate) -> bool:
        """Whether section II can ask for a fact by a blank or a question that is clear."""
        if self.plain_blank[f.row]:
            return True
        if f.row not in self._clear:
            self._clear[f.row] = bool(f.clear_wh(self.rivals))
        return self._clear[f.row]


def swap(statement: str, name: str, new: str) -> str:
    """The last whole-word hit replaced."""
    *_, hit = R.whole_word(name).finditer(statement)
    return statement[: hit.start()] + new + statement[hit.end() :]


def replacement(name: str, statement: str, options: Iterable[str], objects: list[str], gendered: bool) -> str | None:
    """Another of ``objects`` for the last hit of ``name``: of one class and gender first, then class,
    gender, any; ``options`` among them go first. ``gendered`` stops after the first."""
    *_, hit = R.whole_word(name).finditer(statement)
    rest = f"{statement[: hit.start()]} {statement[hit.end() :]}"
    lead = (statement[: hit.start()].split() or [""])[-1].lower()
    inside = set(objects)

    def safe(v: str) -> bool:
        doubled = lead in L.DEFINITE_LEAD and v in L.ARTICLED
        return v != L.OBLIQUE_DEITY and not R.same_referent(v, name) and not doubled and not R.mentions(rest, v) and R.compatible(v, name)

    values = [v for v in dict.fromkeys([*(o for o in options if o in inside), *objects]) if safe(v)]
    like = lambda v: (L.swap_class(v) == L.swap_class(name), L.gender(v) == L.gender(name))
    tiers: list[Callable[[str], bool]] = [lambda v: all(like(v)), lambda v: like(v)[0], lambda v: like(v)[1], lambda v: True]
    for tier in tiers[: 1 if gendered else 4]:
        if best := next(filter(tier, values), None):
            return best
    return None


class Paper:
    def __init__(self, facts: Facts, seed: int, version: int, avoid: frozenset[str] = frozenset()):
        self.of, self.all, self.facts, self.seed, self.version, self.avoid = facts, facts.all, facts.quality, seed, version, avoid
        if len(self.facts) < L.QUALITY_ITEMS or len(self.all) < L.TOTAL_ITEMS:
            raise GenerationError(f"Un test complet folosește {L.TOTAL_ITEMS} versete distincte, dintre care {L.QUALITY_ITEMS} cu un nume recunoscut. Selecția are {len(self.all)} versete ({len(self.facts)} cu nume). {_MORE}")
        self.used: set[str] = set()
        self.ledger = StemLedger()
        self.items: list[dict] = []
        self.rivals = facts.rivals
        self.pool = sorted(self._round_robin(), key=lambda f: f.id in avoid)

    # -- orders

    def _key(self, *parts: object) -> str:
        return hashlib.md5("|".join(map(str, (self.seed, self.version, *parts))).encode()).hexdigest()

    def _mixed(self, values: Iterable, salt: object) -> list:
        return sorted(values, key=lambda v: self._key(salt, v))

    def _round_robin(self) -> list[Candidate]:
        by: dict[tuple, list[Candidate]] = {}
        for f in self.facts:
            by.setdefault(f.chapter, []).append(f)
        turn = {f.id: i for own in by.values() for i, f in enumerate(sorted(own, key=lambda f: self._key(f.id)))}
        place = {c: self._key(*c) for c in by}
        return sorted(self.facts, key=lambda f: (turn[f.id], place[f.chapter]))

    def _for_ii(self, wanted: bool) -> Iterator[Candidate]:
        """The pool's facts that section II can ask for, or those that it can't."""
        return (f for f in self.pool if self.of.for_ii(f) == wanted)

    # -- sections

    def _add(self, section: str, question: str, fact_ids: list[str], options: dict | None = None, correct: list[str] | None = None, left: list[str] | None = None) -> None:
        ordinal = 1 + sum(i["section"] == section for i in self.items)
        self.items.append({"section": section, "ordinal": ordinal, "question": question, "options": options, "correct": correct, "left_column": left, "fact_ids": fact_ids})

    def _reserve(self, facts: Callable[[], Iterable[Candidate]], text: Callable[[Candidate], str | None], what: str) -> list[Candidate]:
        got: list[Candidate] = []
        for strict in (True, False):
            for f in itertools.takewhile(lambda _: len(got) < 5, facts()):
                if f.id not in self.used and (t := text(f)) and self.ledger.claim(t, strict):
                    got.append(f)
                    self.used.add(f.id)
        if len(got) < 5:
            raise GenerationError(f"Secțiunea I are nevoie de 5 afirmații {what}, dar selecția a produs doar {len(got)}. {_MORE}")
        return got

    def section_i(self) -> tuple[list[tuple[Candidate, str]], list[Candidate]]:
        """False statements first: whatever can be made false can be true as well."""
        swaps: dict[int, tuple[str, bool] | None] = {}

        def swapped(f: Candidate) -> tuple[str, bool] | None:
            """A false affirmation, and whether the new name is of one class and gender with the old."""
            if f.row not in swaps:
                s, swaps[f.row] = f.shape["concise_named"], None
                if s and f.object != L.OBLIQUE_DEITY:
                    kept = replacement(f.object, s, f.options, self.of.objects, True)
                    if new := kept or replacement(f.object, s, f.options, self.of.objects, False):
                        swaps[f.row] = (swap(s, f.object, new), kept is not None)
            return swaps[f.row]

        def can_be_false() -> Iterator[Candidate]:
            for kept, reserved in itertools.product((True, False), (False, True)):
                yield from (f for f in self._for_ii(reserved) if (s := swapped(f)) and s[1] == kept)

        false = self._reserve(can_be_false, lambda f: f.shape["concise_named"], "false")
        plain = [f for f in self.all if not f.quality]
        true = self._reserve(lambda: itertools.chain(plain, self._for_ii(False), self._for_ii(True)), lambda f: f.shape["concise"], "adevărate")
        return [(f, swapped(f)[0]) for f in false], true

    def _choice(self, stem: str, values: list[str], right: list[str], fact: Candidate, strict: bool) -> bool:
        if R.distinct_referents(values, 3) is None or not self.ledger.claim(stem, strict):
            return False
        options = dict(zip("ABC", self._mixed(values, ("IV", fact.id)), strict=True))
        self._add("IV", stem, [fact.id], options, [k for k, v in options.items() if v in right])
        self.used.add(fact.id)
        return True

    def _list_values(self, fact: Candidate, wanted: int, foreign: dict[str, tuple]) -> tuple[list[str], list[str]] | None:
        own = fact.shape["list_members"]
        right = own[:wanted]
        if len(right) < wanted:
            return None
        registers, kind, size = {R.register(v) for v in right}, R.member_kind(right[0]), sum(len(v.split()) for v in right) / wanted
        alike: dict[str, list[str]] = defaultdict(list)  # by the place where they first stand
        for v, (_, _, its_register, its_kind) in foreign.items():
            if its_register in registers and its_kind == kind and v not in own and not R.mentions(fact.statement, v):
                alike[v.lower()].append(v)
        ranked = sorted(alike.values(), key=lambda same: (abs(len(same[0].split()) - size), max(foreign[v][1] for v in same)))
        near = [same[0] for same in ranked[: 3 - wanted]]
        return (right, right + near) if len(near) == 3 - wanted else None

    def section_iv(self) -> None:
        lists = [f for reserved in (False, True) for f in self._for_ii(reserved) if self.of.has_list[f.row]]
        foreign: dict[str, tuple] = {}  # each member with its first and last place
        for at, v in enumerate(m for f in lists for m in f.shape["list_members"]):
            foreign[v] = (foreign[v][0], at, *foreign[v][2:]) if v in foreign else (at, at, R.register(v), R.member_kind(v))
        count = lambda: sum(i["section"] == "IV" for i in self.items)
        for reserved, strict in ((False, True), (False, False), (True, True), (True, False)):
            for wanted in (3, 2, 1):
                for f in lists:
                    if count() == 3:
                        return
                    if f.id not in self.used and (found := self._list_values(f, wanted, foreign)):
                        self._choice(f.shape["list_stem"], found[1], found[0], f, strict)
            for f in self._for_ii(True) if reserved else ():  # no other fact has a clear stem
                if count() == 3:
                    return
                if f.id in self.used or not (s := f.blank(None) or f.clear_wh(self.rivals)):
                    continue
                others = (o for o in self.of.objects if not R.mentions(s.segment, o) and R.compatible(o, f.object) and o != L.OBLIQUE_DEITY)
                if values := R.distinct_referents(itertools.chain([f.object], others), 3):
                    self._choice(s.stem, values, [f.object], f, strict)
        if count() < 3:
            raise GenerationError("Nu s-au putut construi trei întrebări verificabile pentru Secțiunea IV.")

    def matching_rows(self) -> list[tuple[Candidate, str, str]]:
        rows: list[tuple[Candidate, str, str]] = []
        for deity in (False, True):
            for f in itertools.takewhile(lambda _: len(rows) < 5, self._for_ii(False)):
                names = [r[1] for r in rows]
                if f.id in self.used or f.object in names or (f.object in L.DEITY and not deity) or R.inflects(f.object, names):
                    continue
                if (clause := f.shape["named"]) and clause not in [r[2] for r in rows]:
                    rows.append((f, f.object, clause))
                    self.used.add(f.id)
        return rows

    def section_iii(self, rows: list[tuple[Candidate, str, str]]) -> None:
        for shape in ("halves", "named"):
            for f in itertools.takewhile(lambda _: len(rows) < 5, self.pool):
                if f.id in self.used:
                    continue
                left, right = (f.shape["left"], f.shape["right"]) if shape == "halves" else (f.object, f.shape["named"])
                if not left or not right:
                    continue
                if left.lower() in {r[1].lower() for r in rows} or right in [r[2] for r in rows] or (shape == "named" and R.inflects(left, [r[1] for r in rows])):
                    continue
                rows.append((f, left, right))
                self.used.add(f.id)
        if len(rows) < 5:
            raise GenerationError(f"Secțiunea III are nevoie de 5 asocieri, dar selecția a produs doar {len(rows)}. {_MORE}")
        column = dict(zip("ABCDE", self._mixed([r[2] for r in rows], "III"), strict=True))
        letter = {v: k for k, v in column.items()}
        self._add("III", "", [r[0].id for r in rows], column, [letter[r[2]] for r in rows], [r[1] for r in rows])

    def _available(self, shape: str, f: Candidate, answer: str) -> Iterable[str]:
        if shape == "numeral":
            value, seen = L.NUMERALS[answer], set()
            for v in dict.fromkeys([*self.of.numerals, *L.FALLBACK_NUMERALS]):
                if L.NUMERALS[v] != value and L.NUMERALS[v] not in seen:
                    seen.add(L.NUMERALS[v])
                    yield v
        elif shape == "place":
            yield from (p for p in self.of.places if p != answer)
        else:
            yield from itertools.chain(f.options, self.of.objects)

    def section_ii(self) -> None:
        """Least used shape first; siblings' facts are put off, then caps and likeness are eased."""
        letters = [("ABC" * 4)[i] for i in range(10)]
        letters = [letters[i] for i in self._mixed(range(10), "letters")]
        answers: Counter[str] = Counter()
        shapes = dict.fromkeys(("blank", "wh", "place", "numeral"), 0)
        low, high = L.ANSWER_CAPS
        made = 0
        for skip in (True, False):
            for cap, strict in ((low, True), (high, True), (high, False)):
                for f in self.pool:
                    if made == 10:
                        return
                    if f.id in self.used or (skip and f.id in self.avoid):
                        continue
                    for shape in sorted(shapes, key=shapes.__getitem__):
                        s = f.blank(self.rivals) if shape == "blank" else f.clear_wh(self.rivals) if shape == "wh" else f.stem(shape)
                        if not s or answers[s.answer] >= cap:
                            continue
                        others = (v for v in self._available(shape, f, s.answer) if v != L.OBLIQUE_DEITY and not R.mentions(s.segment, v) and R.compatible(v, s.answer))
                        values = R.distinct_referents(itertools.chain([s.answer], others), 3)
                        if values is None or not self.ledger.claim(s.stem, strict):
                            continue
                        wrong = self._mixed(values[1:], ("II", f.id))
                        wrong.insert("ABC".index(letters[made]), s.answer)
                        self._add("II", s.stem, [f.id], dict(zip("ABC", wrong, strict=True)), [letters[made]])
                        self.used.add(f.id)
                        answers[s.answer] += 1
                        shapes[shape] += 1
                        made += 1
                        break
        if made < 10:
            raise GenerationError(f"Secțiunea II are nevoie de 10 întrebări, dar selecția a produs doar {made}. {_MORE}")

    def build(self) -> list[dict]:
        false, true = self.section_i()
        self.section_iv()
        rows = self.matching_rows()
        self.section_ii()
        self.section_iii(rows)
        marks, salt = [True] * 5 + [False] * 5, 0
        while salt == 0 or len(set(marks[::2])) == 1:  # never strictly in turn
            marks, salt = [i < 5 for i in self._mixed(range(10), ("I", salt))], salt + 1
        for mark in marks:
            f, text = (true.pop(0), None) if mark else false.pop(0)
            self._add("I", text or f.shape["concise"], [f.id], None, ["A" if mark else "F"])
        return self.items


def build_versions(facts: Facts, seed: int, first: int, count: int) -> Iterator[tuple[int, list[dict]]]:
    """Each version is told what the ones before have spent."""
    spent: frozenset[str] = frozenset()
    for version in range(first, first + count):
        items = Paper(facts, seed, version, spent).build()
        spent |= {i for item in items for i in item["fact_ids"]}
        yield version, items


def papers(facts: DataFrame, selections: DataFrame, seed: int = 12345, first: int = 1, versions: int = 1) -> DataFrame:
    """Items of every paper. ``facts`` have candidates; ``selections`` are (paper_id, book, chapter).

    A paper that can't be filled has one row of section ``error`` with the reason, so that
    one thin selection doesn't stop the others. A paper's facts stay in Arrow in one task;
    beside their order, and rivals' words, Python holds those that it comes to.
    """
    from folioforge.operators.candidates import NAMES

    used = facts.select(
        "pos", "id", F.col("evidence.book").alias("book"), F.col("evidence.chapter").alias("chapter"), "object", "quality", "statement", "options", *NAMES,
        F.coalesce(F.exists("blanks", lambda b: F.coalesce(b["tail"], F.lit("")) == ""), F.lit(False)).alias("plain_blank"), F.coalesce(F.col("list_stem") != "", F.lit(False)).alias("has_list"),
    )
    chosen = used.join(small(selections.select("paper_id", "book", "chapter").distinct()), ["book", "chapter"])

    def allocate(key: tuple, group: pa.Table) -> pa.Table:
        rows, paper = [], key[0].as_py()
        try:
            for version, items in build_versions(Facts(group), seed, first, versions):
                rows += [{"paper_id": paper, "version": version, **i, "options": i["options"] and list(i["options"].items())} for i in items]
        except GenerationError as e:
            rows.append({"paper_id": paper, "version": len({r["version"] for r in rows}) + first, "section": "error", "ordinal": 0, "question": str(e), "options": None, "correct": None, "left_column": None, "fact_ids": []})
        return pa.Table.from_pylist(rows, _ARROW_ITEMS)

    return chosen.groupBy("paper_id").applyInArrow(allocate, ITEMS)
