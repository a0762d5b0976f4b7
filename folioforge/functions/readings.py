"""Readings of sentences that lean on word classes, as columns.

A text is an array of tokens, each with its word, the word in lower case and the gap before
it. Word classes come from a lexicon, so that another language brings its own. Whether an
object is spelled out is an automaton's state after all tokens; what depends on neighbours
looks at pairs of tokens; clauses and lists are read by patterns.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.functions import text as X
from folioforge.functions.automaton import Automaton

_TOKEN = r"(?U)(\W*)(\w+)"
_QUOTATION = r"(?:„[^\"”]*[\"”]|«[^»]*»|\"[^\"]*\")"
_SAID = rf"(?U)^([^,;:.!?]*:\s*{_QUOTATION}[.!?]?)"
_TOLD = r"^[^,;:.!?]*"
_SPEECH = r"(?U)^[^,;:.!?]*:\s*[„«\"]"
_JOIN, _AND = r"(?:\s*,\s*|\s+(?:și|sau)\s+)", r"\s+(?:și|sau)\s+"
_NUMERAL = r"(?U)(?<!\w)(" + "|".join(sorted(L.NUMERALS, key=len, reverse=True)) + r")(?!\w)"
_HYPHEN, _BLANK, _OTHER = range(3)
_NO_TOKENS = "array<struct<word:string,low:string,gap:string>>"


@dataclass(frozen=True)
class Lexicon:
    """The word classes that readings ask for; endings are patterns of a word's end."""

    free_clitics: tuple[str, ...] = tuple(L.FREE_CLITICS)
    object_clitics: tuple[tuple[str, tuple[str, ...]], ...] = tuple((k, tuple(v)) for k, v in L.OBJECT_CLITICS.items())
    verbal_clitic: str = "o"
    patient_marker: str = "pe"
    dative_article: str = "lui"
    dative: str = L.DATIVE
    articled: str = L.ARTICLED_ENDING
    auxiliaries: tuple[str, ...] = tuple(L.AUXILIARIES)
    verb_endings: tuple[str, ...] = tuple(L.VERB_ENDINGS)
    before_noun: tuple[str, ...] = tuple(L.DEMONSTRATIVES_BEFORE)
    after_noun: tuple[str, ...] = tuple(L.DEMONSTRATIVES_AFTER)
    no_noun: tuple[str, ...] = tuple(L.NOT_NOUNS + L.PREPOSITIONS + L.VERB_OPENERS + L.SUBORDINATE + L.LINKERS + L.DETERMINERS + L.TEMPORAL)
    names: tuple[str, ...] = tuple(L.QUALITY_TERMS)
    edges: tuple[str, ...] = tuple(L.OBLIQUE_MARKERS + L.SUBORDINATE + L.LINKERS)
    oblique: tuple[str, ...] = tuple(L.OBLIQUE_MARKERS)
    #: Words by which the automaton goes; all others are told apart by their endings.
    known: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        words = [self.verbal_clitic, self.patient_marker, self.dative_article, *self.free_clitics]
        words += [w for host, bound in self.object_clitics for w in (host, *bound)]
        object.__setattr__(self, "known", tuple(dict.fromkeys(words)))

    def ends(self, word: str) -> tuple[bool, bool, bool]:
        """(dative, articled, verbal) of a word in lower case."""
        verbal = word in self.auxiliaries or word.endswith(self.verb_endings)
        return re.fullmatch(self.dative, word) is not None, re.search(f"(?:{self.articled})$", word) is not None, verbal

    @cached_property
    def patient_automaton(self) -> Automaton:
        """Accepts tokens with an object clitic of which no object is spelled out.

        A state is what was before and whether a clitic was met; an object ends the reading.
        """
        endings = list(itertools.product((False, True), repeat=3))
        per_gap = len(self.known) + len(endings)
        bound = dict(self.object_clitics)

        def step(state, c: int):
            if state == "object":
                return state
            before, articled, clitic = state
            gap, kind = divmod(c, per_gap)
            word = self.known[kind] if kind < len(self.known) else ""
            dative, with_article, verbal = self.ends(word) if word else endings[kind - len(self.known)]
            blank = gap == _BLANK
            if (before in (self.patient_marker, self.dative_article) and blank) or (dative and not articled):
                return "object"
            free = word in self.free_clitics or (before == self.verbal_clitic and blank and verbal)
            clitic = clitic or free or (gap == _HYPHEN and word in bound.get(before, ()))
            owned = word == self.dative_article and articled  # the noun before it has what it gives
            return "" if owned else word, with_article, clitic

        return Automaton(("", False, False), 3 * per_gap, step, lambda s: s != "object" and s[2])


ROMANIAN = Lexicon()


def tokens(text: Column) -> Column:
    """Words with their gaps; a null text has none."""
    part = lambda i: F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(i))
    pairs = F.zip_with(part(1), part(2), lambda gap, word: F.struct(word.alias("word"), F.lower(word).alias("low"), gap.alias("gap")))
    return F.coalesce(pairs, F.array().cast(_NO_TOKENS))


def _any_of(value: Column, words) -> Column:
    return value.isin(*words) if words else F.lit(False)


def blank_gap(token: Column) -> Column:
    return (token["gap"] == " ") | (X.strip(token["gap"]) == "")  # one blank is the usual case


def pairs(tokens: Column) -> Column:
    """(a, b) of each token with the next one, if blanks alone part them."""
    rest = lambda t, i: F.slice(t, F.lit(i), F.greatest(F.size(t) - 1, F.lit(0)))
    each = X.let(tokens, lambda t: F.zip_with(rest(t, 1), rest(t, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.filter(each, lambda p: blank_gap(p["b"]))


def patient_missing(tokens: Column, lex: Lexicon = ROMANIAN) -> Column:
    """An object clitic without an object that is named, by the lexicon's automaton."""
    flag = lambda condition, n: F.when(condition, n).otherwise(0)

    def kind(t: Column) -> Column:
        low = t["low"]
        verbal = "|".join(lex.verb_endings)
        flags = flag(F.regexp_like(low, F.lit(f"(?U)^(?:{lex.dative})$")), 4) + flag(F.regexp_like(low, F.lit(f"(?:{lex.articled})$")), 2)
        flags += flag(_any_of(low, lex.auxiliaries) | F.regexp_like(low, F.lit(f"(?:{verbal})$")), 1)
        none = ~F.regexp_like(low, F.lit(f"(?U)(?:{lex.dative}|{lex.articled}|{verbal})$")) & ~_any_of(low, lex.auxiliaries)
        ends = F.when(none, 0).otherwise(flags)  # most words have no such end, and one pattern says so
        known = F.create_map(*[F.lit(x) for i, w in enumerate(lex.known) for x in (w, i)])
        word = F.coalesce(F.try_element_at(known, low), ends + len(lex.known))
        gap = F.when(t["gap"] == "-", _HYPHEN).when(blank_gap(t), _BLANK).otherwise(_OTHER)
        return gap * (len(lex.known) + 8) + word

    return lex.patient_automaton.run(F.transform(tokens, kind))


def named_nouns(tokens: Column, lex: Lexicon = ROMANIAN) -> Column:
    """Words in lower case that a capitalised one follows, with the dative article between them or not."""

    def named(t: Column, i: Column) -> Column:
        b, c = F.get(t, i + 1), F.get(t, i + 2)
        through = (b["low"] == lex.dative_article) & (i + 2 < F.size(t)) & blank_gap(c)
        return blank_gap(b) & X.starts_upper(F.when(through, c["word"]).otherwise(b["word"]))

    def read(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 2)
        return F.when(F.size(t) > 1, F.transform(F.filter(places, lambda i: named(t, i)), lambda i: F.get(t, i)["low"])).otherwise(F.array().cast("array<string>"))

    return X.let(tokens, read)  # else each place would split the text anew


def pointed_nouns(tokens: Column, lex: Lexicon = ROMANIAN) -> Column:
    """Nouns in lower case beside a demonstrative, but for names and words that are no nouns."""

    def beside(near: Column) -> Column:
        return F.concat(
            F.transform(F.filter(near, lambda p: _any_of(p["a"]["low"], lex.before_noun)), lambda p: p["b"]),
            F.transform(F.filter(near, lambda p: _any_of(p["b"]["low"], lex.after_noun)), lambda p: p["a"]),
        )

    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))
    noun = lambda t: ~_any_of(t["low"], lex.no_noun) & ~_any_of(t["word"], lex.names) & ~_any_of(capital(t["word"]), lex.names)
    return F.transform(F.filter(X.let(pairs(tokens), beside), noun), lambda t: t["low"])


def points_outside(tokens: Column, named: Column, lex: Lexicon = ROMANIAN) -> Column:
    """A demonstrative's noun that no name identifies among ``named``."""
    return F.size(F.array_except(pointed_nouns(tokens, lex), named)) > 0


def self_contained(text: Column, named: Column, lex: Lexicon = ROMANIAN) -> Column:
    """No phrase, pronoun, clitic or demonstrative whose referent lies outside ``text``; ``named`` are
    the named nouns of the whole passage."""
    inside = lambda t: ~patient_missing(t, lex) & ~points_outside(t, named, lex)
    return X.no_anaphora(text) & X.plural_pronouns_closed(text) & X.let(tokens(text), inside)


# ---------------------------------------------------------------- clauses and lists


def split_words(text: Column) -> Column:
    """The parts between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def first_of(values: Column, use: Callable[[Column], Column]) -> Column:
    """The first of ``use`` of the values that isn't null."""
    return F.get(F.filter(F.transform(values, use), lambda v: v.isNotNull()), F.lit(0))


def told_of(sentence: Column, name: Column) -> Column:
    """(before, tail): the word before the name's first mention, and what follows it; null without one."""

    def parts(at: Column) -> Column:
        before = X.let(F.regexp_extract_all(F.left(sentence, at), F.lit(X.WORD), F.lit(0)), lambda w: F.coalesce(F.lower(F.get(w, F.size(w) - 1)), F.lit("")))
        return F.when(at >= 0, F.struct(before.alias("before"), F.substring(sentence, at + F.char_length(name) + 1, F.char_length(sentence)).alias("tail")))

    return X.let(X.first_mention(sentence, name), parts)


def said(tail: Column) -> Column:
    """What is told up to a colon and the quotation after it, with one stop; empty without one."""
    return F.regexp_extract(tail, _SAID, 1)


def name_predicate(statement: Column, name: Column, holds: Callable[[Column], Column], *, quotes: bool = False, oblique_name: str = L.OBLIQUE_DEITY, lex: Lexicon = ROMANIAN) -> Column:
    """The clause after the name, where the name isn't oblique and the clause stands alone.

    Of the first sentence that has such a clause; ``holds`` says whether a clause leans on
    nothing outside. With ``quotes`` it may be reported speech.
    """

    def clause(sentence: Column) -> Column:
        return X.let(told_of(sentence, name), read)

    def read(t: Column) -> Column:
        speech = F.regexp_like(t["tail"], F.lit(_SPEECH))
        reported = said(t["tail"])
        full = X.strip(reported)
        bare = F.btrim(F.regexp_extract(t["tail"], _TOLD, 0), F.lit(L.TRIM))
        fits = X.let(split_words(bare), lambda w: F.size(w).between(2, 14) & ~F.coalesce(_any_of(F.btrim(F.lower(F.get(w, F.size(w) - 1)), F.lit("-")), lex.edges), F.lit(True)))
        open_ = t.isNotNull() & ~_any_of(t["before"], lex.oblique)
        if quotes:
            return F.when(open_ & (reported != "") & (F.char_length(full) <= 220) & stands(full), full).when(open_ & (reported == "") & ~speech & fits & stands(bare), bare)
        return F.when(open_ & ~speech & (reported == "") & fits & stands(bare), bare)

    def stands(c: Column) -> Column:
        first = F.lower(F.get(split_words(c), F.lit(0)))  # whole words: a clitic that a hyphen binds to its verb is no linker
        return (F.char_length(c) >= 10) & ~F.coalesce(_any_of(first, lex.edges), F.lit(True)) & ~X.mentions(c, name) & holds(c)

    return F.when(name != oblique_name, first_of(X.sentences(statement), clause))


def rival_words(statement: Column, name: Column) -> Column:
    """The sorted words of what is told of the name in each sentence; looser than name_predicate."""
    tails = F.filter(F.transform(X.sentences(statement), lambda s: told_of(s, name)), lambda t: t.isNotNull())
    told = lambda t: F.when(said(t["tail"]) != "", said(t["tail"])).otherwise(F.regexp_extract(t["tail"], _TOLD, 0))
    bags = F.transform(tails, lambda t: F.sort_array(F.array_distinct(X.words(F.lower(told(t))))))
    return F.filter(bags, lambda b: F.size(b) > 0)


def clause_halves(statement: Column, holds: Callable[[Column], Column], *, linkers=tuple(L.LINKERS), hanging=tuple({*L.OBLIQUE_MARKERS, *L.LINKERS, *L.DETERMINERS}), subordinate=tuple(L.SUBORDINATE)) -> Column:
    """(far, at, left, right) of the first short clause that can be cut, cut nearest its middle
    where no function word is stranded."""
    clauses = F.transform(F.flatten(F.transform(X.sentences(statement), lambda s: F.split(s, "[,;]", -1))), lambda c: F.btrim(c, F.lit(L.TRIM)))
    short = lambda c: F.char_length(c).between(12, 70) & ~F.regexp_like(c, F.lit('[.,;:"„”«»!?()]'))

    def cut(w: Column, k: Column) -> Column:
        left, right = F.slice(w, F.lit(1), k), F.slice(w, k + 1, F.size(w))
        end, start = F.get(w, k - 1), F.get(w, k)
        texts = F.array_join(left, " "), F.array_join(right, " ")
        fit = ~_any_of(F.lower(end), hanging) & ~_any_of(F.lower(start), hanging) & ~_any_of(F.lower(start), subordinate)
        fit &= (F.least(F.char_length(end), F.char_length(start)) > 2) & (F.greatest(k, F.size(w) - k) <= 8) & (F.least(*map(F.char_length, texts)) >= 6)
        return F.when(fit, F.struct(F.abs(2 * k - F.size(w)).alias("far"), k.alias("at"), texts[0].alias("left"), texts[1].alias("right")))

    def best(c: Column) -> Column:
        cuts = lambda v: F.array_min(F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda k: cut(v, k)))
        return X.let(split_words(c), lambda v: F.when(F.size(v).between(3, 10) & ~_any_of(F.lower(F.get(v, F.lit(0))), linkers) & holds(c), cuts(v)))

    return first_of(F.filter(clauses, short), best)


def list_pattern(kind: str, join: str = _JOIN, last: str = _AND) -> str:
    """What a sentence that ends in a list of a kind is as one pattern: group 1 is the head, group 2 the longest list that ends it."""
    return rf"(?s)^(.*?\S)\s+((?:{kind})(?:{join}(?:{kind}))*?{last}(?:{kind}))[{re.escape(L.TRIM)}]*$"


def ending_list(sentence: Column, kind: str, join: str = _JOIN, last: str = _AND) -> Column:
    """(head, members) as ``list_pattern`` reads them, or null: from the right, part by part.

    A pattern would go back once for each member of a list and a long one take its stack. Here
    the sentence is cut at its joins; a scan from the end counts the parts that are members as
    a whole; the list begins in the part before them, with what of it is a member, or else at
    the first of them that a blank comes before.
    """
    end = F.rtrim(sentence, F.lit(L.TRIM))

    def read(v: Column) -> Column:
        parts, joins = v["parts"], v["joins"]
        n = F.size(parts)
        member = lambda x: F.regexp_like(x, F.lit(f"(?U)^(?:{kind})$"))
        open_ = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
        whole = F.aggregate(F.reverse(parts), open_, lambda s, x: F.struct((s["n"] + (s["on"] & member(x)).cast("int")).alias("n"), (s["on"] & member(x)).alias("on")), lambda s: s["n"])
        rest = rf"(?Us)^.*?\S\s+({kind})$"

        def begin(k: Column, m: Column) -> Column:
            inside = F.when(F.regexp_like(F.get(parts, k), F.lit(rest)), F.regexp_extract(F.get(parts, k), rest, 1))
            at_start = F.when((k > 0) & (k >= n - m) & F.regexp_like(F.get(joins, k - 1), F.lit(r"(?U)\s$")), F.get(parts, k))
            first = F.coalesce(at_start, inside)
            return F.when(first.isNotNull(), F.struct(k.alias("k"), first.alias("first")))

        def members(f: Column) -> Column:
            after = F.slice(parts, f["k"] + 2, n)
            length = F.aggregate(F.concat(after, F.slice(joins, f["k"] + 1, n)), F.char_length(f["first"]), lambda s, x: s + F.char_length(x))
            head = F.regexp_replace(F.left(v["text"], F.char_length(v["text"]) - length), r"(?U)\s+$", "")
            return F.when(f.isNotNull(), F.struct(head.alias("head"), F.concat(F.array(f["first"]), after).alias("members")))

        listed = (n >= 2) & F.regexp_like(F.get(joins, n - 2), F.lit(f"(?U)^{last}$"))
        found = X.let(whole, lambda m: F.when(m > 0, first_of(F.sequence(F.greatest(n - 1 - m, F.lit(0)), n - 2), lambda k: begin(k, m))))
        return F.when(listed, X.let(found, members))

    cut = F.struct(end.alias("text"), F.split(end, f"(?U){join}", -1).alias("parts"), F.regexp_extract_all(end, F.lit(f"(?U)({join})"), F.lit(1)).alias("joins"))
    return X.let(cut, read)


def enumeration(statement: Column, holds: Callable[[Column], Column], *, kinds: dict[str, str] = L.MEMBER_KINDS, join: str = _JOIN, last: str = _AND, no_end=tuple({*L.OBLIQUE_MARKERS, *L.PREPOSITIONS})) -> Column:
    """(stem, members) of the first coordinated list of one kind that ends a sentence without quotes."""

    def read(s: Column) -> Column:
        plain = ~F.regexp_like(s, F.lit('["„”«»]')) & F.regexp_like(s, F.lit(f"(?U){last}")) & holds(s)
        return F.when(plain, reduce(lambda found, p: F.coalesce(found, X.let(ending_list(s, p, join, last), stem)), list(kinds.values())[1:], X.let(ending_list(s, next(iter(kinds.values())), join, last), stem)))

    def stem(found: Column) -> Column:
        head, members = F.rtrim(found["head"], F.lit(" ,")), found["members"]
        whole = found.isNotNull() & (F.size(F.array_distinct(members)) == F.size(members)) & F.char_length(head).between(12, L.STEM_CHARS[1]) & holds(head)
        whole &= X.let(tokens(head), lambda w: ~F.coalesce(_any_of(F.get(w, F.size(w) - 1)["low"], no_end), F.lit(False)))
        return F.when(whole, F.struct(F.concat(head, F.lit(f" {L.BLANK}")).alias("stem"), members.alias("members")))

    return first_of(X.sentences(statement), read)


# ---------------------------------------------------------------- blanks


def blanked(s: Column, at: Column, answer: Column, alone: Column) -> Column:
    """(stem, segment, answer, tail) of a sentence with ``answer`` at ``at`` blanked; the tail is
    what follows a blank that leads. Null where the stem isn't fit or too short or long."""
    rest = F.substring(s, at + F.char_length(answer) + 1, F.char_length(s))
    stem = X.strip(F.concat(F.left(s, at), F.lit(L.BLANK), rest))
    leads = F.startswith(stem, F.lit(L.BLANK))
    real = F.size(split_words(stem)) - 1
    fit = X.quotes_balanced(s) & X.starts_upper(s) & alone & F.char_length(stem).between(*L.BLANK_CHARS) & (real >= F.when(leads, L.LEADING_WORDS).otherwise(L.BLANK_WORDS))
    return F.when(fit, F.struct(stem.alias("stem"), s.alias("segment"), answer.alias("answer"), F.when(leads, rest).otherwise("").alias("tail")))


def completions(told: Column, name: Column) -> Column:
    """Sentences with the name blanked, in order; the first whose blank doesn't lead ends them. ``told`` are (s, alone)."""
    made = F.transform(told, lambda t: F.when(X.mention_count(t["s"], name) == 1, blanked(t["s"], X.first_mention(t["s"], name), name, t["alone"])))
    stems = F.filter(made, lambda b: b.isNotNull())
    end = lambda v: F.array_position(F.transform(v, lambda b: b["tail"] == ""), True).cast("int")
    return X.let(stems, lambda v: F.when(end(v) > 0, F.slice(v, F.lit(1), F.greatest(end(v), F.lit(1)))).otherwise(v))


def _leading_none(b: Column) -> Column:
    return F.when(b["tail"] == "", b)


def numeral_stem(told: Column) -> Column:
    one = lambda s: F.regexp_count(s, F.lit(_NUMERAL)) == 1
    blank = lambda t: blanked(t["s"], F.regexp_instr(t["s"], F.lit(_NUMERAL)) - 1, F.regexp_extract(t["s"], _NUMERAL, 1), t["alone"])
    return first_of(told, lambda t: F.when(one(t["s"]), X.let(blank(t), _leading_none)))


_PLACES = [p for p in L.PLACES if p not in L.COLLECTIVE]


def place_stem(told: Column) -> Column:
    places = F.lit(_PLACES)

    def read(t: Column) -> Column:
        named = F.filter(places, lambda p: X.mentions(t["s"], p))
        only = X.let(named, lambda v: F.when((F.size(v) == 1) & (X.mention_count(t["s"], F.get(v, F.lit(0))) == 1), F.get(v, F.lit(0))))
        return X.let(only, lambda p: F.when(p.isNotNull(), X.let(blanked(t["s"], X.first_mention(t["s"], p), p, t["alone"]), _leading_none)))

    return first_of(told, read)


def numerals_in(statement: Column) -> Column:
    return F.regexp_extract_all(statement, F.lit(_NUMERAL), F.lit(1))


def places_in(statement: Column) -> Column:
    """Places by where they first stand."""
    at = F.transform(F.lit(_PLACES), lambda p: F.struct(X.first_mention(statement, p).alias("at"), p.alias("p")))
    return F.transform(F.array_sort(F.filter(at, lambda x: x["at"] >= 0)), lambda x: x["p"])
