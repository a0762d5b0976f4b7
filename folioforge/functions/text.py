"""Text predicates and projections as columns. Every pattern is Unicode-aware."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge import lexicon as L

WORD = r"(?U)\w+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once; lambdas would repeat it for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Parts after . ! ? and white space, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def whole_word(value: Column) -> Column:
    """A pattern for ``value`` with no word character on either side."""
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))


def mentions(text: Column, value: Column) -> Column:
    return F.regexp_like(text, whole_word(value))


def mention_count(text: Column, value: Column) -> Column:
    return F.regexp_count(text, whole_word(value))


def first_mention(text: Column, value: Column) -> Column:
    """The offset of the first whole-word hit, from 0; -1 without one."""
    return F.regexp_instr(text, whole_word(value)) - 1


def occurrences(text: Column, mark: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def quotes_balanced(text: Column) -> Column:
    """Guillemets pair up; low quotes pair with ASCII and high ones; else ASCII ones are even."""
    low, plain, high = occurrences(text, "„"), occurrences(text, '"'), occurrences(text, "”")
    return (occurrences(text, "«") == occurrences(text, "»")) & F.when(low == 0, plain % 2 == 0).otherwise(low == plain + high)


def starts_upper(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^\p{Lu}"))


def ends_sentence(text: Column) -> Column:
    """Ends in . ! ? with closing quotes at most after it, and not as a bare question."""
    return F.regexp_like(text, F.lit('[.!?]["”»]*$')) & ~F.regexp_like(text, F.lit(r"(?U)\?\s*$"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words; runs of underscores are blanks, not words."""
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: ~F.regexp_like(w, F.lit("^_+$"))))


def overlap(a: Column, b: Column) -> Column:
    """Common members over the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a`` that is in ``b``."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def inflection(a: Column, b: Column) -> Column:
    """The shorter, of four letters or more, begins the longer, ignoring case."""
    x, y = F.lower(a), F.lower(b)
    return F.when(F.char_length(x) <= F.char_length(y), (F.char_length(x) >= 4) & F.startswith(y, x)).otherwise((F.char_length(y) >= 4) & F.startswith(x, y))


def same_referent(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)) | (a.isin(L.DEITY) & b.isin(L.DEITY)) | inflection(a, b)


def term_group(value: Column) -> Column:
    return F.when(value.isin(L.PEOPLE), "person").when(value.isin(L.PLACES), "place").when(value.isin(L.DEITY), "deity").otherwise("other")


def gender(value: Column) -> Column:
    return F.when(value.isin(L.FEMININE), "f").otherwise("m")


def role(value: Column) -> Column:
    return F.when(value.isin(L.DEITY + L.COLLECTIVE + L.PEOPLE), "agent").when(value.isin(L.PLACES), "place").otherwise("other")


def compatible_kind(a: Column, b: Column) -> Column:
    """Agents don't stand in for places; what isn't classed goes with anything."""
    x, y = role(a), role(b)
    return (x == y) | (x == "other") | (y == "other")


def swap_class(value: Column) -> Column:
    return F.when(value.isin(L.DEITY), "deity").when(value.isin(L.COLLECTIVE), "collective").otherwise("ordinary")


def safe_to_swap(value: Column) -> Column:
    return value != L.OBLIQUE_DEITY


def head_word(value: Column) -> Column:
    """What stands before the first white space; empty if there is nothing else."""
    return F.regexp_extract(value, r"(?U)\S+", 0)


def register(value: Column) -> Column:
    head = head_word(value)
    return F.when(head == "", "empty").when(F.lower(head).isin(L.SUBORDINATE), "subordinate").when(starts_upper(head), "capitalised").otherwise("plain")


def member_kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(L.MEMBER_KINDS.items()):
        out = F.when(F.regexp_like(value, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def clean_member(value: Column) -> Column:
    return ~F.regexp_like(value, F.lit('[.,;:"„”«»!?()]')) & ~F.lower(head_word(value)).isin(L.LINKERS)


def numeral_value(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in L.NUMERALS.items() for x in p]), F.lower(word))


def no_anaphora(text: Column) -> Column:
    """None of the fixed phrases that point back at an earlier telling."""
    return ~F.regexp_like(text, F.lit("(?iU)" + L.ANAPHORA))


def plural_pronouns_closed(text: Column) -> Column:
    """Each plural pronoun is followed by punctuation, so it closes its clause."""
    return ~F.regexp_like(text, F.lit("(?iU)" + L.PLURAL_SUBJECT))


def opens_quote(text: Column) -> Column:
    return F.regexp_like(text, F.lit('(?U)^:\\s*[„«"]'))


def reference(book: Column, chapter: Column, first: Column, last: Column) -> Column:
    one = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), first.cast("string"))
    return F.when(first == last, one).otherwise(F.concat(one, F.lit("-"), last.cast("string")))


def replace_last_mention(text: Column, value: Column, new: Column) -> Column:
    """The last whole-word hit of ``value`` replaced; text without one stays."""
    pattern = F.concat(F.lit("(?s)^(.*)"), whole_word(value), F.lit("(.*)$"))
    parts = [F.call_function("regexp_extract", text, pattern, F.lit(i)) for i in (1, 2)]
    return F.when(mentions(text, value), F.concat(parts[0], new, parts[1])).otherwise(text)


def shortest_fit(told: Column, accept: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
    """(length, number, sentence) of the shortest of ``told`` that is fit for an affirmation; ties go to the first."""
    fit = lambda s: (
        F.char_length(s).between(30, 165) & starts_upper(s) & quotes_balanced(s) & ~F.contains(s, F.lit("(")) & ends_sentence(s) & accept(s)
    )
    rows = F.transform(told, lambda s, i: F.struct(F.char_length(s).alias("length"), i.alias("number"), s.alias("sentence")))
    return F.array_min(F.filter(rows, lambda r: fit(r["sentence"])))


def concise(text: Column, accept: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
    """(length, number, sentence) of the shortest sentence fit for an affirmation; ties go to the first."""
    return shortest_fit(sentences(text), accept)


def distinct_referents(values: Column, count: int, same: Callable[[Column, Column], Column] = same_referent) -> Column:
    """The first ``count`` values of which no two name the same; fewer if there aren't so many."""
    start = F.slice(values, 1, 0)
    return F.aggregate(
        values, start, lambda kept, v: F.when((F.size(kept) < count) & ~F.exists(kept, lambda k: same(k, v)), F.concat(kept, F.array(v))).otherwise(kept)
    )


def ledger(stems: Column, limit: float = L.OVERLAP) -> Column:
    """Positions of the stems that a running ledger takes: each shares less than ``limit`` of
    the larger word set with all taken before it; a stem without words isn't taken."""
    sets = F.transform(stems, lambda s, i: F.struct(i.alias("i"), word_set(s).alias("w")))
    take = lambda kept, s: (F.size(s["w"]) > 0) & ~F.exists(kept, lambda k: overlap(k["w"], s["w"]) >= limit)
    kept = F.aggregate(sets, F.slice(sets, 1, 0), lambda acc, s: F.when(take(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return F.transform(kept, lambda k: k["i"])


def range_label(numbers: Column) -> Column:
    """Sorted distinct integers as ranges, such as 1-3,5."""
    step = lambda acc, n: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] == n - 1),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), n.alias("b")))),
    ).otherwise(F.concat(acc, F.array(F.struct(n.alias("a"), n.alias("b")))))
    ordered = F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: n.cast("int"))
    spans = F.aggregate(ordered, F.array().cast("array<struct<a:int,b:int>>"), step)
    return F.array_join(F.transform(spans, lambda s: F.when(s["a"] == s["b"], s["a"].cast("string")).otherwise(F.concat_ws("-", s["a"], s["b"]))), ",")


def hash_order(*parts: Column | str) -> Column:
    """A repeatable order: the md5 of the parts, which other engines agree on."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
