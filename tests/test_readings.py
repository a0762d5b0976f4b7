"""Readings as columns against the plain versions, on cases of every kind and on drawn sentences."""

import random
import re

from pyspark.sql import functions as F

from folioforge import lexicon as L
from folioforge.functions import readings as G
from folioforge.functions import romanian as R
from folioforge.functions.automaton import Automaton
from folioforge.operators.candidates import NAMES, candidate_columns, candidates_of

LEANING = [
    "Cine i-a povestit totul?", "L-au chemat, dar nu l-au aflat.", "Ana o privea mereu.", "L-a dus în Casa Domnului, la Silo.", "Atunci l-a chemat la masă.", "Soldatul îl privea mirat.",
    "Glasul fratelui l-a mustrat.", "Pentru pruncul acesta plângeam.", "Eli s-a temut să spună visul acela.", "Omul acela venea din câmp.", "Ei vor căuta apă.", "L-a chemat ca și în celelalte dăți.",
]
STANDING = [
    "Cine l-a chemat pe Samuel?", "Samuel i-a zis bucătarului: „Adu pâinea!”", "David le-a trimis soli oamenilor din Iabesul Galaadului.", "Care este vorba pe care ți l-a spus Domnul?",
    "Ana a luat o efă de făină și un burduf cu vin.", "I-a dat fratelui pâine.", "A venit la gura ei.", "Domnul a tunat în ziua aceea cu putere.", "Și Eli a zis: „Domnul este acesta!”", "L-a chemat pe Samuel.", "",
]
FACTS = [
    ("Saul și-a ales trei mii de oameni din Israel.", "Saul"), ("Saul și slujitorii lui erau în fundul peșterii.", "Saul"), ("Regele a vorbit cu Samuel despre oștire.", "Samuel"),
    ("Samuel a strigat: „Vino aici!” Apoi a tăcut.", "Samuel"), ('Samuel a răspuns: „Iată, căci ai chemat!" Și a plecat.', "Samuel"), ('Samuel a zis: „Vino!" apoi ” mai târziu.', "Samuel"), ("Samuel a zis: „Vino și vezi", "Samuel"),
    ("Ioram a adus la templu vase de argint, vase de aur și vase de aramă.", "Ioram"), ("Solul a adus regelui trei pâini, un vițel gras sau cinci oi pregătite.", "David"), ("Solul a adus regelui trei pâini și trei pâini.", "David"),
    ("Regele David construia cetatea frumoasă.", "David"), ("Oamenii din Hebron au venit la rege în zori.", "Samuel"), ("Din Hebron la Silo au mers toți oamenii aceia.", "Eli"), ("Au adus trei corăbii la regele cel mare.", "Eli"),
    ("Samuel a vorbit poporului despre legea cea nouă a țării.", "Samuel"), ("Copilul Samuel creștea. Pentru copilul acesta se ruga mama.", "Samuel"), ("Regele lui Israel era drept. Regele acesta domnea la Hebron cu Samuel.", "Samuel"),
    ("Domnului i s-a jertfit.", "Domnului"), ("", "Ana"), ("Ana", "Ana"), ("Ana. Ana! Ana a plecat acasă la Rama.", "Ana"),
]


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = L.PEOPLE[:6] + L.PLACES[:4] + L.DEITY + L.OBLIQUE_MARKERS[:8] + L.LINKERS + L.SUBORDINATE[:5] + L.DEMONSTRATIVES_BEFORE[:3] + L.DEMONSTRATIVES_AFTER[:3] + ["o", "îl", "l-a", "i-a", "le-a", "pe", "lui", "regele", "omul", "casei", "fraților", "copilul"]
    words += ["a plecat", "vede", "privea", "acasă", "cetatea", "poporul", "trei", "cinci", "patruzeci", "vase de aur", "vase de argint", "cu harfe", "trei fii", "ei", "munte", "ziua", "mare"]
    marks = [" "] * 14 + [", ", ", ", "; ", ": „", "” ", " și ", ' "', ". ", "! ", "? ", " („"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(1, 24))).strip() + rng.choice([".", ".", "!”", "?", ""])
        out.append(((text[:1].upper() + text[1:]), rng.choice(L.PEOPLE[:6] + L.DEITY)))
    return out


def test_self_contained_agrees(spark):
    texts = LEANING + STANDING + [t for t, _ in FACTS] + [t for t, _ in drawn(300, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    named = G.named_nouns(G.tokens(F.col("a")))
    got = df.select("i", G.self_contained(F.col("a"), named).alias("c"), G.patient_missing(G.tokens(F.col("a"))).alias("p"), G.pointed_nouns(G.tokens(F.col("a"))).alias("n"), named.alias("named")).orderBy("i").collect()
    assert [r["c"] for r in got] == [R.self_contained(t) for t in texts]
    assert [r["p"] for r in got] == [R._patient_missing(t) for t in texts]
    assert [set(r["named"]) for r in got] == [R._named_nouns(t) for t in texts]
    assert [r["c"] for r in got][: len(LEANING) + len(STANDING)] == [False] * len(LEANING) + [True] * len(STANDING)
    assert df.select(G.tokens(F.lit(None).cast("string")).alias("t")).first()["t"] == []


def plain_candidates(statement, name):
    tupled = lambda v: tuple(v.values()) if isinstance(v, dict) else [tupled(x) for x in v] if isinstance(v, list) else v
    return [tupled(v) for v in candidates_of(statement, name)]


def test_candidates_agree_with_the_plain_readings(spark):
    facts = FACTS + [(t, "Samuel") for t in LEANING + STANDING] + drawn(500)
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(facts)], "i int, statement string, object string")
    tupled = lambda v: tuple(v) if hasattr(v, "asDict") else [tupled(x) for x in v] if isinstance(v, list) else v
    made = 0
    for r in candidate_columns(rows).orderBy("i").collect():
        want = plain_candidates(*facts[r["i"]])
        got = [tupled(r[n]) for n in NAMES]
        assert got == want, facts[r["i"]]
        made += sum(bool(v) for v in got)
    assert made > 500
    by = {r["statement"]: r for r in candidate_columns(rows.limit(len(FACTS))).collect()}
    assert by[FACTS[0][0]]["named"] == "și-a ales trei mii de oameni din Israel" and by[FACTS[1][0]]["named"] is None
    assert by[FACTS[4][0]]["wh"]["segment"] == 'a răspuns: „Iată, căci ai chemat!"' and by[FACTS[5][0]]["wh"]["segment"] == 'a zis: „Vino!"' and by[FACTS[6][0]]["wh"] is None


def test_an_automaton_is_its_rule(spark):
    """Words of which one is followed, not at once, by its double."""
    step = lambda s, c: (s[1], c, s[2] or s[0] == c)
    a = Automaton((None, None, False), 3, step, lambda s: s[2])
    rng = random.Random(1)
    lists = [[rng.randrange(3) for _ in range(rng.randint(0, 6))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, c array<int>")
    want = [any(x == y for x, y in zip(v, v[2:], strict=False)) for v in lists]
    assert [r[1] for r in df.select("i", a.run(F.col("c"))).orderBy("i").collect()] == want


def test_lists_are_read_from_the_right(spark):
    """Against the pattern that says what a list is, on drawn sentences; a list of very many members takes no stack."""
    rng = random.Random(6)
    kind, join, last = "aa|b c|c", r"(?:\s*,\s*|\s+and\s+)", r"\s+and\s+"
    texts = ["".join(rng.choice(["aa", "b c", "c", "x", "aa c"]) + rng.choice([" ", ", ", ",", " and ", " , ", "  and ", ". "]) for _ in range(rng.randint(1, 7))).strip() + rng.choice(["", ".", " !"]) for _ in range(600)]
    texts += ["x aa and c", "aa and c", "x,aa and c", "x, aa and c", "x b c and c", "x c,c and c", "and", "", "x and c"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", G.ending_list(F.col("s"), kind, join, last).alias("l")).orderBy("i").collect()
    found = 0
    for r, t in zip(got, texts, strict=True):
        m = re.search(G.list_pattern(kind, join, last), t)
        assert (r["l"] and (r["l"]["head"], ", ".join(r["l"]["members"]))) == (m and (m[1], ", ".join(re.split(join, m[2])))), t
        found += m is not None
    assert found > 40
    long = "x " + "aa, " * 200_000 + "aa and c."
    n = spark.createDataFrame([(long,)], "s string").select(F.size(G.ending_list(F.col("s"), kind, join, last)["members"])).first()[0]
    assert n == 200_002
