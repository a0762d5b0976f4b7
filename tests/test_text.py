import pytest
from pyspark.sql import functions as F

from folioforge.functions import romanian as R
from folioforge.functions import text as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)], "i int, a string" + (", b string" if isinstance(texts[0], tuple) else ""))
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


A, B = F.col("a"), F.col("b")
TEXTS = ["Una. Doua!  Trei? ", "fără punct", "", "Cu „citat.” Gata.", " \n Ana.\tIoan. "]


def test_sentences_agree_with_the_plain_reading(spark):
    assert values(spark, TEXTS, X.sentences(A)) == [R.sentences(t) for t in TEXTS]


def test_whole_words_are_unicode(spark):
    pairs = [("șAna merge", "Ana"), ("Ana merge", "Ana"), ("la Ana.", "Ana"), ("Anatolia", "Ana"), ("a+b c", "a+b"), ("x \\E y", "\\E")]
    got = values(spark, pairs, X.mentions(A, B))
    assert got == [R.mentions(*p) for p in pairs] == [False, True, True, False, True, True]


@pytest.mark.parametrize(("text", "balanced"), [("„a\"", True), ("„a”", True), ("„a", False), ('"a"', True), ('"a', False), ("«a»", True), ("«a", False), ("", True)])
def test_quotes(spark, text, balanced):
    assert values(spark, [text], X.quotes_balanced(A)) == [balanced] == [R.quotes_balanced(text)]


def test_referents(spark):
    pairs = [("Domnul", "Domnului"), ("Domnul", "Dumnezeu"), ("Ana", "Anania"), ("saul", "Saul"), ("Samuel", "Saul"), ("David", "Davidoiu")]
    assert values(spark, pairs, X.same_referent(A, B)) == [R.same_referent(*p) for p in pairs] == [True, True, False, True, False, True]


def test_kinds(spark):
    pairs = [("Efraim", "Samuel"), ("Israel", "Samuel"), ("piatră", "Efraim"), ("Silo", "Rama")]
    assert values(spark, pairs, X.compatible_kind(A, B)) == [R.compatible(*p) for p in pairs] == [False, True, True, True]
    members = ["trei fii", "vase de aur", "cu harfe", "os din oasele mele", "trei case", "vase de aur mari"]
    assert values(spark, members, X.member_kind(A)) == [R.member_kind(m) for m in members] == ["quantity", "vessels", "instruments", "kinship", None, None]
    assert values(spark, ["că vine", "Ana", "vine", ""], X.register(A)) == ["subordinate", "capitalised", "plain", "empty"]


def test_last_mention_is_replaced(spark):
    assert values(spark, [("Eli și Eli.", "Eli"), ("Elisei", "Eli"), ("Eli", "Eli")], X.replace_last_mention(A, B, F.lit("Saul"))) == ["Eli și Saul.", "Elisei", "Saul"]


def test_ranges(spark):
    df = spark.createDataFrame([([1, 2, 3, 5, 7, 8],), ([4],), ([3, 1, 2, 2],), ([],)], "n array<int>")
    assert [r[0] for r in df.select(X.range_label(F.col("n"))).collect()] == ["1-3,5,7-8", "4", "1-3", ""]


def test_ledger_and_referents_depend_on_order(spark):
    stems = [["un om a venit acasă", "un om a venit târziu acasă", "altceva cu totul", "", "altceva cu totul"]]
    df = spark.createDataFrame([(s,) for s in stems], "s array<string>")
    from folioforge.plans.paper import StemLedger

    book = StemLedger()
    assert df.select(X.ledger(F.col("s"))).first()[0] == [i for i, s in enumerate(stems[0]) if book.claim(s)] == [0, 2]
    df = spark.createDataFrame([(["Domnul", "Domnului", "Saul", "Eli"],)], "s array<string>")
    assert df.select(X.distinct_referents(F.col("s"), 2)).first()[0] == R.distinct_referents(["Domnul", "Domnului", "Saul", "Eli"], 2) == ["Domnul", "Saul"]


LEANING = ["L-a dus în Casa Domnului.", "Cine i-a istorisit tot?", "Ei vor căuta apă.", "L-a chemat ca și în celelalte dăți.", "Pentru copilul acesta mă rugam."]
STANDING = ["L-a chemat pe Samuel.", "I-a zis bucătarului să vină.", "A venit la gura ei.", "Domnul a tunat în ziua aceea.", "Domnul este acesta."]


def test_self_contained():
    assert [R.self_contained(t) for t in LEANING] == [False] * 5
    assert [R.self_contained(t) for t in STANDING] == [True] * 5
    assert R.self_contained("Pentru copilul acesta mă rugam.", "Copilul Samuel era mic. Pentru copilul acesta mă rugam.")


def test_pronoun_columns_agree(spark):
    texts = LEANING + STANDING
    got = values(spark, texts, X.no_anaphora(A), X.plural_pronouns_closed(A))
    assert [all(g) for g in got] == [True, True, False, False, True, True, True, True, True, True]


def test_predicates_and_lists():
    assert R.name_predicate("Samuel s-a dus repede acasă, iar ei au rămas.", "Samuel") == "s-a dus repede acasă"
    assert R.name_predicate("Regele a vorbit cu Samuel despre oștire.", "Samuel") is None
    said = "Samuel a strigat: „Vino aici!” Apoi a tăcut."
    assert R.name_predicate(said, "Samuel") is None
    assert R.name_predicate(said, "Samuel", quotes=True) == "a strigat: „Vino aici!”"
    assert R.enumeration("Ioram a adus la templu vase de argint, vase de aur și vase de aramă.") == ("Ioram a adus la templu __________", ["vase de argint", "vase de aur", "vase de aramă"])
    assert R.enumeration("A adus pâine și vin.") is None
    assert R.clause_halves("Regele David construia cetatea frumoasă.") == ("Regele David", "construia cetatea frumoasă")
    place = R.place_stem("Oamenii din Hebron au venit la rege în zori.")
    assert place.answer == "Hebron" and place.stem.count("__________") == 1
    assert R.place_stem("Din Hebron la Silo au mers toți oamenii aceia.") is None
    assert R.numeral_stem("Au adus trei corăbii și cinci cai la rege.") is None


def test_reported_speech_and_lists():
    assert R.name_predicate("Atunci Samuel a zis: „Vino!” Apoi a plecat.", "Samuel", quotes=True) == "a zis: „Vino!”"
    assert R.name_predicate("Atunci Samuel a zis: „Vino! Apoi a plecat.", "Samuel", quotes=True) is None
    assert R.rival_words("Samuel a zis: „Vino aici!” și a tăcut.", "Samuel") == [frozenset({"a", "zis", "vino", "aici"})]
    assert R.rival_words("Samuel a zis: pleacă.", "Samuel") == [frozenset({"a", "zis"})]
    assert R.enumeration("Solul a adus regelui trei pâini, un vițel gras sau cinci oi pregătite.") == ("Solul a adus regelui __________", ["trei pâini", "un vițel gras", "cinci oi pregătite"])
    assert R.enumeration("Solul a adus regelui trei pâini și trei pâini.") is None
    assert R.clause_halves("Regele a mers.") is None


def test_patients_and_pointers():
    assert not R.self_contained("Atunci l-a chemat la masă.") and R.self_contained("Atunci l-a chemat pe David la masă.")
    assert not R.self_contained("Soldatul îl privea mirat.") and R.self_contained("Soldatul îl privea pe Saul mirat.")
    assert R.self_contained("I-a dat fratelui pâine.") and not R.self_contained("Glasul fratelui l-a mustrat.")
    assert not R.self_contained("Omul acela venea din câmp.") and R.self_contained("În ziua aceea era liniște.")
    assert R.self_contained("Regele acesta domnea.", "Regele David era drept. Regele acesta domnea.")


def test_leading_blank_needs_rivals():
    (stem,) = R.completions("Samuel a vorbit poporului despre legea cea nouă a țării.", "Samuel")
    assert stem.tail and R.unambiguous(stem.tail, "Samuel", [("Saul", frozenset({"altceva"}))])
    assert not R.unambiguous(stem.tail, "Samuel", [("Saul", R.word_set(stem.tail))])
