"""Fixed values of the domain: names, closed word classes and limits.

Another corpus brings a lexicon of its own; see ``lexicon_frame``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
PEOPLE = ["Ana", "Penina", "Elcana", "Eli", "Hofni", "Fineas", "Samuel", "David", "Saul", "Ionatan", "Abner", "Ioab", "Natan", "Absalom", "Mical", "Batșeba", "Goliat", "Isai", "Chis", "Ahimelec", "Dagon", "Iosua"]
PLACES = ["Silo", "Rama", "Efraim", "Israel", "Filisteni", "Filistenii", "Ghilboa", "Ierusalim", "Hebron", "Betleem", "Gat", "Mițpa", "Iordan", "Iuda", "Ecron", "Asdod", "Gaza", "Ascalon"]
DEITY = ["Domnul", "Domnului", "Dumnezeu", "Dumnezeul"]
OBLIQUE_DEITY = "Domnului"
FEMININE = ["Ana", "Penina", "Mical", "Batșeba"]
COLLECTIVE = ["Israel", "Filistenii"]
ARTICLED = ["Domnul", "Filistenii"]
STOP_TERMS = ["Era", "El", "Dar", "Și", "Nu", "Când", "Atunci", "De", "Iată", "Acum", "În", "Oare", "Apoi", "După", "Pentru", "Cum", "Unde", "Ce", "Să", "Omul", "Ori", "Potrivnica", "Chiar", "Fiindcă", "Acolo", "Așa", "Cei", "Fiii", "Tinerii", "Femeia", "Femeile", "Poporul", "Israelul", "Vrăjmașii"]
DEFINITE_LEAD = ["lui", "acest", "acesta", "această", "aceasta", "acestui", "acestei", "aceste", "acești", "acestor"]
SUBORDINATE = ["ce", "cum", "cine", "unde", "când", "care", "cui", "dacă", "că", "să", "ca"]
LINKERS = ["și", "sau", "dar", "iar"]
OBLIQUE_MARKERS = ["lui", "pe", "cu", "din", "la", "în", "de", "pentru", "despre", "asupra", "către", "printre", "peste", "sub", "fără", "ca"]
PREPOSITIONS = ["împotriva", "înaintea", "asupra", "lângă", "după", "prin", "spre", "către", "peste", "sub", "fără", "din", "dintre", "de", "la", "în", "cu", "pentru", "despre", "printre", "până"]
VERB_OPENERS = ["a", "au", "am", "ai", "este", "sunt", "era", "erau", "va", "vor", "s-a", "l-a", "le-a", "i-a", "ne-a", "v-a", "s-au", "le-au", "se", "s"]
DETERMINERS = ["cei", "cele", "niște", "toți", "toate", "fiecare", "alt", "altă", "alți", "alte", "doi", "două", "trei", "patru", "cinci", "șase", "șapte", "opt", "nouă", "zece"]
AUXILIARIES = ["voi", "vei", "va", "vom", "veți", "vor", "am", "ai", "ar", "aș", "ați", "au"]
VERB_ENDINGS = ["use", "useră", "seră", "ește", "esc", "eau", "ea", "a"]
TEMPORAL = ["ziua", "zilei", "zilele", "vremea", "vremii", "vremurile", "ceasul", "noaptea", "dimineața", "seara", "anul", "clipa", "data", "dată", "oară"]
NOT_NOUNS = ["este", "era", "sunt", "erau", "fost", "mare", "mari", "mult", "multă", "tot", "toată", "toți", "toate", "așa"]
NUMERALS = {"doi": 2, "două": 2, "trei": 3, "patru": 4, "cinci": 5, "șase": 6, "șapte": 7, "opt": 8, "nouă": 9, "zece": 10, "unsprezece": 11, "doisprezece": 12, "treisprezece": 13, "paisprezece": 14, "cincisprezece": 15, "șaisprezece": 16, "șaptesprezece": 17, "optsprezece": 18, "nouăsprezece": 19, "douăzeci": 20, "treizeci": 30, "patruzeci": 40, "cincizeci": 50, "șaizeci": 60, "șaptezeci": 70, "optzeci": 80, "nouăzeci": 90}
FALLBACK_NUMERALS = ["trei", "cinci", "șapte", "zece", "patruzeci"]
BOOK_ALIASES = {"1 samuel": "1 Samuel", "1samuel": "1 Samuel", "1 sam": "1 Samuel", "1sam": "1 Samuel", "2 samuel": "2 Samuel", "2samuel": "2 Samuel", "2 sam": "2 Samuel", "2sam": "2 Samuel", "rut": "Rut", "ioan": "Ioan"}
#: Patterns that a whole list member must fit, by kind.
MEMBER_KINDS = {
    "quantity": "(?:un|o|doi|două|trei|patru|cinci|șase|șapte|opt|nouă|zece|(?:două|trei|patru|cinci) sute de|o sută de) (?:fii|fiice|tauri|oi(?: pregătite)?|efă de făină|burduf(?:uri)? cu vin|pâini|pâine|bucată de carne|turtă de stafide|turte de stafide|măsuri de grâu prăjit|legături de smochine|suliță|sabie|bou|vițel gras)",
    "vessels": "vase de (?:argint|aur|aramă)",
    "instruments": "cu (?:harfe|lăute|timpane|fluiere|chimvale)",
    "kinship": "(?:os din oasele|carne din carnea) (?:tale|mele)",
}
#: Patterns that must be as they are, without regard to case.
ANAPHORA = r"(?<!\w)ca\s+(?:și\s+)?(?:în\s+)?(?:celelalte|mai\s+înainte|de\s+obicei|alt[ăa]\s+dat[ăa])(?!\w)"
PLURAL_SUBJECT = r"(?<!\w)(?:ei|ele)(?!\w)(?!\s*[,;.!?])"
FREE_CLITICS = ["îl"]
#: A noun that receives, and the ends of nouns with an article.
DATIVE = r"\w{3,}(?:lui|ei|ii|lor)"
ARTICLED_ENDING = r"ul|ua|ele|le|(?<![ei])a"
OBJECT_CLITICS = {"l": ["a", "au", "o"], "le": ["a", "au"], "i": ["a", "au", "o"]}
DEMONSTRATIVES_BEFORE = ["acest", "această", "acești", "aceste", "acel", "acea", "acei", "acele"]
DEMONSTRATIVES_AFTER = ["acesta", "aceasta", "aceștia", "acestea", "acela", "aceea", "aceia", "acelea"]
#: What a user is told about a selection.
SELECTION_MESSAGES = {
    "book": "Carte necunoscută sau ambiguă: {!r}",
    "line": "Selecție invalidă: {!r}",
    "range": "Interval de capitole invalid: {!r}",
    "chapter": "Capitol inexistent: {}. O carte are cel mult {} de capitole.",
    "empty": "Introduceți cel puțin o carte și un capitol.",
}
TRIM = " ,;:-–—„”\"'!?."
BLANK = "__________"
MAX_CHAPTER, MIN_CHAPTERS = 150, 3
TOTAL_ITEMS, QUALITY_ITEMS = 28, 23
STEM_CHARS, BLANK_CHARS, BLANK_WORDS, LEADING_WORDS = (25, 150), (25, 175), 6, 8
OVERLAP = 0.7
ANSWER_CAPS = (3, 5)
LETTER_CAP = 4

QUALITY_TERMS = PEOPLE + PLACES + DEITY
PERSONAL = PEOPLE + DEITY + COLLECTIVE


def term_group(value: str) -> str:
    return "person" if value in PEOPLE else "place" if value in PLACES else "deity" if value in DEITY else "other"


def gender(value: str) -> str:
    return "f" if value in FEMININE else "m"


def role(value: str) -> str:
    return "agent" if value in DEITY or value in COLLECTIVE or value in PEOPLE else "place" if value in PLACES else "other"


def swap_class(value: str) -> str:
    return "deity" if value in DEITY else "collective" if value in COLLECTIVE else "ordinary"


def lexicon_frame(spark: SparkSession) -> DataFrame:
    """lexicon(term, kind, role, gender, swap_class): a dimension of some 40 rows."""
    rows = [(t, term_group(t), role(t), gender(t), swap_class(t)) for t in dict.fromkeys(QUALITY_TERMS)]
    return spark.createDataFrame(rows, "term string, kind string, role string, gender string, swap_class string")
