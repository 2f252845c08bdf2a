"""Uzbek Latin and Cyrillic, script and orthography, as column expressions."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

# The apostrophe glyphs in use, folded to U+2018.
APOSTROPHES = "ʻʼ’'`´"
FOLDED = "‘"

# Fixed values, in the order in which they apply.
LATIN_TO_CYRILLIC = [
    ("o‘", "ў"), ("g‘", "ғ"), ("ch", "ч"), ("sh", "ш"), ("yo", "ё"), ("yu", "ю"), ("ya", "я"), ("ye", "е"), ("ng", "нг"),
    ("a", "а"), ("b", "б"), ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("h", "ҳ"), ("i", "и"), ("j", "ж"), ("k", "к"),
    ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("q", "қ"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"),
    ("v", "в"), ("x", "х"), ("y", "й"), ("z", "з"), ("‘", "ъ"),
]
CYRILLIC_TO_LATIN = [
    ("ў", "o‘"), ("ғ", "g‘"), ("ч", "ch"), ("ш", "sh"), ("щ", "sh"), ("ё", "yo"), ("ю", "yu"), ("я", "ya"), ("ц", "ts"),
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "j"), ("з", "z"), ("и", "i"), ("й", "y"),
    ("к", "k"), ("қ", "q"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"),
    ("у", "u"), ("ф", "f"), ("х", "x"), ("ҳ", "h"), ("ъ", "ʼ"), ("ь", ""), ("ы", "i"), ("э", "e"),
]
UZBEK_ONLY = "ўқғҳЎҚҒҲ"
RUSSIAN_ONLY = "щыэьъЩЫЭЬЪ"


def _cased(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each pair with its title-case and upper-case forms behind it."""
    forms = (lambda s: s, lambda s: s[:1].upper() + s[1:], str.upper)
    return list(dict.fromkeys((f(a), f(b)) for a, b in pairs for f in forms))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Pairs whose key is one character go through one ``translate`` or a fold of ``replace``, in order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, FOLDED * len(APOSTROPHES))


def latin_to_cyrillic(text: Column) -> Column:
    """A word-initial e is э, any other е; the glottal stop is ъ."""
    text = F.regexp_replace(fold_apostrophes(text), r"(?U)(?<![\p{L}\p{N}_])e", "э")
    text = F.regexp_replace(text, r"(?U)(?<![\p{L}\p{N}_])E", "Э")
    return _replaced(text, _cased(LATIN_TO_CYRILLIC))


def cyrillic_to_latin(text: Column) -> Column:
    """A word-initial е is ye, any other e."""
    text = F.regexp_replace(text, r"(?U)(?<![\p{L}\p{N}_])е", "ye")
    text = F.regexp_replace(text, r"(?U)(?<![\p{L}\p{N}_])Е", "Ye")
    return _replaced(text, _cased(CYRILLIC_TO_LATIN))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def script_of(text: Column) -> Column:
    """latn, cyrl, mixed (a Cyrillic share from 0.2 to 0.8) or unknown (no letter of either)."""
    cyrillic, latin = _count(text, "[\\u0400-\\u04FF]"), _count(text, "[A-Za-z]")
    share = cyrillic / F.when(cyrillic + latin > 0, cyrillic + latin)
    return F.when(share.isNull(), "unknown").when(share > 0.8, "cyrl").when(share < 0.2, "latn").otherwise("mixed")


def cyrillic_share(text: Column) -> Column:
    counts = F.array(F.struct(_count(text, "[\\u0400-\\u04FF]").alias("c"), _count(text, "[A-Za-z]").alias("l")))
    return F.transform(counts, lambda n: F.coalesce(n["c"] / F.when(n["c"] + n["l"] > 0, n["c"] + n["l"]), F.lit(0.0)))[0]


def cyrillic_flavour(text: Column) -> Column:
    """uz or ru by which language's own letters are more varied; null if neither leads."""
    n = lambda own: reduce(Column.__add__, [F.contains(text, F.lit(x)).cast("int") for x in own])
    uz, ru = n(UZBEK_ONLY), n(RUSSIAN_ONLY)
    return F.when(uz > ru, "uz").when(ru > uz, "ru")


def script_variants(text: Column) -> Column:
    """The spellings of a text in both scripts, itself first; the Latin ts also as ц."""
    cyrillic = latin_to_cyrillic(text)
    forms = [text, cyrillic, F.replace(cyrillic, F.lit("тс"), F.lit("ц")), cyrillic_to_latin(text)]
    return F.slice(F.array_distinct(F.filter(F.array(*forms), lambda f: f != "")), 1, 4)
