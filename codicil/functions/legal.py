"""Structure, references and metadata of legal texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import bound

# Legal force by kind of act, and the declaration order of the kinds.
PRECEDENCE = {
    "constitution": 100,
    "constitutional_law": 90,
    "code": 80,
    "law": 70,
    "presidential_decree": 60,
    "presidential_resolution": 55,
    "cabinet_resolution": 50,
    "ministerial_act": 40,
    "local_act": 30,
    "court_decision": 20,
    "commentary": 10,
}
NON_BINDING = ("commentary", "court_decision")
SPECIFICITY = {"code": 2, "constitutional_law": 1}
LEVELS = ("qism", "bolim", "bob", "modda", "band", "qismcha")

# What opens a structural unit, by unit, in both Uzbek scripts, Russian and English.
_ARTICLE = "\\d+(?:\\s*[-–]\\s*\\d+|\\s+\\d+(?=\\s*[-–.．]))?"
_ROMAN = "([IVXLC]+|\\d+)"
OPENINGS = [
    ("qism", "(UMUMIY|MAXSUS|MAHSUS)\\s+QISM\\b"),
    ("qism", "(УМУМИЙ|МАХСУС|МАҲСУС)\\s+ҚИСМ\\b"),
    ("qism", "(ОБЩАЯ|ОСОБЕННАЯ)\\s+ЧАСТЬ\\b"),
    ("qism", "(GENERAL|SPECIAL)\\s+PART\\b"),
    ("qism", _ROMAN + "[-–\\s.]*(?:QISM|ҚИСМ)\\b"),
    ("bolim", _ROMAN + "[-–\\s.]*(?:BO[’'ʻ‘]?LIM|БЎЛИМ)\\b"),
    ("bolim", "(BIRINCHI|IKKINCHI|UCHINCHI|TO[’'ʻ‘]?RTINCHI|BESHINCHI|OLTINCHI|YETTINCHI|SAKKIZINCHI|TO[’'ʻ‘]?QQIZINCHI|O[’'ʻ‘]?NINCHI)\\s+BO[’'ʻ‘]?LIM\\b"),
    ("bolim", "(БИРИНЧИ|ИККИНЧИ|УЧИНЧИ|ТЎРТИНЧИ|БЕШИНЧИ|ОЛТИНЧИ|ЕТТИНЧИ|САККИЗИНЧИ|ТЎҚҚИЗИНЧИ|ЎНИНЧИ)\\s+БЎЛИМ\\b"),
    ("bolim", "(?:РАЗДЕЛ|SECTION)\\s+" + _ROMAN),
    ("bob", _ROMAN + "[-–\\s.]*(?:BOB|БОБ)\\b"),
    ("bob", "(?:BOB|БОБ)\\s*" + _ROMAN),
    ("bob", "(?:ГЛАВА|CHAPTER)\\s+" + _ROMAN),
    ("modda", "(" + _ARTICLE + ")\\s*[-–]?\\s*(?:MODDA|МОДДА)\\b"),
    ("modda", "(?:MODDA|МОДДА)\\s*[-–]?\\s*(" + _ARTICLE + ")"),
    ("modda", "(?:СТАТЬЯ|ARTICLE)\\s*(" + _ARTICLE + ")"),
]
CLAUSES = [
    ("band", "^\\s*(\\d+)\\s*\\)\\s+"),
    ("band", "^\\s*(\\d+)\\.\\s+(?=[A-ZА-ЯЎҚҒҲ«\"])"),
    ("qismcha", "^\\s*((?i:[a-zа-я]))\\s*\\)\\s+"),
]
ANNEX = "(?iU)^\\s*(ILOVA|ИЛОВА|ПРИЛОЖЕНИЕ|ANNEX|APPENDIX)\\b"
PREAMBLE = "(?iU)^\\s*(MUQADDIMA|МУҚАДДИМА|ПРЕАМБУЛА|PREAMBLE)\\b"

# References to the same act, each with a word that it holds, and to another (act and number in the groups
# named, words of which one of each group is there, pattern).
SELF_REFERENCES = [
    ("kodeks", "ushbu\\s+Kodeks\\w*\\s+(\\d+(?:-\\d+)?)[-–]?\\s*modda"),
    ("kodeks", "(\\d+(?:-\\d+)?)[-–]\\s*modda\\w*\\s+ushbu\\s+Kodeks"),
    ("кодекс", "ушбу\\s+Кодекс\\w*\\s+(\\d+(?:-\\d+)?)[-–]?\\s*модда"),
    ("кодекс", "(\\d+(?:-\\d+)?)[-–]\\s*модда\\w*\\s+ушбу\\s+Кодекс"),
    ("кодекс", "стать[её]?\\w*\\s+(\\d+(?:-\\d+)?)\\s+настоящего\\s+Кодекса"),
    ("кодекс", "настоящего\\s+Кодекса\\s+стать[её]?\\w*\\s+(\\d+(?:-\\d+)?)"),
    ("code", "Article\\s+(\\d+(?:-\\d+)?)\\s+of\\s+this\\s+Code"),
]
OTHER_REFERENCES = [
    (1, 2, (("kodeks", "qonun"), ("modda",)), "([A-ZА-ЯЎҚҒҲ][\\w’'ʼ\\s]{3,60}?(?:kodeks\\w*|qonun\\w*))\\w*\\s+(\\d+(?:-\\d+)?)[-–]?\\s*modda"),
    (2, 1, (("стать",), ("кодекса", "закона")), "стать[её]?\\w*\\s+(\\d+(?:-\\d+)?)\\s+([А-ЯЎҚҒҲ][\\w\\s]{3,60}?(?:кодекса|закона))"),
    (2, 1, (("code", "law"),), "Article\\s+(\\d+(?:-\\d+)?)\\s+of\\s+(?:the\\s+)?([A-Z][\\w\\s]{3,60}?(?:Code|Law))"),
]
# Kinds of act that a question names.
ACT_HINTS = [
    ("constitution", "konstitutsiya|конституц|constitution"),
    ("code", "fuqarolik\\s+kodeks|граждан\\w*\\s+кодекс|civil\\s+code"),
    ("code", "jinoyat\\s+kodeks|уголовн\\w*\\s+кодекс|criminal\\s+code"),
    ("code", "mehnat\\s+kodeks|трудов\\w*\\s+кодекс|labou?r\\s+code"),
    ("code", "soliq\\s+kodeks|налогов\\w*\\s+кодекс|tax\\s+code"),
    ("code", "ma[’'ʼ]?muriy\\s+javobgarlik|админист\\w*\\s+кодекс|administrative\\s+code"),
    ("code", "\\bkodeks|\\bкодекс|\\bcode\\b"),
    ("presidential_decree", "\\bfarmon|\\bуказ|\\bdecree"),
    ("cabinet_resolution", "vazirlar\\s+mahkamasi|кабинет\\s+министров|cabinet"),
]


def precedence(act_type: Column) -> Column:
    """Legal force; null for an unknown kind."""
    return F.coalesce(*[F.when(act_type == k, v) for k, v in PRECEDENCE.items()])


def declaration_order(act_type: Column) -> Column:
    return F.coalesce(*[F.when(act_type == k, i) for i, k in enumerate(PRECEDENCE)])


def classify(text: Column) -> Column:
    """struct(type, number) of the unit that a line opens, the first rule that fits; null for prose."""

    def hit(kind: str, pattern: str) -> Column:
        number = F.replace(F.trim(F.regexp_extract(text, pattern, 1)), F.lit("–"), F.lit("-"))
        return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("type"), number.alias("number")))

    special = [F.when(text.rlike(p), F.struct(F.lit(k).alias("type"), F.lit("").alias("number"))) for k, p in (("annex", ANNEX), ("preamble", PREAMBLE))]
    return F.coalesce(*special, *[hit(k, "(?iU)^\\s*" + p) for k, p in OPENINGS], *[hit(k, p) for k, p in CLAUSES])


def normalise_article_number(raw: Column) -> Column:
    """57 1, 57 - 1 and 57–1 are 57-1; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(raw), "[\\s\\-–]+", "-"), "^-+|-+$", ""), F.lit(""))


def split_heading(text: Column) -> Column:
    """What follows the first full stop or colon; null if nothing does."""
    return F.nullif(F.trim(F.get(F.split(text, "[.:]\\s+", 2), F.lit(1))), F.lit(""))


def _folded(text: Column) -> Column:
    """Upper and lower case as one, as patterns with (?iU) see letters."""
    return F.lower(F.upper(text))


def self_references(text: Column) -> Column:
    """Distinct numbers of articles of the same act, in the order of the patterns."""

    def found(t: Column) -> Column:
        none = F.array().cast("array<string>")
        # A text without a pattern's word is not searched for it.
        return F.array_distinct(F.flatten(F.array(*[F.when(F.contains(t["folded"], F.lit(w)), F.regexp_extract_all(t["text"], F.lit("(?iU)" + p), F.lit(1))).otherwise(none) for w, p in SELF_REFERENCES])))

    return F.when(text.isNotNull(), bound(F.struct(text.alias("text"), _folded(text).alias("folded")), found))


def other_references(text: Column) -> Column:
    """Distinct struct(act, article) of other acts named in the text; words for this act name no other."""
    none = F.array().cast("array<struct<act:string,article:string>>")

    def named(act: int, number: int, pattern: str, t: Column) -> Column:
        part = lambda x, g: F.regexp_extract(x, "(?iU)" + pattern, g)
        each = F.regexp_extract_all(t["text"], F.lit("(?iU)" + pattern), F.lit(0))
        return F.transform(each, lambda x: F.struct(F.trim(F.regexp_replace(part(x, act), "(?U)\\s+", " ")).alias("act"), part(x, number).alias("article")))

    def found(t: Column) -> Column:
        has = lambda words: reduce(Column.__and__, [reduce(Column.__or__, [F.contains(t["folded"], F.lit(w)) for w in some]) for some in words])
        every = F.flatten(F.array(*[F.when(has(words), named(act, number, p, t)).otherwise(none) for act, number, words, p in OTHER_REFERENCES]))
        return F.filter(F.array_distinct(every), lambda x: ~x["act"].rlike("(?iU)^(?:ushbu|ушбу|настоящ\\w*|this)\\b"))

    return F.when(text.isNotNull(), bound(F.struct(text.alias("text"), _folded(text).alias("folded")), found))


def infer_act_types(text: Column) -> Column:
    """Kinds of act that a question names; none for the plain word law."""
    hits = [F.when(text.rlike("(?iU)" + p), F.lit(k)) for k, p in ACT_HINTS]
    return F.array_distinct(F.array_compact(F.array(*hits)))


# The words around article, part and clause numbers.
_NUMBER = r"\d+(?:\s*[-–]\s*\d+)?"
_NAMES = {
    "article": r"(?:modda|модда|стать[яеиюйи]|ст\.?|article|art\.?)",
    "part": r"(?:qism|қисм|част[ьи]|part)",
    "clause": r"(?:band|банд|пункт|clause|point|item)",
}


def _reference_forms() -> list[re.Pattern]:
    """The number before its word (Uzbek) and behind it (Russian, English), part and clause optional."""
    before = lambda n: rf"(?P<{n}>{_NUMBER})\s*[-–]?\s*{_NAMES[n]}\w*"
    behind = lambda n: rf"{_NAMES[n]}\w*\s*[-–]?\s*(?P<{n}>{_NUMBER})"
    gap = r"\W{0,4}"
    uzbek = before("article") + "".join(f"(?:{gap}{before(n)})?" for n in ("part", "clause"))
    other = rf"{_NAMES['article']}\s*[-–]?\s*(?P<article>{_NUMBER})" + "".join(f"(?:{gap}{behind(n)})?" for n in ("part", "clause"))
    return [re.compile(p, re.IGNORECASE) for p in (uzbek, other)]


_FORMS = _reference_forms()


def find_references(text: str | None) -> list[dict]:
    """Provisions that a question names, in its order, each once."""
    found: dict[tuple, int] = {}
    text = text or ""
    for form in _FORMS:
        for m in form.finditer(text):
            key = tuple(re.sub(r"\s*[-–]\s*", "-", m[n].strip()) if m[n] else None for n in ("article", "part", "clause"))
            found.setdefault(key, m.start())
        text = form.sub(lambda m: " " * len(m[0]), text)
    return [dict(zip(("article", "part", "clause"), key)) for key in sorted(found, key=found.get)]


@pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("article", "part", "clause")])))
def parse_references(text: pd.Series) -> pd.Series:
    return text.map(find_references)


def citation_suffix(part: Column, clause: Column) -> Column:
    bits = F.array_compact(F.array(F.when(part.isNotNull(), F.concat(F.lit("part "), part)), F.when(clause.isNotNull(), F.concat(F.lit("clause "), clause))))
    return F.when(F.size(bits) > 0, F.concat(F.lit(", "), F.array_join(bits, ", "))).otherwise("")


def dates_in(text: Column) -> Column:
    """Dates written dd.mm.yyyy (also with - or /) or yyyy-mm-dd; impossible ones are left out."""
    dotted = F.transform(F.regexp_extract_all(text, F.lit("\\b(\\d{1,2}[./-]\\d{1,2}[./-]\\d{4})\\b"), F.lit(1)), lambda d: F.try_to_date(F.translate(d, "/-", ".."), "d.M.yyyy"))
    iso = F.transform(F.regexp_extract_all(text, F.lit("\\b(\\d{4}-\\d{2}-\\d{2})\\b"), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.array_compact(F.concat(dotted, iso))


# What a title says of an act's kind and standing, and who issued it; the first that fits counts.
TITLE_KINDS = (
    ("code", r"kodeks|кодекс|\bcode\b"),
    ("constitution", r"konstitutsiya|конституц|constitution"),
    ("presidential_decree", r"farmon|указ\s+президента"),
    ("presidential_resolution", r"prezident\w*\s+qaror|постановление\s+президента"),
    ("cabinet_resolution", r"vazirlar\s+mahkamasi|кабинета\s+министров"),
    ("law", r"\bqonun\b|\bзакон\b"),
    ("ministerial_act", r"buyruq|приказ|nizom|положение"),
)
STANDINGS = (
    ("repealed", r"kuchini\s+yo[’'ʻ‘]?qotgan|утратил\s+силу|repealed"),
    ("amended", r"o[’'ʻ‘]?zgartirish\s+kiritilgan|с\s+изменениями|amended"),
    ("not_yet_in_force", r"kuchga\s+kirmagan|не\s+вступил"),
)
ISSUERS = (
    ("Oliy Majlis", r"oliy\s+majlis"),
    ("President of the Republic of Uzbekistan", r"prezident|президент"),
    ("Cabinet of Ministers", r"vazirlar\s+mahkamasi|кабинет\s+министров"),
    ("Constitutional Court", r"konstitutsiyaviy\s+sud"),
    ("Supreme Court", r"oliy\s+sud|верховн\w+\s+суд"),
)
DOCUMENT_NUMBER = r"(?:№|N|son|сон|raqam)\s*[:\-]?\s*([A-ZА-Я0-9][A-ZА-Я0-9\-/]{1,24})"


def _first_named(text: Column, names: tuple, default: str | None) -> Column:
    return F.coalesce(*[F.when(text.rlike("(?iU)" + pattern), name) for name, pattern in names], F.lit(default))


def title_metadata(title: Column) -> Column:
    """A struct of act_type, status, doc_number and issuer; law and in_force where the title says nothing, else null."""
    number = F.nullif(F.regexp_extract(title, "(?iU)" + DOCUMENT_NUMBER, 1), F.lit(""))
    return F.struct(
        _first_named(title, TITLE_KINDS, "law").alias("act_type"),
        _first_named(title, STANDINGS, "in_force").alias("status"),
        number.alias("doc_number"),
        _first_named(title, ISSUERS, None).alias("issuer"),
    )
