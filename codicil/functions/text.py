"""Tokens, normal forms and small text functions, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .translit import cyrillic_flavour, cyrillic_share, fold_apostrophes

#: One spelling of a word character that Java and RE2 read alike.
WORD = "[\\p{L}\\p{N}_]"
TOKEN_MARKS = "ʻʼ‘’'´`"

# Interrogative and structural words that are not content, by language.
FRAMING = {
    "ru": (
        "какой", "какая", "какое", "какие", "каков", "какова", "каково", "каковы", "что", "как", "где", "когда", "почему", "зачем", "кто", "чем",
        "чему", "это", "такое", "является", "являются", "предусмотрено", "предусмотрена", "предусмотрены", "устанавливается", "установлен",
        "установлена", "происходит", "осуществляется", "признается", "признаётся", "грозит", "нужно", "надо", "можно", "ли", "же", "бы", "если",
        "или", "для", "при", "об", "обо", "про", "по", "из", "от", "до", "над", "под", "без", "за",
    ),
    "uz": (
        "qanday", "qanaqa", "qaysi", "qachon", "qayerda", "nima", "nimalar", "nega", "kim", "kimlar", "necha", "nechta", "qancha", "bo'ladi",
        "boladi", "boʻladi", "qilinadi", "tuziladi", "beriladi", "hisoblanadi", "deyiladi", "kerak", "mumkin", "uchun", "haqida", "bilan", "yoki",
        "va", "ham", "қандай", "қанақа", "қайси", "қачон", "қаерда", "нима", "нималар", "нега", "ким", "кимлар", "неча", "нечта", "қанча", "бўлади",
        "қилинади", "тузилади", "берилади", "ҳисобланади", "дейилади", "керак", "мумкин", "учун", "ҳақида", "билан", "ёки", "ва", "ҳам",
    ),
    "en": (
        "what", "which", "how", "when", "where", "why", "who", "whom", "whose", "is", "are", "was", "were", "be", "been", "does", "do", "did", "can",
        "could", "should", "would", "must", "the", "a", "an", "of", "for", "to", "in", "on", "at", "by", "with", "about", "under", "and", "or",
    ),
}
# Frequent words that tell languages apart.
MARKERS = {
    "uz": (
        "va", "uchun", "bilan", "boʻyicha", "boyicha", "hisoblanadi", "qonun", "modda", "kodeks", "shartnoma", "huquq", "majburiyat", "javobgarlik",
        "tomonidan", "belgilangan", "nazarda", "tutilgan", "oʻzbekiston", "ozbekiston", "respublikasi", "qanday", "nima", "qilish", "boʻlsa",
        "bolsa", "agar", "yoki", "ammo", "lekin",
    ),
    "ru": (
        "и", "в", "на", "по", "для", "статья", "закон", "кодекс", "договор", "право", "обязательство", "ответственность", "который", "если", "или",
        "не", "что", "как", "узбекистан", "республики", "лица", "случае", "порядке",
    ),
    "en": (
        "the", "and", "of", "to", "in", "is", "article", "law", "code", "contract", "right", "obligation", "liability", "what", "how", "if", "or",
        "shall", "must",
    ),
}
# Fixed value: a branch of law named in an oblique case.
BRANCH_OF_LAW = r"(?iU)\b(?:гражданск|уголовн|трудов|налогов|семейн|администрат\w*)\w*(?:ому|ого|ом)\s+прав(?:у|а|е)\b"


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


@pandas_udf(StringType())
def nfc_normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def normalize(text: Column) -> Column:
    """NFC, one apostrophe, single blanks, no blanks at the ends."""
    return F.trim(F.regexp_replace(fold_apostrophes(nfc_normalize(text)), "[ \\t\\u00a0]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def normalise_token(token: Column) -> Column:
    return F.translate(F.lower(token), TOKEN_MARKS, "")


def strip_branch_of_law(text: Column) -> Column:
    return F.regexp_replace(text, BRANCH_OF_LAW, " ")


def content_tokens(text: Column, family: str) -> Column:
    """Normalised words of two or more characters without numbers and framing words; all of them if none is left.

    ``family`` is uz, ru or en.
    """
    raw = F.regexp_extract_all(strip_branch_of_law(text), F.lit("[\\p{L}\\p{N}_" + TOKEN_MARKS + "]{2,}"), F.lit(0))
    raw = F.filter(F.transform(raw, normalise_token), lambda t: (t != "") & ~t.rlike("^\\p{Nd}+$"))
    framing = _words(FRAMING.get(family, FRAMING["en"]))

    def kept(all_: Column) -> Column:
        left = F.filter(all_, lambda t: ~F.array_contains(framing, t))
        return F.when(F.size(left) > 0, left).otherwise(all_)

    return F.transform(F.array(raw), kept)[0]


def strip_framing(text: Column, family: str) -> Column:
    """The content words, unless they are under 40 % of the text."""
    joined = F.array_join(content_tokens(text, family), " ")
    return F.when((joined != "") & (F.length(joined) >= 0.4 * F.length(F.trim(text))), joined).otherwise(text)


def stem_variants(token: Column) -> Column:
    """The token and, from six characters on, its prefix without the last three (four at least)."""
    word = normalise_token(token)
    n = F.length(word)
    stem = F.substring(word, F.lit(1), F.greatest(F.lit(4), n - 3))
    return F.when(word == "", F.array().cast("array<string>")).when(n >= 6, F.array_distinct(F.array(word, stem))).otherwise(F.array(word))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by a blank."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def detect_language(text: Column, default: str = "uz-Latn") -> Column:
    """uz-Latn, uz-Cyrl, ru or en by script, letters and marker words; ``default`` if nothing tells."""

    def of(text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_‘ʼ']+"), F.lit(0))
        flavour, own = cyrillic_flavour(text), text.rlike("(?U)[oOgG][‘'ʻ]|\\bq|\\bx")
        score = lambda words: F.struct(*[F.size(F.array_intersect(words, _words(v))).alias(k) for k, v in MARKERS.items()])
        cyrillic = lambda n: F.when(flavour == "uz", "uz-Cyrl").when((flavour == "ru") | (n["ru"] >= n["uz"]), "ru").otherwise("uz-Cyrl")
        latin = lambda n: F.when(n["uz"] > n["en"], "uz-Latn").when(n["en"] > n["uz"], "en").when(own, "uz-Latn").otherwise(default)
        by = lambda choose: bound(found, lambda words: bound(score(words), choose))
        # A share of 0.55 is mixed or above it.
        return F.when(text == "", default).when(cyrillic_share(text) >= 0.55, by(cyrillic)).otherwise(by(latin))

    return bound(normalize(F.coalesce(text, F.lit(""))), of)


def target_languages(lang: Column) -> Column:
    """Languages to search for a question, its own first."""
    # The order of the rest.
    rest = F.array(*[F.lit(x) for x in ("uz-Latn", "uz-Cyrl", "ru", "en")])
    return F.array_distinct(F.concat(F.array(lang), rest))


def estimate_tokens(text: Column, chars_per_token: float = 3.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars_per_token)).cast("int")


def blended_tokens(text: Column) -> Column:
    """1.7 characters a token for Cyrillic, 3.5 for the rest, and one more; 1 for an empty text."""
    cyrillic = F.regexp_count(text, F.lit("[\\u0400-\\u04FF]"))
    n = F.floor(cyrillic / 1.7 + (F.length(text) - cyrillic) / 3.5) + 1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1).otherwise(n).cast("int")


def excerpt(text: Column, most: int = 260) -> Column:
    """At most ``most`` characters, cut at a blank if that keeps over 60 %, with an ellipsis."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > 0.6 * most), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def answer_summary(text: Column, most: int = 350) -> Column:
    """Without Markdown marks and with single blanks, cut to ``most``."""
    plain = F.regexp_replace(text, "[#*`_>]+", "")
    return F.substring(F.trim(F.regexp_replace(plain, "\\s+", " ")), 1, most)


def citation(law: Column, article: Column) -> Column:
    return F.when(article.isNotNull(), F.concat(law, F.lit(", "), article, F.lit("-modda"))).otherwise(law)


def display_title(lang: str, uz: Column, ru: Column, en: Column, short: Column) -> Column:
    """The title in the asked language, else the next that exists."""
    by = {"ru": (ru, uz, en), "en": (en, uz, ru)}.get(lang, (uz, ru, en))
    return F.coalesce(*by, short)


def markup_safe(text: Column) -> Column:
    """Without control characters other than tab and line ends, and with &, < and > as entities."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.replace(F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def question_with_document(question: Column, document: Column, most: int = 4000) -> Column:
    """What is searched for when a document is asked about: the question and the document's beginning."""
    return F.when(F.coalesce(F.length(document), F.lit(0)) == 0, question).otherwise(F.concat(question, F.lit("\n\n"), F.substring(document, 1, most)))
