"""Routing questions and reading answers: intent, scope, length, risk, contract screening."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .legal import infer_act_types

_END = "[\\s!.,?…]*$"
# Whole messages that are not questions of law.
GREETING = (
    "salom(?:lar)?|assalom(?:u)?\\s*alaykum|assalom|vaalaykum\\s*assalom|valeykum\\s*assalom|xayrli\\s*(?:kun|kech|tong|ertalab)"
    "|салом(?:лар)?|ассалом(?:у)?\\s*алайкум|ассалом|хайрли\\s*(?:кун|кеч|тонг)"
    "|привет|здравствуй(?:те)?|добр(?:ый|ое)\\s*(?:день|вечер|утро)|hi|hello|hey|good\\s*(?:morning|afternoon|evening)"
)
SMALLTALK = (
    "qalay(?:siz|san)?|yaxshimisiz|yaxshimisan|ishlar\\s*qalay|nima\\s*gap|nima\\s*gaplar|kayfiyat(?:ingiz)?\\s*qalay|tinchlikmi"
    "|қалай(?:сиз|сан)?|яхшимисиз|яхшимисан|ишлар\\s*қалай|нима\\s*гап|нима\\s*гаплар|тинчликми"
    "|как\\s*дела|как\\s*ты|как\\s*вы|что\\s*нового|как\\s*жизнь|how\\s*are\\s*you|hows?\\s*it\\s*going|whats?\\s*up"
    "|rahmat(?:\\s*sizga)?|raxmat|раҳмат|рахмат|спасибо|thanks?|thank\\s*you|ok(?:ay)?|xop|хоп|zor|zo{0,2}r"
)
SMALLTALK_OPENING = "(?:(?:salom|assalom(?:u)?\\s*alaykum|салом|привет|hi|hello|hey)[\\s,!.-]*)?"
CAPABILITY = (
    "(?:sen|siz)\\s*kim(?:san|siz)?|kim\\s*(?:san|siz)|o?zingni\\s*tanishtir|nima\\s*(?:qila\\s*olasan|qila\\s*olasiz|ish\\s*qilasan)"
    "|qanday\\s*yordam\\s*(?:bera\\s*olasan|berasiz)|sen\\s*nima|bu\\s*nima|(?:сен|сиз)\\s*ким(?:сан|сиз)?|ким\\s*(?:сан|сиз)"
    "|нима\\s*қила\\s*оласан|қандай\\s*ёрдам\\s*бера\\s*оласан|кто\\s*ты|кто\\s*вы|что\\s*ты\\s*умеешь|что\\s*вы\\s*умеете"
    "|чем\\s*(?:ты|вы)\\s*поможешь|who\\s*are\\s*you|what\\s*(?:can|do)\\s*you\\s*do"
)
# Requests for a longer or a shorter answer, and words that ask nothing themselves.
DETAILED = (
    "batafsil|to[’'ʼ`]?liq|kengroq|tushuntir\\w*|misol\\w*\\s+bilan|davom\\s+et\\w*|analiz\\s+qil\\w*|chuqurroq|ko[’'ʼ`]?proq"
    "|батафсил|тўлиқ|кенгроқ|тушунтир\\w*|мисол\\w*\\s+билан|давом\\s+эт\\w*|чуқурроқ"
    "|подробн\\w*|детальн\\w*|разверн\\w*|поподробнее|объясни\\w*|продолж\\w*"
    "|detailed|in\\s+detail|explain\\s+more|elaborate|expand|longer|long\\s+answer|more\\s+detail\\w*|go\\s+deeper|continue"
)
BRIEF = (
    "qisqa\\w*|juda\\s+qisqa|bir\\s+gapda|xulosa\\s+qil\\w*|қисқа\\w*|жуда\\s+қисқа|бир\\s+гапда|хулоса\\s+қил\\w*"
    "|кратк\\w*|короче|покороче|вкратце|в\\s+двух\\s+словах|резюм\\w*|одним\\s+предложением"
    "|short\\w*|brief\\w*|summar\\w*|tl;?dr|in\\s+one\\s+sentence|concise"
)
FILLER = (
    "iltimos|please|пожалуйста|men|menga|meni|manga|bu|buni|shuni|uni|это|мне|мой|моя|it|this|that|the|a|an|me|my|javob\\w*|ответ\\w*|answer"
    "|ayt\\w*|айт\\w*|yoz\\w*|ёз\\w*|ber\\w*|бер\\w*|qil\\w*|қил\\w*|скажи\\w*|напиши\\w*|расскаж\\w*|дай|сделай|say|tell|write|give|make|keep"
)
# Words that place a question inside or outside the law.
LEGAL = (
    "qonun\\w*|huquq\\w*|kodeks\\w*|modda\\w*|jazo\\w*|jarima\\w*|sud\\w*|advokat\\w*|shartnoma\\w*|majburiyat\\w*|javobgarlik\\w*|nizom\\w*"
    "|farmon\\w*|qaror\\w*|қонун\\w*|ҳуқуқ\\w*|кодекс\\w*|модда\\w*|жазо\\w*|жарима\\w*|суд\\w*|адвокат\\w*|шартнома\\w*|жавобгарлик\\w*"
    "|фармон\\w*|қарор\\w*|закон\\w*|прав\\w*|стать\\w*|наказан\\w*|штраф\\w*|договор\\w*|обязанност\\w*|ответственност\\w*|указ\\w*"
    "|постановлен\\w*|иск\\w*|legal|law|laws|article|code|court|penalt\\w*|fine|contract|liab\\w*|attorney|lawyer|statut\\w*|regulation\\w*"
)
EVERYDAY = (
    "osh\\b|palov|pishir\\w*|retsept\\w*|taom\\w*|ovqat\\w*|пишир\\w*|таом\\w*|овқат\\w*|готов(?:ить|лю)\\w*|рецепт\\w*|блюд\\w*|кухн\\w*"
    "|\\bcook\\w*|\\brecipe\\w*|\\bdish(?:es)?\\b|\\bcuisine\\b|ob-havo|обҳаво|об-ҳаво|погод\\w*|температур\\w*|\\bweather\\b|\\bforecast\\b"
    "|\\btemperature\\b|futbol\\w*|sport\\w*|musobaqa\\w*|футбол\\w*|спорт\\w*|матч\\w*|\\bfootball\\b|\\bsports?\\b|\\bmatch(?:es)?\\b"
    "|hazil\\w*|latifa\\w*|qo\\w?shiq\\w*|\\bkino\\b|\\bfilm\\w*|ҳазил\\w*|латифа\\w*|қўшиқ\\w*|шутк\\w*|анекдот\\w*|песн\\w*|музык\\w*"
    "|\\bфильм\\w*|\\bjokes?\\b|\\bsongs?\\b|\\bmusic\\b|\\bmovies?\\b|tarjima\\w*|таржима\\w*|перевед\\w*|перевод\\w*|\\btranslat\\w*"
    "|\\bpython\\b|javascript|\\bsql\\b|dastur\\w*|программир\\w*|\\bprogramm\\w*|\\bcodes?\\b\\s+(?:for|in)\\b"
)
# Subjects of high risk, and what a stated level may read.
HIGH_RISK = [
    ("criminal liability", "jinoy|уголовн|criminal|jazo\\b|наказан|punish|prison|qamoq"),
    ("procedural deadline", "deadline|muddat|срок|limitation|da[’'ʼ]?vo muddati|исковая давность"),
    ("tax or penalty exposure", "soliq|налог\\w*|tax\\b|penalt|jarima|штраф"),
    ("employment termination", "ishdan bo[’'ʼ]?shat|увольнен|dismissal|termination of employment"),
    ("licensing requirement", "litsenziya|лиценз|licen[cs]e|permit|ruxsatnoma"),
    ("insolvency", "bankrot|банкрот|insolven|liquidat|tugatish"),
    ("immigration status", "migration|migratsiya|виза|visa|deport|fuqarolik\\s+olish"),
]
HEDGING = "do(es)? not (address|cover|specify)|topilmadi|не\\s+(содержит|регулирует)|insufficient"
STATED = "(?:risk\\s*level|xavf\\s*darajasi|хавф\\s*даражаси|уровень\\s*риска)[\\s`*:\\-–]*"
STATED_LEVELS = {
    "low": ("low", "past", "низкий", "паст"),
    "medium": ("medium", "oʻrta", "o‘rta", "orta", "средний", "ўрта"),
    "high": ("high", "yuqori", "высокий", "юқори"),
}
# Clauses of contracts that call for a look, and the topics a contract covers.
RED_FLAGS = [
    ("waiver_of_statutory_rights", "voz\\s+kechadi|отказыва\\w+\\s+от\\s+прав|waives?\\s+(?:all|any)\\s+rights?"),
    ("foreign_law_domestic_contract", "(?:qonunchiligi\\s+qo[’'ʻ‘]?llaniladi|регулируется\\s+правом|governed\\s+by\\s+the\\s+laws?\\s+of)(?!.{0,40}(O[’'ʻ‘]?zbekiston|Узбекистан|Uzbekistan))"),
    ("unlimited_liability", "cheklanmagan\\s+javobgarlik|неограниченн\\w+\\s+ответственност|unlimited\\s+liability"),
    ("employment_penalty", "jarima.{0,40}xodim|xodim\\w*.{0,40}jarima|штраф.{0,40}работник|работник\\w*.{0,40}штраф|fine.{0,30}employee|employee.{0,30}fine"),
    ("auto_renewal_no_notice", "avtomatik\\s+ravishda\\s+uzaytiriladi|автоматически\\s+продлевается|automatically\\s+renew"),
    ("arbitration_abroad", "xalqaro\\s+arbitraj|международн\\w+\\s+арбитраж|arbitration\\s+in\\s+(?!Tashkent)"),
]
TOPICS = [
    ("subject_matter", "predmet|предмет|subject"),
    ("price", "narx|to[’'ʻ‘]?lov|цена|оплат|price|payment"),
    ("term", "muddat|срок|term\\b|duration"),
    ("termination", "bekor\\s+qil|расторж|terminat"),
    ("liability", "javobgarlik|ответственност|liabilit|penalt|neustoyka|неустойк"),
    ("force_majeure", "fors[- ]?major|непреодолим|force\\s+majeure"),
    ("dispute", "nizo|спор|dispute|arbitr|sud\\b|суд\\b"),
    ("governing_law", "qonunchilik|применим\\w+\\s+прав|governing\\s+law"),
    ("confidentiality", "maxfiy|конфиденциальн|confidential"),
]


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?isU)" + pattern), F.lit(False))


def _whole(text: Column, pattern: str, opening: str = "") -> Column:
    return _has(text, f"^{opening}(?:{pattern}){_END}")


def classify_intent(message: Column, most_words: int = 6) -> Column:
    """greeting, smalltalk, capability or, for anything longer or unclear, legal."""
    text = F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(message, F.lit("")), "ʼʻ‘’'`", ""), "\\s+", " ")))
    long = (text == "") | (F.size(F.split(text, " ")) > most_words)
    return F.when(long, "legal").when(_whole(text, CAPABILITY), "capability").when(_whole(text, SMALLTALK, SMALLTALK_OPENING), "smalltalk").when(_whole(text, GREETING), "greeting").otherwise("legal")


def looks_legal(question: Column, numbers: Column | None = None) -> Column:
    """Names an article (``numbers``), a kind of act or a legal word."""
    named = F.size(infer_act_types(question)) > 0
    if numbers is not None:
        named = named | (F.size(numbers) > 0)
    return F.coalesce(named, F.lit(False)) | _has(question, f"\\b(?:{LEGAL})\\b")


def looks_non_legal(question: Column) -> Column:
    """Positively about an everyday subject; not the negation of ``looks_legal``."""
    return _has(question, EVERYDAY)


def is_everyday(question: Column) -> Column:
    return looks_non_legal(question) & ~looks_legal(question)


def detect_directive(message: Column) -> Column:
    """detailed, brief or null; both together ask for detail."""
    return F.when(_has(message, f"\\b(?:{DETAILED})\\b"), "detailed").when(_has(message, f"\\b(?:{BRIEF})\\b"), "brief")


def is_bare_directive(message: Column) -> Column:
    """Nothing is left once requests for a length and fillers are taken out."""
    left = message
    for words in (DETAILED, BRIEF, FILLER):
        left = F.regexp_replace(left, f"(?iU)\\b(?:{words})\\b", " ")
    left = F.regexp_replace(left, "[^\\p{L}\\p{N}_\\s]", " ")
    return detect_directive(message).isNotNull() & (F.trim(F.regexp_replace(left, "\\s+", " ")) == "")


def stated_risk(answer: Column) -> Column:
    words = "|".join(w for group in STATED_LEVELS.values() for w in group)
    word = F.lower(F.regexp_extract(answer, f"(?iU){STATED}({words})", 1))
    return F.coalesce(*[F.when(word.isin(*group), level) for level, group in STATED_LEVELS.items()])


def rewrite_stated_risk(answer: Column, level: Column) -> Column:
    """The first stated level replaced by ``level``."""
    words = "|".join(w for group in STATED_LEVELS.values() for w in group)
    found = F.regexp_extract(answer, f"(?isU)^(.*?{STATED})(?:{words})", 1)
    rest = F.regexp_extract(answer, f"(?isU)^.*?{STATED}(?:{words})(.*)$", 1)
    return F.when(_has(answer, f"{STATED}(?:{words})"), F.concat(found, F.upper(level), rest)).otherwise(answer)


def ensure_stated_risk(answer: Column, level: Column, label: str, factors: Column) -> Column:
    """The stated level made to agree, or a line with level and reasons added."""
    why = F.coalesce(F.nullif(F.array_join(factors, "; "), F.lit("")), F.lit("Assessed from the retrieved provisions."))
    line = F.concat(F.rtrim(answer), F.lit(f"\n\n**{label}** "), F.upper(level), F.lit(" — "), why)
    return F.when(stated_risk(answer).isNotNull(), rewrite_stated_risk(answer, level)).otherwise(line)


def risk_factors(text: Column) -> Column:
    """Subjects of high risk that a question and its answer touch."""
    return F.array_compact(F.array(*[F.when(_has(text, p), F.lit(name)) for name, p in HIGH_RISK]))


def red_flags(text: Column) -> Column:
    """struct(code, excerpt) of each clause pattern: its first place with 80 characters before and 120 behind."""

    def flag(code: str, pattern: str) -> Column:
        found = F.regexp_extract(text, f"(?isU)({pattern})", 1)
        at = F.instr(text, found)
        start = F.greatest(F.lit(1), at - 80)
        part = F.substring(text, start, at - start + F.length(found) + 120)
        return F.when(_has(text, pattern), F.struct(F.lit(code).alias("code"), F.trim(part).alias("excerpt")))

    return F.array_compact(F.array(*[flag(*f) for f in RED_FLAGS]))


def contract_topics(text: Column) -> Column:
    """Topics that a contract covers, or the first five if it names none."""
    found = F.array_compact(F.array(*[F.when(_has(text, p), F.lit(name)) for name, p in TOPICS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(name) for name, _ in TOPICS[:5]]))


FOLLOW_UPS = "\n---FOLLOW-UP---[ \t]*\n((?:\\d+\\.[ \t]+[^\n]+\n?){1,5})"


def follow_ups(answer: Column, most: int = 3) -> Column:
    """Up to ``most`` numbered questions behind the marker, without their numbers."""
    lines = F.split(F.regexp_extract(answer, "(?i)" + FOLLOW_UPS, 1), "\n")
    return F.slice(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^\\d+\\.\\s*", ""))), lambda x: x != ""), 1, most)


def without_follow_ups(answer: Column) -> Column:
    return F.rtrim(F.regexp_replace(answer, "(?is)" + FOLLOW_UPS + ".*$", ""))
