"""Fixed pairs of the text functions: what each makes of given words, lines and messages."""

import pyspark.sql.functions as F
import pytest

from codicil.functions import answers, legal, text, translit
from codicil.operators import citations, ingest

LATIN = [("shartnoma", "шартнома"), ("o‘zbekiston", "ўзбекистон"), ("huquq", "ҳуқуқ"), ("shahar", "шаҳар"), ("choy", "чой"), ("ta'til", "таътил"), ("etish", "этиш"), ("yer", "ер"), ("mehnat", "меҳнат"), ("yo'l", "йўл"), ("yong'in", "ёнғин")]
CYRILLIC = [("ер", "yer"), ("эр", "er"), ("шартнома", "shartnoma"), ("ўзбекистон", "o‘zbekiston"), ("чой", "choy"), ("цирк", "tsirk")]
VARIANTS = [("litsenziya", "лицензия"), ("ko'rsatsa", "кўрсатса")]
LANGS = [("Mehnat shartnomasi qanday tuziladi va uchun", "uz-Latn"), ("Меҳнат шартномаси қандай тузилади", "uz-Cyrl"), ("В какой форме заключается договор и статья", "ru"), ("What is the law of the contract", "en"), ("", "uz-Latn"), ("Ҳуқуқ ва қонун тўғрисида matn", "uz-Cyrl")]
REFERENCES = [("155-moddasi 3-qismi", "155|3|"), ("155-modda 3-qism 2-band", "155|3|2"), ("ст. 12 и статья 15", "12||;15||"), ("155 - 1-modda", "155-1||"), ("hech narsa", "")]
STATED = [("**Risk level:** MEDIUM — x", "medium", "**Risk level:** HIGH — x"), ("Xavf darajasi: YUQORI", "high", "Xavf darajasi: HIGH"), ("Уровень риска — `НИЗКИЙ`", None, "Уровень риска — `НИЗКИЙ`"), ("none", None, "none")]
FOLLOW = [("Text\n---FOLLOW-UP---\n1. One?\n2. Two?\n3. Three?\n4. Four?", "One?|Two?|Three?"), ("Text", "")]
ANSWERS = [("See [S1] and [S7].", ["S1", "S2"], ["12"], "S1", "S7", "", False), ("As [S1, S2] say, article 999 applies", ["S1", "S2"], ["12"], "S1|S2", "", "999", False), ("word " * 90, ["S1"], ["12"], "", "", "", True), ("modda 12 [S2]", ["S1", "S2"], ["12"], "S2", "", "", False)]
FRAMED = [("Mehnat shartnomasi qanday bekor qilinadi", "mehnat shartnomasi bekor"), ("Nima qanday kerak bo'ladi huquq", "Nima qanday kerak bo'ladi huquq")]
TITLES = [("uz1", "ru1", "en1", "ru1"), ("uz2", None, "en2", "uz2"), (None, None, "en3", "en3"), (None, None, None, "short")]
SUFFIXES = [("3", "2", ", part 3, clause 2"), ("3", None, ", part 3"), (None, "2", ", clause 2"), (None, None, "")]
LINES = [("54-modda", "modda", "54"), ("III bob", "bob", "III"), ("ГЛАВА IV", "bob", "IV"), ("UMUMIY QISM", "qism", "UMUMIY"), ("57 1 -модда. X", "modda", "57 1"), ("Статья 15 июня", "modda", "15"), ("1) birinchi band", "band", "1"), ("a) kichik", "qismcha", "a"), ("ILOVA 1", "annex", ""), ("Oddiy gap shu yerda", None, None), ("БИРИНЧИ БЎЛИМ", "bolim", "БИРИНЧИ"), ("CHAPTER 7", "bob", "7"), ("Article 12. Title", "modda", "12")]
NUMBERS = [("57 1", "57-1"), ("57 - 1", "57-1"), ("57–1", "57-1"), ("", None), ("15", "15")]
REFS = [("ushbu Kodeksning 333-moddasi", "333", ""), ("ушбу Кодекснинг 333-моддаси", "333", ""), ("в статье 45 настоящего Кодекса", "45", ""), ("Fuqarolik kodeksining 54-moddasi", "", "Fuqarolik kodeksining:54"), ("Article 54 of the Civil Code", "", "Civil Code:54"), ("Article 7 of this Code", "7", ""), ("hech narsa", "", "")]
INTENTS = [("Salom!", "greeting"), ("Salom, qalaysiz?", "smalltalk"), ("спасибо", "smalltalk"), ("who are you", "capability"), ("Сен кимсан?", "capability"), ("Salom, mehnat shartnomasi haqida savolim bor edi", "legal"), ("", "legal"), ("Mehnat shartnomasi", "legal")]
SCOPES = [("Osh qanday pishiriladi?", False, True), ("Какая погода завтра?", False, True), ("Mehnat kodeksi 155-modda", True, False), ("What is the tax code penalty?", True, False), ("Ishdan boʻshash tartibi qanday?", False, False)]
DIRECTIVES = [("batafsil", "detailed", True), ("qisqacha tushuntir", "detailed", True), ("короче, пожалуйста", "brief", True), ("Please make it shorter", "brief", True), ("qisqacha aytganda, mehnat shartnomasi nima?", "brief", False), ("Mehnat shartnomasi nima?", None, False)]
CONTRACT = [("The party waives all rights. It is governed by the laws of England.", "waiver_of_statutory_rights|foreign_law_domestic_contract", 5), ("Governed by the laws of Uzbekistan. It shall automatically renew. Price and payment term.", "auto_renewal_no_notice", 2), ("A fine for the employee: unlimited liability", "unlimited_liability|employment_penalty", 1)]
KEYS = [("Mehnat kodeksi", "labour"), ("Уголовно-процессуальный кодекс", "criminal_procedure"), ("Tax Code", "tax"), ("Конституция", "constitution"), ("Budget code", "budget"), ("Nothing", None), ("Ер кодекси", "land")]
ACTS = [("a1", "Mehnat kodeksi"), ("a2", "Civil Code of the Republic"), ("a3", "The Civil Code")]
BODIES = [("a1", "12", "ushbu Kodeksning 5-moddasi"), ("a1", "13", "Article 54 of the Civil Code"), ("a1", "14", "Article 9 of the Lost Law")]
EDGES = {("a1", "12", "a1", "5", None, 0.95), ("a1", "13", "a3", "54", "Civil Code", 0.8), ("a1", "14", None, "9", "Lost Law", 0.4)}


def reference(x):
    return F.concat(x["article"], F.lit("|"), F.coalesce(x["part"], F.lit("")), F.lit("|"), F.coalesce(x["clause"], F.lit("")))


def other(x):
    return F.concat(x["act"], F.lit(":"), x["article"])


CASES = {
    "keys": (KEYS, lambda x: [citations.act_key(x)]),
    "intents": (INTENTS, lambda x: [answers.classify_intent(x)]),
    "scopes": (SCOPES, lambda x: [answers.looks_legal(x), answers.looks_non_legal(x)]),
    "directives": (DIRECTIVES, lambda x: [answers.detect_directive(x), F.coalesce(answers.is_bare_directive(x), F.lit(False))]),
    "contracts": (CONTRACT, lambda x: [F.array_join(F.transform(answers.red_flags(x), lambda f: f["code"]), "|"), F.size(answers.contract_topics(x))]),
    "latin": (LATIN, lambda x: [translit.latin_to_cyrillic(x)]),
    "cyrillic": (CYRILLIC, lambda x: [translit.cyrillic_to_latin(x)]),
    "languages": (LANGS, lambda x: [text.detect_language(x)]),
    "references": (REFERENCES, lambda x: [F.array_join(F.transform(legal.parse_references(x), reference), ";")]),
    "framing": (FRAMED, lambda x: [text.strip_framing(x, "uz")]),
    "stated": (STATED, lambda x: [answers.stated_risk(x), answers.rewrite_stated_risk(x, F.lit("high"))]),
    "follow-ups": (FOLLOW, lambda x: [F.array_join(answers.follow_ups(x), "|")]),
    "numbers": (NUMBERS, lambda x: [legal.normalise_article_number(x)]),
    "lines": (LINES, lambda x: [legal.classify(x)["type"], legal.classify(x)["number"]]),
    "references in bodies": (REFS, lambda x: [F.array_join(legal.self_references(x), ";"), F.array_join(F.transform(legal.other_references(x), other), ";")]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_fixed_pairs(spark, name):
    pairs, made = CASES[name]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, x string")
    got = {r[0]: tuple(r[1:]) for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(made(F.col("x")))]).collect()}
    assert got == {i: tuple(p[1:]) for i, p in enumerate(pairs)}


def test_fixed_rows_of_other_shapes(spark):
    df = spark.createDataFrame(VARIANTS, "word string, wanted string").select(F.array_contains(translit.script_variants(F.col("word")), F.col("wanted")).alias("x"))
    assert all(r.x for r in df.collect())
    df = spark.createDataFrame(TITLES, "uz string, ru string, en string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", text.display_title("ru", F.col("uz"), F.col("ru"), F.col("en"), F.lit("short"))).collect())
    df = spark.createDataFrame(SUFFIXES, "part string, clause string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", legal.citation_suffix(F.col("part"), F.col("clause"))).collect())
    df = spark.createDataFrame([(i, a, t, n, ["Civil code"]) for i, (a, t, n, *_) in enumerate(ANSWERS)], "i int, answer string, tags array<string>, articles array<string>, laws array<string>")
    got = {r.i: ("|".join(r.used_tags), "|".join(r.invalid_tags), "|".join(r.unverified_articles), r.rejected) for r in citations.validated(df).collect()}
    assert got == {i: tuple(a[3:]) for i, a in enumerate(ANSWERS)}
    edges = ingest.reference_edges(spark.createDataFrame(BODIES, "act_id string, article_number string, body string"), spark.createDataFrame(ACTS, "act_id string, name string"))
    assert {tuple(r[c] for c in ("source_act_id", "source_article", "target_act_id", "target_article", "target_raw", "confidence")) for r in edges.collect()} == EDGES
