"""What questions ask for, phrases in the branches, and each step of the whole retrieval course."""

import re

import pyspark.sql.functions as F
import pytest

from codicil.functions.text import FRAMING
from codicil.functions.translit import CYRILLIC_TO_LATIN, LATIN_TO_CYRILLIC, _cased
from codicil.operators import dense, fusion, hybrid, lexical, query_terms

MARKS = "ʻʼ‘’'´`"


def cyrillic(text):
    text = re.sub(r"(?<!\w)e", "э", re.sub("[ʻʼ’'`´]", "‘", text))
    for a, b in _cased(LATIN_TO_CYRILLIC):
        text = text.replace(a, b)
    return text


def latin(text):
    text = re.sub(r"(?<!\w)е", "ye", text)
    for a, b in _cased(CYRILLIC_TO_LATIN):
        text = text.replace(a, b)
    return text


def token(w):
    return "".join(c for c in w.lower() if c not in MARKS)


def content(text, language):
    family = "uz" if language.startswith("uz") else language
    words = [t for t in map(token, re.findall(rf"[\w{MARKS}]{{2,}}", text)) if t and not t.isdigit()]
    return [t for t in words if t not in FRAMING[family]] or words


def stems(t, language):
    return [t] if language == "en" or len(t) < 6 else [t, t[: max(4, len(t) - 3)]]


def glossary(groups):
    table, english = {}, {token(t) for g in groups for t, e in g if e}
    for g in groups:
        forms = {" ".join(map(token, x.split())) for t, e in g for x in ([t] if e else [t, cyrillic(t)])}
        for f in forms:
            table.setdefault(f, set()).update(forms - english - {f})
    return table


def twin(text, language, table):
    forms = [text]
    if language != "en":
        c = cyrillic(text)
        for v in (c, c.replace("тс", "ц"), latin(text)):
            if v and v not in forms:
                forms.append(v)
    out = []
    for v in forms[:4]:
        words = content(v, language)
        added = [s for n in range(1, 7) for i in range(len(words) - n + 1) for s in sorted(table.get(" ".join(words[i : i + n]), ())) if s not in words]
        for w in words + added:
            out += [f for f in stems(w, language) if f not in out]
    return [x.split() for x in (out or [" ".join(text.split()).lower() or "x"])[:60]]


GROUPS = [
    [("xodim", False), ("ishchi", False), ("работник", False), ("employee", True)],
    [("ish beruvchi", False), ("работодатель", False), ("employer", True)],
    [("o'z tashabbusi", False), ("o'zi", False), ("xodimning tashabbusi", False), ("own initiative", True)],
    [("ishchi", False), ("mehnatkash odam", False)],
]
ASKED = [
    (1, "Ishchi o'z tashabbusi bilan ketishi mumkinmi?", "uz-Latn"),
    (2, "How does an employee leave on own initiative?", "en"),
    (3, "Права работник и ish beruvchi 2024", "ru"),
    (4, "Nima qilish kerak", "uz-Latn"),
    (5, "", "uz-Latn"),
    (6, None, "en"),
    (7, "?! 12 345", "en"),
    (8, "Ходим ўзи nafaqa tsex", "uz-Cyrl"),
    (9, " ".join(f"soʻz{chr(97 + k % 26)}{chr(97 + k // 26)}uzun" for k in range(80)), "uz-Latn"),
    (10, "employer employer xodimning tashabbusi", "en"),
]


def test_terms_equal_a_plain_twin(spark):
    groups = spark.createDataFrame([(g, t, e) for g, some in enumerate(GROUPS) for t, e in some], "group int, term string, english boolean")
    synonyms = query_terms.synonym_table(groups)
    table = glossary(GROUPS)
    assert {(r.phrase, r.synonym) for r in synonyms.collect()} == {(p, s) for p, some in table.items() for s in some}
    asked = spark.createDataFrame(ASKED, "query_id long, text string, language string")
    got = {}
    for r in query_terms.query_terms(asked, synonyms).orderBy("query_id", "ix").collect():
        assert r.ix == len(got.setdefault(r.query_id, []))
        got[r.query_id].append(r.words)
    want = {q: twin(t or "", lang, table) for q, t, lang in ASKED}
    assert got == want
    assert any(len(w) > 1 for w in got[1]) and len(got[9]) == 60 and got[5] == [["x"]] and ["own", "initiative"] not in got[1]
    assert query_terms.query_terms(asked.where("false"), synonyms).count() == 0
    assert {r.query_id for r in query_terms.query_terms(asked).collect()} == {q for q, _, _ in ASKED}


CHUNKS = [
    (1, "act", "xodimning tashabbusi", "mehnat shartnomasi xodimning tashabbusi bilan"),
    (2, "act", "xodimning mehnati", "tashabbusi xodimning"),
    (3, "act", None, "xodimning tashabbuslari va boshqa"),
    (4, "law", "boshqa", "hech narsa"),
]


def test_phrases_count_places_once(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, law_name string, heading string, text string")
    phrases = spark.createDataFrame([(1, 0, ["xodimning", "tashabbus"]), (1, 1, ["mehnat", "shartnomasi", "x"]), (2, 0, ["bilan", "hech"])], "query_id long, ix int, words array<string>")
    posts = lexical.postings(chunks)
    places = {(r.query_id, r.chunk_id, r.field, r.pos) for r in lexical.phrase_places(posts, phrases).collect()}
    assert places == {(1, 1, "heading", 0), (1, 1, "heading", 1), (1, 1, "text", 0), (1, 1, "text", 1), (1, 1, "text", 2), (1, 1, "text", 3), (1, 3, "text", 0), (1, 3, "text", 1)}
    terms = spark.createDataFrame([(1, "xodim"), (3, "hech")], "query_id long, term string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.sparse_branch(chunks, terms, phrases=phrases).collect()}
    # Chunk 1: two words of the heading, four of the text; words that the prefix reaches count once.
    w = {(1, 1): 0.4 * 2 + 0.2 * 4, (1, 2): 0.4 + 0.2, (1, 3): 0.2 * 2, (3, 4): 0.2}
    assert got == {k: pytest.approx(v / (v + 1)) for k, v in w.items()}
    title = {(r.query_id, r.chunk_id): (r.phrase_hit, r.rank) for r in lexical.title_branch(chunks, terms, phrases).collect()}
    assert title == {(1, 1): (True, 1), (1, 2): (False, 2)}


def test_filters_come_before_every_cut(spark):
    questions = spark.createDataFrame([(1, ["law"]), (2, None), (3, ["none"]), (4, [])], "query_id long, act_types array<string>")
    chunks = spark.createDataFrame([(i, "code" if i < 9 else "law", "n", "h word", "word " * (20 - i), [1.0, i / 100.0]) for i in range(12)], "chunk_id long, act_type string, law_name string, heading string, text string, embedding array<double>")
    masks, marked = hybrid.filters(questions, chunks)
    terms = spark.createDataFrame([(q, "wor") for q in (1, 2, 3, 4)], "query_id long, term string")
    none = spark.createDataFrame([], "query_id long, ix int, words array<string>")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in (1, 2, 3, 4)], "query_id long, query array<double>").join(masks, "query_id")
    for found in (lexical.sparse_branch(marked, terms, 2, phrases=none, masks=masks), lexical.title_branch(marked, terms, none, 2, masks=masks), dense.knn(queries, marked.select("chunk_id", "embedding", "bit"), 2)):
        by = {}
        for r in found.collect():
            by.setdefault(r.query_id, set()).add(r.chunk_id)
        assert by == {1: {9, 10}, 2: {0, 1}, 4: {0, 1}}


META = "act_id string, article_number string, language string, act_type string, heading string, law_name string, text string, title_terms array<string>, act_terms array<string>, ordinal int"


def about(chunk, act_type="law", heading=None, law="l"):
    return ("a", str(chunk), "en", act_type, heading, law, f"text {chunk}", (heading or "").split(), law.split(), chunk)


def candidates(spark, rows):
    return spark.createDataFrame([(1, c, f, p, *about(c, *rest)) for p, (c, f, *rest) in enumerate(rows, 1)], f"query_id long, chunk_id long, fused_score double, pos int, {META}")


def questions(spark):
    return spark.createDataFrame([(1, "ask words", ["ask", "words"])], "query_id long, text string, terms array<string>")


def scorer(scores):
    def score(question, passage):
        import pandas as pd

        return pd.Series([scores.get(int(p.rsplit(" ", 1)[1]), 0.0) for p in passage], dtype="float64")

    return score


def order(df):
    return [r.chunk_id for r in df.orderBy("pos").collect()]


def test_each_step_changes_the_order(spark):
    rows, q = candidates(spark, [(1, 0.09), (2, 0.08, "law", "ask words"), (3, 0.07), (4, 0.06)]), questions(spark)
    judged = hybrid.reranked(rows, q, 3, scorer({1: 0.1, 2: 0.2, 3: 0.9, 4: 0.3}))
    assert order(judged) == [3, 4, 2]
    assert order(hybrid.shown(judged, 12, 0.25, 3)) == [3, 4]
    assert order(hybrid.shown(hybrid.reranked(rows, q, 4, scorer({})), 2, 0.25, 3)) == [1, 2, 3]
    plain = hybrid.reranked(rows, q, 3, None)
    assert order(hybrid.shown(plain, 2, 0.25, 3)) == [1, 2]
    lifted = hybrid.with_affinities(plain, q)
    assert order(lifted) == [2, 1, 3] and lifted.where("pos = 1").first().fused_score == pytest.approx(0.08 + 0.15)
    named = hybrid.with_affinities(hybrid.reranked(candidates(spark, [(1, 0.09), (2, 0.08, "law", None, "words republic")]), q, 3, None), q)
    assert order(named) == [2, 1]
    exact = rows.where("chunk_id IN (4, 1)").select("query_id", "chunk_id", F.when(F.col("chunk_id") == 4, 1).otherwise(2).alias("rank"), *[c.split()[0] for c in META.split(", ")])
    again = hybrid.pinned_again(exact, hybrid.with_affinities(hybrid.shown(judged, 12, 0.25, 3), q))
    assert order(again) == [4, 1, 3]
    got = {r.chunk_id: (r.fused_score, r.rerank_score) for r in again.collect()}
    assert got[4] == (1.0, 0.99) and got[1] == (1.0, None) and got[3][1] == 0.9
    forced = hybrid.by_force(candidates(spark, [(1, 0.5, "ministerial_act"), (2, 0.5004, "code"), (3, 0.7, "law")]).withColumn("rerank_score", F.lit(None).cast("double")))
    assert [r.chunk_id for r in forced.orderBy("final_pos").collect()] == [3, 2, 1]


def test_a_scorer_that_fails_leaves_the_order_and_a_branch_that_fails_is_empty(spark):
    def broken(question, passage):
        raise RuntimeError

    rows, q = candidates(spark, [(1, 0.09), (2, 0.08), (3, 0.07)]), questions(spark)
    assert order(hybrid.shown(hybrid.reranked(rows, q, 3, broken), 2, 0.25, 3)) == [1, 2]
    empty = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    sparse = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.4, 2)], "query_id long, chunk_id long, score double, rank int")
    chunks = spark.createDataFrame([(c, *about(c)) for c in (1, 2, 3)], f"chunk_id long, {META}")
    edges = spark.createDataFrame([(1, "a", "2", "a", "1", 0.9)], "edge_id long, source_act_id string, source_article string, target_act_id string, target_article string, confidence double")
    languages = spark.createDataFrame([(1, "en", 0)], "query_id long, language string, ord int")
    asked = hybrid.Questions(q, None, None, None, None, languages)
    got = hybrid.retrieve(asked, hybrid.Corpus(chunks, None, edges), scorer=None, lists={"dense": empty, "sparse": sparse, "title": empty, "exact": empty})
    assert [(r.chunk_id, r.via) for r in got.orderBy("rank").collect()] == [(2, None), (3, None), (1, "l, 2-modda")]
    got = hybrid.retrieve(asked, hybrid.Corpus(chunks, None, edges), scorer=None, expand=False, lists={"dense": empty, "sparse": sparse, "title": empty, "exact": empty.union(sparse.where("chunk_id = 3"))})
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [3, 2]
    assert fusion.relevant(rows.withColumn("rerank_score", F.lit(None).cast("double")), 1).count() == 1
