"""Fixed pairs for text, law and answer functions."""

import pyspark.sql.functions as F
import pytest

from codicil.functions import answers, legal, text, translit
from codicil.operators import citations, fusion, ingest, records


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("mark", "ʻʼ‘’'`")
def test_apostrophes_are_alike(spark, mark):
    assert one(spark, translit.latin_to_cyrillic(F.col("x")), x=f"ta{mark}til") == "таътил"
    assert one(spark, text.normalise_token(F.col("x")), x=f"O{mark}zbek") == "ozbek"


@pytest.mark.parametrize("word", ["ер", "эр", "шартнома", "ўзбекистон"])
def test_round_trip(spark, word):
    assert one(spark, translit.latin_to_cyrillic(translit.cyrillic_to_latin(F.col("x"))), x=word) == word


@pytest.mark.parametrize(("x", "want"), [("shartnoma", "latn"), ("шартнома", "cyrl"), ("", "unknown"), ("шарт abcd", "mixed")])
def test_script(spark, x, want):
    assert one(spark, translit.script_of(F.col("x")), x=x) == want


def test_content_tokens(spark):
    assert one(spark, text.content_tokens(F.col("x"), "uz"), x="Mehnat shartnomasi qanday bekor qilinadi") == ["mehnat", "shartnomasi", "bekor"]
    assert one(spark, text.content_tokens(F.col("x"), "uz"), x="Nima kerak") == ["nima", "kerak"]
    assert one(spark, text.content_tokens(F.col("x"), "ru"), x="Что признаётся сделкой по гражданскому праву 5") == ["сделкой"]


def test_stems_and_ngrams(spark):
    assert one(spark, text.stem_variants(F.col("x")), x="сделкой") == ["сделкой", "сдел"]
    assert one(spark, text.stem_variants(F.col("x")), x="bob") == ["bob"]
    assert one(spark, text.ngrams(F.split("x", " "), 2), x="a b c") == ["a b", "b c"]


def test_target_languages_begin_with_the_asked(spark):
    assert one(spark, text.target_languages(F.col("x")), x="ru")[0] == "ru" and len(one(spark, text.target_languages(F.col("x")), x="ru")) == 4


def test_display_title_falls_back(spark):
    assert one(spark, text.display_title("ru", F.col("a"), F.lit(None), F.lit("en"), F.lit("s")), a="uz") == "uz"


@pytest.mark.parametrize(("q", "want"), [("155-moddasi 3-qismi", [("155", "3", None)]), ("155-modda 3-qism 2-band", [("155", "3", "2")]), ("ст. 12 и статья 15", [("12", None, None), ("15", None, None)]), ("155 - 1-modda", [("155-1", None, None)]), (None, [])])
def test_references(q, want):
    assert [tuple(r.values()) for r in legal.find_references(q)] == want


@pytest.mark.xfail(strict=True, reason="coordinated numbers are read as one")
def test_coordinated_references():
    assert [r["article"] for r in legal.find_references("106 va 107-moddalari")] == ["106", "107"]


def test_act_types_need_more_than_the_word_law(spark):
    assert one(spark, legal.infer_act_types(F.col("x")), x="against the law, qonun asosida") == []
    assert one(spark, legal.infer_act_types(F.col("x")), x="Mehnat kodeksi va farmon") == ["code", "presidential_decree"]


def test_precedence_orders(spark):
    assert one(spark, legal.precedence(F.col("x")), x="code") == 80 and one(spark, legal.precedence(F.col("x")), x="?") is None
    assert one(spark, legal.declaration_order(F.col("x")), x="constitution") == 0


def test_affinity(spark):
    q = F.array(F.lit("shartnoma"), F.lit("bekor"))
    f = lambda *t: one(spark, fusion.title_affinity(q, F.array(*map(F.lit, t))), x=1)
    assert f("shartnomani", "bekor") == 1.0 and f("boshqa") == 0.0 and 0 < f("shartnoma", "oqibatlari", "haqida") < 1
    assert one(spark, fusion.act_affinity(F.array(F.lit("уголовная")), F.array(F.lit("уголовный"), F.lit("кодекс"))), x=1) == 1.0


def test_hybrid_annotations():
    found = citations.attributed("The tax code says so [S1]. The land code too [S2].", {"S1": "Land code", "S2": "Land code", "S3": None})
    assert found == [{"tag": "S1", "claimed": "tax", "actual": "land"}]


@pytest.mark.parametrize(("raw", "want"), [("90 123 45 67", "+998901234567"), ("+998 (90) 123-45-67", "+998901234567"), ("8998901234567", "+998901234567"), ("12345", None), ("", None)])
def test_phone(spark, raw, want):
    assert one(spark, records.e164(F.col("x")), x=raw) == want


def test_retry_after_is_never_zero(spark):
    assert one(spark, records.retry_after(F.timestamp_seconds("x")), x=86_399) == 1 and one(spark, records.retry_after(F.timestamp_seconds("x")), x=0) == 86_400


def test_packing_keeps_to_the_maximum():
    parts = [f"clause {k} " + "w" * 90 for k in range(30)]
    for chunk in ingest.split_body("\n".join(parts), 0, 100, 150, 20):
        assert len(chunk) / 3 <= 150
    assert ingest.ranges([4, 3, 2, 9, 1, 1, 30, 2], 10, 20) == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8)]
    assert ingest.ranges([4, 4, 2, 4, 4], 10, 20, 2) == [(0, 3), (2, 5)]
    body = "\n".join(f"{k}) " + "word " * 60 for k in range(1, 8))
    assert len(ingest.split_body(body, 0, 200, 300, 20)) > 1 and ingest.split_body("short") == ["short"] and ingest.split_body("") == []
    assert ingest.split_body("abcdef" * 9, 0, 4, 4, 0) == ["abcdefabcdef"] * 4 + ["abcdef"]


def test_relevance(spark):
    rows = [(1, k, None) for k in range(14)] + [(2, 0, 0.9), (2, 1, 0.8), (2, 2, 0.01)] + [(3, k, 0.01) for k in range(10)]
    df = spark.createDataFrame([(q, p + 1, s) for q, p, s in rows], "query_id long, pos int, rerank_score double")
    assert {r[0]: r[1] for r in fusion.relevant(df).groupBy("query_id").count().collect()} == {1: 12, 2: 2, 3: 3}
    assert fusion.relevant(df.where("false")).count() == 0


def test_plain_heading():
    assert ingest.plain_heading("57 1 -модда.  Ном ") == "ном" and ingest.plain_heading(None) == ""


def test_topics_and_flags(spark):
    assert one(spark, answers.contract_topics(F.col("x")), x="nothing") == ["subject_matter", "price", "term", "termination", "liability"]


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, k, f"Act, {k}", None, "word " * 200, "code" if k % 2 else "law", 80 if k % 2 else 70, None, k) for k in range(80)], "query_id long, chunk_id long, citation string, heading string, text string, act_type string, precedence int, via string, pos int")
    r = citations.build_context(rows, 2000).first()
    assert r.truncated and len(r.tags) < 80 and r.tags == [f"S{i + 1}" for i in range(len(r.tags))]
    small = citations.build_context(rows.where("chunk_id < 2"), 8000).first()
    assert small.chunk_ids == [1, 0] and not small.truncated


def test_history_intervals_are_disjoint(spark):
    rows = spark.createDataFrame([("a", d, v) for d, v in enumerate("xxyyxz")], "k string, at int, v string")
    got = [(r.v, r.valid_from, r.valid_to) for r in records.history(rows, ["k"], "at", "v").orderBy("valid_from").collect()]
    assert got == [("x", 0, 2), ("y", 2, 4), ("x", 4, 5), ("z", 5, None)]


def test_payments_are_idempotent(spark):
    price = 7_900_000
    calls = [("p", "u", "create", price, 0, None), ("p", "u", "create", price, 5, None), ("p", "u", "perform", price, 9, None), ("p", "u", "perform", price, 10, None), ("p", "u", "cancel", price, 20, 5), ("p", "u", "cancel", price, 30, 5)]
    calls += [("q", "u", "create", 1, 0, None), ("r", "u", "create", price, 0, None), ("r", "u", "perform", price, 50_000_000, None), ("s", "u", "create", price, 1, None), ("s", "u", "cancel", price, 2, 3)]
    df = spark.createDataFrame(calls, "payme_id string, user_id string, method string, amount long, at long, reason int")
    got = {r.payme_id: (r.state, r.perform_time, r.cancel_time, r.reason, r.refused) for r in records.fold_payments(df).collect()}
    assert got == {"p": (-2, 9, 20, 5, 0), "q": (0, 0, 0, None, 1), "r": (-1, 0, 50_000_000, 4, 1), "s": (-1, 0, 2, 3, 0)}


def test_no_word_of_a_clause_is_lost(spark):
    body = ["1-modda. Maqsad", "1) birinchi band matni", "2) ikkinchi band matni", "a) kichik qism", "oddiy satr", "2-modda. Soha", "Matn bor"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(body)], "doc_id long, block_ix int, text string")
    nodes = ingest.build_nodes(blocks)
    chunks = " ".join(r.text for r in ingest.chunk_nodes(nodes).collect())
    for word in "birinchi ikkinchi band matni kichik qism oddiy satr Matn bor".split():
        assert word in chunks


@pytest.mark.parametrize("terms", [[(1, "ab"), (1, "abc"), (2, "xy"), (3, "zz")], [(1, "a")]])
def test_batches_score_like_postings(spark, terms):
    from codicil.operators import lexical

    rows = [(k, f"law ab{k % 3}", None if k % 4 == 0 else f"abc xyz {k}", " ".join(["abcd", "xyyy", "ab", "none"][j % 4] for j in range(k))) for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, law_name string, heading string, text string")
    asked = spark.createDataFrame(terms, "query_id long, term string")
    posts = lexical.postings(chunks)
    want = lexical.or_scores(posts, lexical.expand_prefixes(asked, lexical.vocabulary(posts))).collect()
    got = lexical.batch_scores(chunks, asked, lexical.FIELD_WEIGHTS, "chunk_id").collect()
    assert sorted((r.query_id, r.chunk_id, round(r.weight, 6)) for r in got) == sorted((r.query_id, r.chunk_id, round(r.weight, 6)) for r in want)
