"""Work that grows with the tables: what may stand in the plans, and the rows by a plainer way."""

import pyspark.sql.functions as F
import pytest

from codicil.functions import legal, text
from codicil.operators import fusion, ingest, records
from codicil.plans import relational


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payments_are_folded_without_python(spark):
    price = 7_900_000
    rows = [("a", "u", "create", None, 0, None), ("a", "u", "create", price, 1, None), ("a", "v", "create", None, 2, None), ("a", "u", "other", price, 3, None), ("b", "u", "perform", price, 1, None), ("b", "u", "cancel", price, 1, 7), ("b", "u", "create", price, 1, 9)]
    df = spark.createDataFrame(rows, "payme_id string, user_id string, method string, amount long, at long, reason int")
    got = records.fold_payments(df)
    assert "InPandas" not in plan(got) and "InArrow" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {("a", "u", price, 1, 1, 0, 0, None, 2), ("b", "u", price, -2, 1, 1, 1, 7, 0)}


def test_affinities_compare_sets(spark):
    words = ["law", "lawn", "lawns", "la", "tax", "taxes", "taxi", "code", "coder", ""]
    df = spark.createDataFrame([(words[i:j], words[k:]) for i in range(3) for j in range(i, 10, 3) for k in range(0, 10, 4)] + [(["x"], None)], "q array<string>, t array<string>")
    hit = F.size(F.filter("q", lambda a: F.exists(F.coalesce("t", F.array()), lambda b: fusion.same_term(a, b))))
    rows = df.select(fusion.coverage(F.col("q"), F.col("t")).alias("a"), (hit / F.when(F.size("q") > 0, F.size("q"))).alias("b"))
    assert all(r.a == r.b for r in rows.collect()) and "exists(" not in plan(df.select(fusion.coverage(F.col("q"), F.col("t"))))


def test_the_language_is_told_from_one_normal_form(spark):
    said = {"": "uz-Latn", "the law of the land": "en", "qonun va modda": "uz-Latn", "статья и закон": "ru", "ўзбек қонуни ҳақида": "uz-Cyrl", "щит и меч": "ru", "нон": "ru", "абв agar the": "uz-Latn", "абвгдежз yo the": "ru", "12 34": "uz-Latn", None: "uz-Latn"}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    made = df.select("t", text.detect_language(F.col("t")).alias("lang"))
    assert {r.t: r.lang for r in made.collect()} == said
    assert plan(made).count("regexp_replace") <= 2


PATTERNS = ["Fuqarolik kodeksining 12-1-moddasi va ushbu Kodeks 7-modda", "статьи 5 Уголовного кодекса, статья 3 настоящего Кодекса", "see ARTICLE 9 of this Kode, Article 4 of the Tax Code and article 8 of this Law", "Mehnat KODEKSI 3-modda", "Article 5 of the Act of src3 Law. Article 5 of the Act of  src3 LAW", "nothing here", "", None]


def test_texts_without_a_patterns_words_are_not_searched_for_it(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PATTERNS)], "i int, t string")
    own = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("t", F.lit("(?iU)" + p), F.lit(1)) for _, p in legal.SELF_REFERENCES])))
    pairs = [F.transform(F.arrays_zip(*[F.regexp_extract_all("t", F.lit("(?iU)" + p), F.lit(g)).alias(n) for n, g in (("a", a), ("n", n))]), lambda x: F.concat_ws(":", F.trim(F.regexp_replace(x["a"], "(?U)\\s+", " ")), x["n"])) for a, n, _, p in legal.OTHER_REFERENCES]
    other = F.filter(F.array_distinct(F.flatten(F.array(*pairs))), lambda x: ~x.rlike("(?iU)^(?:ushbu|ушбу|настоящ\\w*|this)\\b"))
    made = F.transform(legal.other_references(F.col("t")), lambda x: F.concat_ws(":", x["act"], x["article"]))
    rows = df.select("i", own.alias("a"), legal.self_references(F.col("t")).alias("b"), other.alias("c"), made.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and sum(len(r.d or []) for r in rows) >= 5


def test_bodies_are_searched_once_for_edges(spark):
    bodies = spark.createDataFrame([("a", "1", PATTERNS[2])], "act_id string, article_number string, body string")
    edges = ingest.reference_edges(bodies, spark.createDataFrame([("t", "the Tax Code")], "act_id string, name string"))
    assert "Article" not in plan(edges) and {(r.target_act_id, r.target_article) for r in edges.collect()} >= {("t", "4")}


def test_pairs_of_alerts_and_users_are_not_shuffled(spark):
    alerts = spark.createDataFrame([(1, "tax", "New tax"), (1, "tax", "New tax"), (2, "law", "Land"), (3, None, "tax land")], "alert_id long, act_type string, name string")
    subs = spark.createDataFrame([(7, "tax", None), (7, None, "tax"), (7, "tax", "new"), (8, None, "LAND"), (8, "law", ""), (9, None, None)], "user_id long, act_type string, keyword string")
    found = records.alerts_for(alerts, subs, ["name"])
    assert sorted((r.user_id, r.alert_id) for r in found.collect()) == [(7, 1), (7, 3), (8, 2), (8, 3)]
    assert plan(found).startswith("Union")


def test_names_meet_each_spelling_once(spark, sf_dir, monkeypatch):
    met = []
    monkeypatch.setattr(relational, "held", lambda texts, needles, *a, f=relational.held, **b: (met.append(needles), f(texts, needles, *a, **b))[1])
    assert relational.join12_late_resolution(spark, sf_dir).count() > 0
    needles = met[0].select("needle")
    assert needles.count() == needles.distinct().count() and met[0].columns == ["needle"]
