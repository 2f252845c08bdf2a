"""Bucketed tables, the store of acts, the stored index, and joins by containment."""

import datetime
import os
import random

import pyspark.sql.functions as F
import pytest

from codicil.operators import containment, inverted, lexical, records
from codicil.sources.buckets import BucketedTable, upserted
from codicil.sources.statutes import TABLES, StatuteStore
from codicil.streaming import operators as streaming

ROWS = "k long, at long, body string"


def rows_of(table):
    return {(r.k, r.at, r.body) for r in table.read().collect()}


def folders(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/data/" in d + "/"}


def test_a_change_rewrites_its_own_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ROWS, ["k"], 8)
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], ROWS), upserted(["k"], "body", "at")) == []
    merge = lambda rows, stream=None: table.merge(spark.createDataFrame(rows, ROWS), upserted(["k"], "body", "at"), stream)
    assert merge([(k, 1, f"b{k}") for k in range(100)]) == list(range(8))
    before = folders(tmp_path)
    touched = merge([(5, 2, "new"), (5, 2, "newer"), (500, 1, "more")])
    now = folders(tmp_path)
    assert len(touched) <= 2 and before.items() <= now.items() and len(now) == len(before) + len(touched)
    assert rows_of(table) == {(k, 1, f"b{k}") for k in range(100) if k != 5} | {(5, 2, "newer"), (500, 1, "more")}
    merge([(5, 1, "late"), (6, 3, "b6")])  # older, and equal in content
    assert {r for r in rows_of(table) if r[0] in (5, 6)} == {(5, 2, "newer"), (6, 1, "b6")}
    assert {r.k for r in table.read(touched).collect()} < {r.k for r in table.read().collect()}
    files = table.read(touched).inputFiles()
    assert all(any(f"bucket={b}/" in f for b in touched) for f in files)


def test_a_change_that_dies_leaves_the_state_before(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ROWS, ["k"], 4)
    put = upserted(["k"], "body")
    table.merge(spark.createDataFrame([(k, 0, "a") for k in range(20)], ROWS), put, ("s", 0))
    whole = rows_of(table)

    def dies(current, staged):
        put(current, staged).withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{tmp_path}/data/change=000000000002")
        raise RuntimeError("lost")

    staged = spark.createDataFrame([(k, 0, "b") for k in range(10, 30)], ROWS)
    with pytest.raises(RuntimeError):
        table.merge(staged, dies, ("s", 1))
    os.makedirs(f"{tmp_path}/heads/000000000002")  # a head without Spark's mark
    assert rows_of(table) == whole
    for _ in range(2):  # again, and once more after it was committed
        table.merge(staged, put, ("s", 1))
        assert rows_of(table) == {(k, 0, "a") for k in range(10)} | {(k, 0, "b") for k in range(10, 30)}
    assert table.changes() == [1, 2]
    table.replace(spark.createDataFrame([], ROWS), ["k"], gone=table.read().select("k"))
    assert rows_of(table) == set() and table.vacuum(1) > 0 and table.read(change=3).count() == 0


def test_ingest_stream_keeps_to_touched_buckets_and_to_newer_rows(spark, tmp_path):
    source = lambda: spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    write = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streaming.ingest_stream(source(), str(tmp_path / "t"), ["k"], "body", str(tmp_path / "cp"), newest="at", buckets=16)
    write([(k, 5, "x") for k in range(64)])
    run()
    before = folders(tmp_path / "t")
    write([(3, 4, "older"), (3, 6, "newest"), (4, 1, "older")])
    run()
    now = folders(tmp_path / "t")
    assert before.items() <= now.items() and len(now) - len(before) <= 2
    table = BucketedTable(spark, str(tmp_path / "t"), "k long, at long, body string", ["k"], 16)
    assert rows_of(table) == {(k, 5, "x") for k in range(64) if k != 3} | {(3, 6, "newest")}
    run()
    assert folders(tmp_path / "t") == now


LINES = {
    ("a", "uz"): ["I bob. Asosiy qoidalar", "1-modda. Maqsad", "Birinchi matn.", "2-modda. Vazifa", "1) birinchi band", "Ushbu Kodeksning 1-moddasi."],
    ("a", "ru"): ["1-modda. Pervaya", "tekst"],
    ("b", "uz"): ["1-modda. Boshqa", "matn", "3-modda. Yana", "yana matn"],
}


def blocks_of(spark, lines):
    return spark.createDataFrame([(a, lang, i, t) for (a, lang), some in lines.items() for i, t in enumerate(some)], "act_id string, language string, block_ix int, text string")


def acts_of(spark, lines, day):
    return spark.createDataFrame([(a, lang, f"Act {a}", day) for a, lang in lines], "act_id string, language string, name string, effective date")


def contents(store):
    return {n: {tuple(r) for r in store.read(n).collect()} for n in TABLES}


def test_the_store_of_acts(spark, tmp_path):
    store = StatuteStore(spark, str(tmp_path), 32)
    day = datetime.date(2024, 1, 1)
    first = store.ingest(acts_of(spark, LINES, day), blocks_of(spark, LINES))
    assert all(first[n] for n in TABLES)
    held = contents(store)
    nodes = store.read("nodes").collect()
    ids = {n.node_id for n in nodes}
    assert len(ids) == len(nodes) and all(n.parent_id is None or n.parent_id in ids for n in nodes)
    assert {(n.act_id, n.language, n.article_number) for n in nodes if n.node_type == "modda"} == {("a", "uz", "1"), ("a", "uz", "2"), ("a", "ru", "1"), ("b", "uz", "1"), ("b", "uz", "3")}
    assert all(c.node_id in ids for c in store.read("chunks").collect())
    assert {(e.act_id, e.target_act_id, e.target_article) for e in store.read("edges").collect()} <= {("a", "a", "1")}
    assert {(v.act_id, v.article_number, v.body, v.valid_from, v.valid_to, v.change_note) for v in store.read("versions").collect() if v.act_id == "b"} == {("b", "1", "matn", day, None, "initial"), ("b", "3", "yana matn", day, None, "initial")}

    files = folders(tmp_path)
    assert store.ingest(acts_of(spark, LINES, day), blocks_of(spark, LINES)) == {n: [] for n in TABLES} and folders(tmp_path) == files

    later, changed = datetime.date(2024, 6, 1), LINES | {("b", "uz"): ["1-modda. Boshqa", "yangi matn"]}
    again = store.ingest(acts_of(spark, changed, later), blocks_of(spark, changed))
    assert all(len(again[n]) == 1 for n in TABLES if n != "edges") and files.items() <= folders(tmp_path).items()
    now = contents(store)
    for n in TABLES:
        assert {r for r in now[n] if r[:2] != ("b", "uz")} == {r for r in held[n] if r[:2] != ("b", "uz")}
    assert {n.article_number for n in store.read("nodes").where("act_id = 'b' AND node_type = 'modda'").collect()} == {"1"}
    versions = {(v.article_number, v.body, v.valid_from, v.valid_to) for v in store.read("versions").where("act_id = 'b'").collect()}
    assert versions == {("1", "matn", day, later), ("1", "yangi matn", later, None), ("3", "yana matn", day, None)}

    only = {("a", "uz"): LINES[("a", "uz")]}
    store.ingest(acts_of(spark, only, later), blocks_of(spark, only), force=True)
    assert {(r[0], r[1]) for r in contents(store)["chunks"]} == {("a", "uz"), ("b", "uz")}
    assert contents(store)["versions"] == now["versions"]


def test_an_ingestion_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    store = StatuteStore(spark, str(tmp_path / "a"), 8)
    whole = StatuteStore(spark, str(tmp_path / "b"), 8)
    given = acts_of(spark, LINES, datetime.date(2024, 1, 1)), blocks_of(spark, LINES)
    whole.ingest(*given)
    with monkeypatch.context() as m:
        m.setattr(store.tables["edges"], "replace", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.ingest(*given)
    assert store.read("acts").count() == 0
    store.ingest(*given)
    assert contents(store) == contents(whole)


def test_containment_equals_brute_force(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abcd \n") for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "ж" * 2000 + "кодекс"), (903, "a.c(d"), (902, "again кодекс")]
    needles = [(i, "".join(r.choice("abcd") for _ in range(r.randint(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "кодекс"), (103, "жж"), (104, "a.c("), (105, "%"), (5, "ab"), (105, "\n")]
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(needles, "needle_id long, needle string")
    want = sorted((i, j) for i, x in texts for j, y in needles if x and y and y in x)
    for counted in (True, False):
        got = containment.held(t, n, counted=counted)
        assert sorted((x.text_id, x.needle_id) for x in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert containment.held(t, n.where("needle_id > 99 AND needle_id < 102")).count() == 0 and containment.held(t.where("false"), n).count() == 0


def test_acts_by_name(spark):
    acts = spark.createDataFrame(
        [(1, "Fuqarolik kodeksi", "O‘zbekiston Respublikasining Fuqarolik kodeksi", "Гражданский кодекс", "Civil Code", "in_force"), (2, "FK", "Fuqarolik kodeksi sharhi", None, None, "amended"), (3, "Fuqarolik kodeksi", None, None, None, "repealed"), (4, "Jinoyat kodeksi", "Jinoyat kodeksi", "Уголовный кодекс", "Criminal Code", "in_force")],
        "act_id long, short_name string, title_uz string, title_ru string, title_en string, status string",
    )
    names = spark.createDataFrame([(1, "  fuqarolik   KODEKSI "), (2, "гражданский"), (3, "Фуқаролик кодекси"), (4, "code"), (5, ""), (6, None), (7, "oʻzbekiston")], "name_id long, name string")
    got = {}
    for r in containment.acts_by_name(names, acts).orderBy("name_id", "pos").collect():
        got.setdefault(r.name_id, []).append(r.act_id)
    assert got == {1: [1, 2], 2: [1], 3: [2, 1], 4: [1, 4], 7: [1]}
    assert containment.acts_by_name(names, acts, 1).where("name_id = 4").first().act_id == 1
    chunks = spark.createDataFrame([(10, 1, "5", 2), (11, 1, "5", 1), (12, 4, "5", 0), (13, 1, "6", 0)], "chunk_id long, act_id long, article_number string, ordinal int")
    asked = spark.createDataFrame([(1, "code", "5"), (2, "code", "9")], "name_id long, name string, article_number string")
    assert [(r.name_id, r.chunk_id) for r in containment.by_article(asked, acts, chunks).orderBy("name_id", "pos").collect()] == [(1, 11), (1, 10), (1, 12)]


def test_alerts_without_a_nested_loop(spark):
    alerts = spark.createDataFrame([(1, "code", "Tax Code", None), (2, "law", "On land", "Yer"), (3, "decree", "Other", "TAXES")], "alert_id long, act_type string, name string, name_uz string")
    subs = spark.createDataFrame([(7, "code", None), (8, None, "LAND"), (9, "none", None), (8, "law", None), (6, None, "tax"), (5, None, "")], "user_id long, act_type string, keyword string")
    got = records.alerts_for(alerts, subs, ["name", "name_uz"])
    assert sorted((r.user_id, r.alert_id) for r in got.collect()) == [(6, 1), (6, 3), (7, 1), (8, 2)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law_name"), F.get(F.split("text", "\n"), F.lit(0)).alias("heading"), "text")
    path = str(tmp_path_factory.mktemp("index"))
    inverted.build(docs, path, files=6)
    return docs, path


def ranks(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def test_the_stored_index_gives_the_rows_of_a_full_search(spark, index):
    docs, path = index
    words = [r.lexeme for r in spark.read.parquet(f"{path}/lexemes").orderBy("lexeme").collect()]
    r = random.Random(2)
    asked = [(q, t[: r.choice([2, 3, 9])]) for q in range(40) for t in r.sample(words, 1 + q % 12)] + [(50, "x"), (51, "zzzzzz"), (52, "src"), (53, words[0])]
    terms = spark.createDataFrame(asked, "query_id long, term string")
    for k in (3, 40):
        assert ranks(inverted.search(spark, path, terms, k)) == ranks(lexical.sparse_branch(docs, terms, k))
    assert inverted.search(spark, path, terms.where("false")).count() == 0


def test_a_prefix_is_a_pushed_range_of_the_sorted_postings(spark, index, monkeypatch):
    _, path = index
    terms = spark.createDataFrame([(1, "ab"), (1, "abc"), (2, "th")], "query_id long, term string")
    rows = spark.read.parquet(f"{path}/postings").where(inverted.ranges(terms))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(lexeme,ab)" in plan and "StringStartsWith(lexeme,th)" in plan and "StringStartsWith(lexeme,abc)" not in plan
    assert {x.lexeme[:2] for x in rows.collect()} <= {"ab", "th"}
    monkeypatch.setattr(inverted, "PUSHED", 1)
    plan = spark.read.parquet(f"{path}/postings").where(inverted.ranges(terms))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lexeme,ab)" in plan and "LessThan(lexeme,ti)" in plan
    found = inverted.search(spark, path, terms)._jdf.queryExecution().analyzed().toString()
    assert "documents.parquet" not in found
    lows = sorted((r.f, r.low, r.high) for r in spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name().alias("f")).agg(F.min("lexeme").alias("low"), F.max("lexeme").alias("high")).collect())
    lows.sort(key=lambda x: x[1:])
    assert len(lows) > 1 and all(a[2] <= b[1] for a, b in zip(lows, lows[1:]))


def test_postings_of_many_questions_and_long_sets(spark, index, monkeypatch):
    docs, _ = index
    terms = spark.createDataFrame([(q, t) for q in range(30) for t in ("th", "an", "in", f"e{chr(97 + q % 26)}")], "query_id long, term string")
    want = ranks(lexical.sparse_branch(docs, terms, 7))
    monkeypatch.setattr(lexical, "PAIRS", 64)
    monkeypatch.setattr(lexical, "SEEN_WORDS", 5)
    assert ranks(lexical.sparse_branch(docs, terms, 7)) == want
    monkeypatch.setattr(lexical, "SENT_TERMS", 0)
    assert ranks(lexical.sparse_branch(docs, terms, 7)) == want


def test_a_cached_map_maps_each_text_once_and_again_after_its_time(spark, tmp_path):
    from codicil.sources.cache import CachedMap

    seen = []

    def costly(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return rows.withColumn("value", F.length("text").cast("long"))

    cache = CachedMap(spark, str(tmp_path), "long", 100, 4)
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id long, text string")
    want = {1: 1, 2: 2, 3: 1, 4: None}
    values = lambda now, df=texts: {r.id: r.value for r in cache.apply(df, costly, now).collect()}
    assert values(0) == want and values(50) == want and values(99, texts.unionByName(spark.createDataFrame([(5, "ccc")], texts.schema))) == want | {5: 3}
    assert values(100) == want
    assert seen == [["a", "bb"], [], ["ccc"], ["a", "bb"]]
    assert {(r.key, r.expires) for r in cache.table.read().collect()} >= {(r.key, 199) for r in cache.table.read().where("value = 3").collect()} and cache.table.read().count() == 3


def test_a_rewrite_is_taken_up_again(spark, tmp_path):
    from codicil.sources.cache import rewrite

    table = BucketedTable(spark, str(tmp_path), ROWS, ["k"], 8)
    table.merge(spark.createDataFrame([(k, 0, None if k % 3 else "has") for k in range(40)], ROWS), lambda current, staged: staged)
    calls = []

    def fill(rows):
        calls.append(rows.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return rows.withColumn("body", F.concat(F.lit("made "), "k"))

    needs = F.col("body").isNull()
    with pytest.raises(RuntimeError):
        rewrite(table, needs, fill, 2)
    left = table.read().where(needs).count()
    assert 0 < left < 26 and rewrite(table, needs, fill, 2) == 2 and rewrite(table, needs, fill, 2) == 0
    assert rows_of(table) == {(k, 0, f"made {k}" if k % 3 else "has") for k in range(40)} and sum(calls[2:]) == left + calls[2]
