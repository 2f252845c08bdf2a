import io
import json
import zipfile

import pyspark.sql.functions as F
import pytest

from codicil.operators import ingest, records
from codicil.sources import connectors, files
from codicil.sources.buckets import BucketedTable
from codicil.streaming import operators as streaming


def test_law_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Qism,Bo\'lim,Bob raqami,Bob nomi,Modda raqami,Modda nomi,Modda matni\nU,1,1,A,1,T,"one, two"\nU,1,1,A,1,T,three\nU,1,1,A,2,S,four\n', encoding="utf-8")
    rows = files.read_law_csv(spark, str(p))
    assert rows.columns == ["part", "section", "chapter_number", "chapter_title", "article_number", "article_title", "body"] and rows.count() == 3
    got = files.law_articles(rows.withColumn("n", F.monotonically_increasing_id()), "n").orderBy("first").collect()
    assert [(r.article_number, r.body) for r in got] == [("1", "one, two\nthree"), ("2", "four")]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.read_law_csv(spark, str(tmp_path / "b.csv"))


def test_html_without_end_tags():
    texts = lambda page: [b["text"] for b in files.html_blocks(page)]
    assert texts("<ul><li>one<li>two<li>three</ul>") == ["one", "two", "three"]
    assert texts("<table><tr><td>aa<td>bb<tr><td>cc</table><p>dd<p>ee<div>ff") == ["aa", "bb", "cc", "dd", "ee", "ff"]
    assert texts("<ul><li>top<ul><li>inner</ul><li>next</ul>")[1:] == ["inner", "next"]
    for tag in ("p", "li", "div", "td"):
        assert texts(f"<{tag}>word" * 3 + f"<{tag}>" * 10_000 + "end")[-1].endswith("end")
    assert texts("<p>" + "<b>" * 10_000 + "end") == ["end"]


def test_html_blocks():
    page = "<html><title>T</title><body><nav>menu</nav><div id='divCont'><h1>III bob</h1><p>54-modda. Nom</p><p>body<br>line</p><p>body<br>line</p><table><tr><td>cell text</td></tr></table><div class='COMMENT'>no</div>Audioni tinglash<p>Audioni tinglash |</p><div>" + "long text " * 40 + "</div></div><footer>f</footer></body></html>"
    got = files.html_blocks(page)
    assert [(b["role"], b["level"]) for b in got] == [("heading", 1), ("heading", 4), ("body", 0), ("table", 0), ("body", 0)]
    assert files.html_blocks("") == [] and files.html_blocks(None) == [] and files.html_blocks("<p>unclosed <b>x")


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_parse_by_format(spark):
    rows = [(1, docx([("Heading2", "Title"), ("Normal", "text")]), None, "a.DOCX"), (2, b"<p>hello there</p>", "text/html; charset=utf-8", "x"), (3, b"1-modda\nplain", None, "b.txt"), (4, b"%PDF", None, "c.pdf"), (5, b"not a zip", None, "d.docx"), (6, None, None, "e")]
    got = files.parse_documents(spark.createDataFrame(rows, "doc_id long, content binary, mime string, name string")).collect()
    by = {i: [(r.role, r.text) for r in got if r.doc_id == i] for i in range(1, 7)}
    assert by[1] == [("heading", "Title"), ("body", "text"), ("table", "a | b")] and by[2] == [("body", "hello there")] and by[3] == [("heading", "1-modda"), ("body", "plain")]
    assert all(r.error for r in got if r.doc_id in (4, 5, 6))


def test_tree_and_chunks(spark):
    lines = ["UMUMIY QISM", "I bob. Asosiy qoidalar", "1-modda. Maqsad", "Birinchi matn.", "2-modda. Vazifa", "1) birinchi band", "Davomi.", "ILOVA", "Jadval matni"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, block_ix int, text string")
    nodes = ingest.build_nodes(blocks).collect()
    by = {n.node_type + (n.number or ""): n for n in nodes}
    assert by["modda1"].article_number == "1" and by["band1"].article_number == "2" and by["band1"].parent_id == by["modda2"].node_id
    assert by["modda1"].parent_id == by["bobI"].node_id and by["bobI"].parent_id is None and by["annex"].parent_id is None and by["annex"].article_number is None
    assert by["modda1"].path.endswith("/1")
    chunks = ingest.chunk_nodes(spark.createDataFrame(nodes)).orderBy("chunk_ix").collect()
    assert [c.article_number for c in chunks] == ["1", "2", None] and "Asosiy qoidalar" in chunks[0].text and chunks[0].heading == "1-modda. Maqsad"


def test_pages_folded_where_they_are_read_equal_tables_of_blocks(spark, sf_dir):
    law = "<html><body><h1>I bob. A</h1><p>1-modda. Maqsad</p><p>matn</p><p>1) band bir</p><p>davomi</p><p>2-modda. Ikki</p><p>III BO'LIM</p><p>ILOVA</p><p>x</p></body></html>"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").unionByName(spark.createDataFrame([(10**6, law), (10**6 + 1, None), (10**6 + 2, "")], "page_id long, html string"))
    blocks, texts = files.page_blocks(pages).withColumnRenamed("page_id", "doc_id"), files.page_texts(pages).withColumnRenamed("page_id", "doc_id")
    key = lambda df: sorted(map(repr, df.collect()))
    nodes = ingest.build_nodes(blocks)
    assert key(ingest.document_nodes(texts)) == key(nodes)
    assert key(ingest.document_chunks(texts, 200, 300)) == key(ingest.chunk_nodes(nodes, 200, 300))
    assert ingest.document_chunks(texts.where("doc_id > 1000000")).count() == 0


def test_anchors(spark):
    html = "<a onclick=\"scrollText('10')\">57-модда. Bir</a><a onclick=\"scrollText('11')\">57 1 -модда. Ikki</a><a onclick=\"scrollText('12')\">5-боб</a><div id='10'></div><div id='11'></div><div id='12'></div><a onclick=\"scrollText('99')\">9-модда. Yoq</a>"
    got = ingest.toc_anchors(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert {(r.anchor_id, r.article_number, r.heading) for r in got} == {("10", "57", "Bir"), ("11", "57-1", "Ikki")}


def test_api_rows_and_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": {"data": [{"x": 1}, {"x": 2}]}}))
    assert [json.loads(r.row) for r in files.read_api_rows(spark, str(tmp_path / "a.json")).collect()] == [{"x": 1}, {"x": 2}]
    (tmp_path / "b.json").write_text('{"result": 5}')
    assert files.read_api_rows(spark, str(tmp_path / "b.json")).count() == 0
    assert files.rows_as_html(spark.createDataFrame([("<a&b>\x01",)], "x string"), ["x"]).first()[0] == "<tr><td>&lt;a&amp;b&gt;</td></tr>"


def test_connector(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    entries = [{"identifier": "1", "host": "h", "file": "a.html", "answers": [{"status": 429, "retry_after": 7}, {"status": 503}, {"status": 200}]}, {"identifier": "2", "host": "g", "file": "a.html", "answers": [{"status": 404}]}]
    (tmp_path / "index.jsonl").write_text("\n".join(map(json.dumps, entries)))
    got = {r.identifier: (r.status, r.waited_s, r.attempts, bytes(r.content or b"")) for r in connectors.read_connector(spark, "directory", path=str(tmp_path)).collect()}
    assert got == {"1": (200, 10.0, 3, b"<p>x</p>"), "2": (404, 0.0, 1, b"")}
    with pytest.raises(ValueError):
        connectors.read_connector(spark, "other")


def test_vector_index(spark, tmp_path):
    rows = spark.createDataFrame([(k, [3.0, 4.0]) for k in range(9)] + [(9, None)], "chunk_id long, embedding array<float>")
    files.write_vector_index(rows, str(tmp_path / "ix"), 4)
    back = spark.read.parquet(str(tmp_path / "ix"))
    assert back.count() == 9 and back.first().embedding == [0.6, 0.8]


@pytest.fixture
def events(spark, tmp_path, sf_dir):
    """events shuffled into several files, and a last row that closes all windows."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = rows.limit(1).withColumn("ts", F.expr("timestamp_ntz'2025-01-01'")).withColumn("user_id", F.lit(-1).cast("long"))
    rows.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(str(tmp_path / "in/a"))
    last.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), tmp_path


def same(spark, name, batch):
    key = lambda df: sorted(map(repr, df.select(*batch.columns).collect()))
    got = spark.table(name)
    if "user_id" in got.columns:
        got = got.where("user_id <> -1")
    assert key(got) == key(batch)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_equal_batch(spark, events, kind):
    rows, stream, at = events
    f = getattr(streaming, kind)
    streaming.available_now(f(stream, "user_id", lateness="60 days"), f"w_{kind}", str(at / kind))
    same(spark, f"w_{kind}", f(rows, "user_id"))


def test_quota_stream(spark, events):
    rows, stream, at = events
    subs = spark.createDataFrame([(str(k), "user") for k in range(3)], "identity string, tier string")
    f = lambda df: streaming.quota_stream(df.withColumn("identity", F.col("user_id").cast("string")), subs, "60 days")
    streaming.available_now(f(stream), "quota", str(at / "q"))
    got = {tuple(r) for r in spark.table("quota").where("identity <> '-1'").collect()}
    assert got == {tuple(r) for r in f(rows).collect()}


def stream_of(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_history_stream(spark, tmp_path):
    rows = [("a", v, d) for d, v in enumerate("xxyyxz")]
    s = stream_of(spark, tmp_path, "h", rows, "key string, value string, d int").withColumn("ts", F.timestamp_seconds("d")).drop("d")
    streaming.available_now(streaming.stateful(s, streaming.History()), "history", str(tmp_path / "c"))
    closed = sorted((r.value, r.valid_from.second, r.valid_to.second) for r in spark.table("history").collect())
    want = sorted((r.v, r.valid_from, r.valid_to) for r in records.history(spark.createDataFrame([("a", d, v) for _, v, d in rows], "k string, at int, v string"), ["k"], "at", "v").where("valid_to IS NOT NULL").collect())
    assert closed == want


def test_breaker_stream(spark, tmp_path):
    rows = [("m", True, t) for t in (0, 1, 2, 30, 70)] + [("m", False, 80), ("m", True, 81)]
    s = stream_of(spark, tmp_path, "b", rows, "key string, failed boolean, d int").withColumn("ts", F.timestamp_seconds("d")).drop("d")
    streaming.available_now(streaming.stateful(s, streaming.Breaker()), "breaker", str(tmp_path / "c"))
    got = [(r.failures, r.open) for r in spark.table("breaker").orderBy("ts").collect()]
    assert got == [(1, False), (2, False), (3, True), (4, True), (5, False), (0, False), (1, False)]


def test_codes_stream(spark, tmp_path):
    rows = [("p", "send", "1", 0), ("p", "send", "2", 30), ("p", "verify", "9", 31), ("p", "verify", "1", 32), ("p", "verify", "1", 33), ("p", "send", "3", 100), ("p", "verify", "3", 500)]
    s = stream_of(spark, tmp_path, "o", rows, "key string, kind string, code string, d int").withColumn("ts", F.timestamp_seconds("d")).drop("d")
    streaming.available_now(streaming.stateful(s, streaming.OneTimeCodes()), "codes", str(tmp_path / "c"))
    assert [r.result for r in spark.table("codes").orderBy("ts").collect()] == ["sent", "cooldown", "wrong", "ok", "none", "sent", "expired"]


def test_once_and_ingest(spark, tmp_path):
    schema = "k string, content string, ts timestamp_ntz"
    make = lambda n, rows: spark.createDataFrame(rows, "k string, content string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01'")).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    make("1", [("a", "x"), ("b", "y"), ("a", "x")])
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streaming.available_now(streaming.once(src(), ["k", "content"]), "once", str(tmp_path / "c1"))
    assert spark.table("once").count() == 2
    load = lambda: streaming.ingest_stream(src(), str(tmp_path / "out"), ["k"], "content", str(tmp_path / "c2"))
    load()
    make("2", [("a", "z"), ("c", "w"), ("b", "y")])
    load()
    now = BucketedTable(spark, str(tmp_path / "out"), "k string, content string", ["k"]).read()
    assert {tuple(r) for r in now.collect()} == {("a", "z"), ("b", "y"), ("c", "w")}


def test_alert_stream(spark, tmp_path):
    acts = "alert_id long, act_type string, name string"
    spark.createDataFrame([(1, "code", "Tax Code"), (2, "law", "On land"), (3, "decree", "Other")], acts).write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([(7, "code", None), (8, None, "LAND"), (9, "none", None)], "user_id long, act_type string, keyword string")
    changes = spark.readStream.schema(acts).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        streaming.alert_stream(changes, subs, ["name"], str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.user_id, r.alert_id) for r in got.collect()) == [(7, 1), (8, 2)]


def test_calls_of_one_time_are_created_first(spark):
    price = records.DEFAULT.price_tiyin
    calls = spark.createDataFrame([("p", "u", m, price, 5, 3) for m in ("cancel", "perform", "create")], "payme_id string, user_id string, method string, amount long, at long, reason int")
    assert [(r.state, r.refused) for r in records.fold_payments(calls).collect()] == [(-2, 0)]


def test_newest_content_of_a_batch(spark, tmp_path):
    rows = "k long, body string, at long"
    spark.createDataFrame([(1, "z old", 1), (1, "a new", 2), (2, "x", 1)], rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
    streaming.ingest_stream(source, str(tmp_path / "t"), ["k"], "body", str(tmp_path / "cp"), newest="at")
    got = BucketedTable(spark, str(tmp_path / "t"), "k long, at long, body string", ["k"]).read()
    assert sorted((r.k, r.body) for r in got.collect()) == [(1, "a new"), (2, "x")]
