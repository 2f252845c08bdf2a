"""Ingestion over pages and documents, and fixed lines of law."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import legal
from ..operators import ingest
from ..session import table
from ..sources import files
from ._register import query

@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'modda' WHEN 'de' THEN 'bob' WHEN 'fr' THEN 'band' END AS type, CASE lang WHEN 'en' THEN CAST(doc_id AS VARCHAR) WHEN 'de' THEN CAST(doc_id AS VARCHAR) WHEN 'fr' THEN CAST(doc_id % 90 + 1 AS VARCHAR) END AS number FROM documents
""")
def ing01_classify(spark, sf_dir):
    """ING-01, WIN-17: the unit that a line opens; lines are beginnings of documents behind a mark of their language."""
    number = F.col("doc_id").cast("string")
    mark = F.when(F.col("lang") == "en", F.concat(F.lit("Article "), number, F.lit(". "))).when(F.col("lang") == "de", F.concat(F.lit("CHAPTER "), number, F.lit(" "))).when(F.col("lang") == "fr", F.concat((F.col("doc_id") % 90 + 1).cast("string"), F.lit(") "))).otherwise("- ")
    c = legal.classify(F.concat(mark, F.substring(F.coalesce("text", F.lit("")), 1, 30)))
    return table(spark, sf_dir, "documents").select("doc_id", c["type"].alias("type"), c["number"].alias("number"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_orderkey || '-' || l_linenumber END AS made FROM lineitem")
def ing02_article_number(spark, sf_dir):
    """ING-02: one form of an article number from all its spellings."""
    between = F.when(F.col("l_returnflag") == "N", " ").when(F.col("l_returnflag") == "R", " - ").otherwise("–")
    raw = F.when(F.col("l_linenumber") == 4, "  ").otherwise(F.concat(F.lit(" "), "l_orderkey", between, "l_linenumber", F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", legal.normalise_article_number(raw).alias("made"))


@query(r"SELECT doc_id, nullif(trim(regexp_extract(text, '(?s)^.*?[.:]\s+(.*)$', 1)), '') AS heading FROM documents")
def ing03_split_heading(spark, sf_dir):
    """ING-03: what follows the first full stop or colon."""
    return table(spark, sf_dir, "documents").select("doc_id", legal.split_heading(F.col("text")).alias("heading"))


@query("""
SELECT doc_id, CAST(k AS BIGINT) AS ix, substr(text, CAST(k * 2508 + 1 AS BIGINT), 2700) AS part, CAST(greatest(1, floor(length(substr(text, CAST(k * 2508 + 1 AS BIGINT), 2700)) / 3.0)) AS BIGINT) AS tokens
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2508.0) AS BIGINT))) AS k FROM documents)
""")
def ing05_chunk_fixed_window(spark, sf_dir):
    """ING-05 (hard split), ING-06: overlapping windows of characters."""
    r = ingest.fixed_windows(table(spark, sf_dir, "documents"), 2700, 2508)
    return r.select("doc_id", F.col("ix").cast("long").alias("ix"), "part", F.col("tokens").cast("long").alias("tokens"))


@query("SELECT doc_id, CAST(doc_id % 400 + 1 AS VARCHAR) AS own, 'Act of ' || source || ' Law:' || (n_chars % 90 + 1) AS other FROM documents WHERE text IS NOT NULL")
def ing08_reference_extract(spark, sf_dir):
    """ING-08: references to the same act and to others, behind the texts of documents."""
    other = F.array_join(F.transform(legal.other_references(F.col("body")), lambda x: F.concat(x["act"], F.lit(":"), x["article"])), ";")
    return _referring(spark, sf_dir).select("doc_id", F.array_join(legal.self_references(F.col("body")), ";").alias("own"), other.alias("other"))


@query("""
SELECT source AS source_act_id, CAST(doc_id AS VARCHAR) AS source_article, source AS target_act_id, CAST(doc_id % 400 + 1 AS VARCHAR) AS target_article, NULL AS target_raw, 0.95::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL
UNION ALL SELECT source, CAST(doc_id AS VARCHAR), (SELECT arg_min(s, (length(s), s)) FROM (SELECT DISTINCT source AS s FROM documents WHERE length(source) > 4) WHERE contains(lower('the Act of ' || s || ' Law'), lower('Act of ' || d.source || ' Law'))),
  CAST(n_chars % 90 + 1 AS VARCHAR), 'Act of ' || source || ' Law', CASE WHEN length(source) > 4 THEN 0.8 ELSE 0.4 END FROM documents d WHERE text IS NOT NULL
""")
def ing09_reference_edges(spark, sf_dir):
    """ING-09: edges with what they are sure of; acts of short names are not known."""
    d = _referring(spark, sf_dir)
    acts = d.where(F.length("source") > 4).select(F.col("source").alias("act_id"), F.concat(F.lit("the Act of "), "source", F.lit(" Law")).alias("name")).distinct()
    return ingest.reference_edges(d.select(F.col("source").alias("act_id"), F.col("doc_id").cast("string").alias("article_number"), "body"), acts)


def _referring(spark, sf_dir):
    """doc_id, source, body: texts with two references behind them."""
    own, other = (F.col("doc_id") % 400 + 1).cast("string"), (F.col("n_chars") % 90 + 1).cast("string")
    said = F.concat(F.lit("; see Article "), own, F.lit(" of this Code. See Article "), other, F.lit(" of the Act of "), "source", F.lit(" Law."))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.concat("text", said).alias("body"))


@query("""
SELECT c_custkey, CASE WHEN regexp_matches(c_name, '0{3}1$') THEN 'a' ELSE 'b' END AS kind, strptime(lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '.0' || (c_custkey % 9 + 1) || '.2020', '%d.%m.%Y')::DATE::VARCHAR AS first_date, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '2021-03-04' END AS iso_date FROM customer
""")
def ing16_metadata(spark, sf_dir):
    """ING-16, SCA-41: dates from text, impossible ones left out."""
    day, month = F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), (F.col("c_custkey") % 9 + 1).cast("string")
    text = F.concat(F.lit("adopted "), day, F.lit(".0"), month, F.lit(".2020 or 31.02.2020, "), F.when(F.col("c_custkey") % 2 == 0, "then").otherwise("then 2021-03-04"))
    dates = legal.dates_in(text)
    kind = F.when(F.col("c_name").rlike("0{3}1$"), "a").otherwise("b")
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), F.get(dates, F.lit(0)).cast("string").alias("first_date"), F.get(dates, F.lit(1)).cast("string").alias("iso_date"))


@query("SELECT source, lang, min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY source, lang, sha256(text)")
def ing17_language_dedup(spark, sf_dir):
    """ING-17: one of equal contents of an identifier, the first asked for."""
    d = table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    return d.groupBy("source", "lang", "content_hash").agg(F.min("doc_id").alias("doc_id"))


@query(r"SELECT page_id, CASE WHEN contains(url, 'example.org') THEN regexp_replace(url, '#.*$', '') || '#' || page_id ELSE url END AS link FROM pages")
def ing14_deep_link(spark, sf_dir):
    """ING-14: an anchor as the fragment, on one host only."""
    return table(spark, sf_dir, "pages").select("page_id", ingest.deep_link(F.col("url"), F.col("page_id").cast("string"), "example.org").alias("link"))


@query()
def src04_html_blocks(spark, sf_dir):
    """SRC-04, SCA-28, WIN-14, UDF-05: blocks of pages."""
    return files.page_blocks(table(spark, sf_dir, "pages"))


@query()
def ing04_page_nodes(spark, sf_dir):
    """ING-04, WIN-11, WIN-16, UDF-04: the tree of each page."""
    return ingest.document_nodes(files.page_texts(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id"))


@query()
def ing05_page_chunks(spark, sf_dir):
    """ING-05, WIN-10, WIN-12: chunks of each page's nodes, made where the page is read."""
    return ingest.document_chunks(files.page_texts(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id"), 200, 300)


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unsupported' WHEN page_id % 5 = 1 THEN 'too_large' WHEN length(html) < 100 THEN 'too_short' ELSE 'ok' END AS status FROM pages")
def src14_uploads(spark, sf_dir):
    """SRC-07, SRC-14: uploads checked by kind, size and text."""
    name = F.when(F.col("page_id") % 5 == 0, "a.exe").when(F.col("page_id") % 2 == 0, "a.HTML").otherwise("b.txt")
    size = F.when(F.col("page_id") % 5 == 1, 30 * 1024 * 1024).otherwise(F.length("html"))
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.lit(None).cast("string").alias("mime"), size.alias("size"), F.length("html").alias("chars"))
    return files.checked_uploads(p).select("page_id", "status")
