"""Metadata from titles, filters, anchors, missing vectors, codes and streamed answers."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import legal, text
from ..operators import ingest, lexical, records
from ..session import table
from ._register import query
from .retrieval import CHUNKS, chunks

TITLES = (
    "Mehnat kodeksi, oʻzgartirish kiritilgan, raqam: ",
    "О защите прав. Закон, утратил силу, № ",
    "Constitution, repealed, N ",
    "Prezidentning qarori, kuchga kirmagan, son ",
    "Vazirlar Mahkamasi nizom, № ",
    "Приказ Верховного суда, с изменениями, № ",
    "Oliy Majlis farmon, raqam ",
    "Tax Code as amended № ",
)


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in items) + "]"


@query(f"""
WITH t AS (SELECT c_custkey, {_sql_list(TITLES)}[c_custkey % {len(TITLES)} + 1] || 'AB-' || c_custkey AS title FROM customer)
SELECT c_custkey,
  CASE WHEN regexp_matches(title, '(?i)kodeks|кодекс|tax code') THEN 'code' WHEN regexp_matches(title, '(?i)constitution') THEN 'constitution' WHEN regexp_matches(title, '(?i)farmon') THEN 'presidential_decree'
    WHEN regexp_matches(title, '(?i)prezident[a-z]* +qaror') THEN 'presidential_resolution' WHEN regexp_matches(title, '(?i)vazirlar mahkamasi') THEN 'cabinet_resolution'
    WHEN regexp_matches(title, '(?i) закон,') THEN 'law' WHEN regexp_matches(title, '(?i)приказ|nizom') THEN 'ministerial_act' ELSE 'law' END AS act_type,
  CASE WHEN regexp_matches(title, '(?i)утратил силу|repealed') THEN 'repealed' WHEN regexp_matches(title, '(?i)oʻzgartirish kiritilgan|с изменениями|amended') THEN 'amended' WHEN regexp_matches(title, '(?i)kuchga kirmagan') THEN 'not_yet_in_force' ELSE 'in_force' END AS status,
  nullif(regexp_extract(title, '(?i)(?:№|N|son|сон|raqam)\\s*[:\\-]?\\s*([A-ZА-Я0-9][A-ZА-Я0-9\\-/]{{1,24}})', 1), '') AS doc_number,
  CASE WHEN regexp_matches(title, '(?i)oliy majlis') THEN 'Oliy Majlis' WHEN regexp_matches(title, '(?i)prezident') THEN 'President of the Republic of Uzbekistan' WHEN regexp_matches(title, '(?i)vazirlar mahkamasi') THEN 'Cabinet of Ministers' WHEN regexp_matches(title, '(?i)верховн[а-я]+ суд') THEN 'Supreme Court' END AS issuer
FROM t
""")
def ing16_title_metadata(spark, sf_dir):
    """ING-16: kind, standing, number and issuer that a title names."""
    names = F.array(*[F.lit(t) for t in TITLES])
    title = F.concat(F.element_at(names, (F.col("c_custkey") % len(TITLES) + 1).cast("int")), F.lit("AB-"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", legal.title_metadata(title).alias("m")).select("c_custkey", "m.*")


@query(f"WITH {CHUNKS} SELECT chunk_id, act_id, language, act_type FROM chunks WHERE language IN ('en', 'fr') AND act_type IN ('code', 'law') AND ['in_force', 'amended', 'repealed'][chunk_id % 3 + 1] <> 'repealed'")
def flt01_admitted_chunks(spark, sf_dir):
    """FLT-01: language, kind and standing; an empty list of acts asks nothing."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("in_force", "amended", "repealed")]), (F.col("chunk_id") % 3 + 1).cast("int"))
    rows = chunks(spark, sf_dir).withColumn("status", status)
    return lexical.admitted(rows, ["en", "fr"], ["code", "law"], [], in_force_only=True).select("chunk_id", "act_id", "language", "act_type")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NULL")
def src20_only_missing(spark, sf_dir):
    """SRC-20: the rows that a rewrite of missing vectors has to embed."""
    have = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left_anti")


@query("SELECT user_id AS phone, event_id AS code_id FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def src39_newest_code(spark, sf_dir):
    """SRC-39: the latest code of each phone that is not consumed."""
    codes = table(spark, sf_dir, "events").select(F.col("user_id").alias("phone"), F.col("event_id").alias("code_id"), F.col("ts").alias("created_at"), (F.col("event_type") == "purchase").alias("consumed"))
    return records.newest_code(codes).select("phone", "code_id")


@query("""
SELECT conv_id AS request, CASE WHEN bool_or(turn % 3 = 2) THEN max_by(text, turn) FILTER (turn % 3 = 2) ELSE string_agg(text, '' ORDER BY turn) END AS answer, bool_or(turn % 3 = 2) AS final
FROM (SELECT DISTINCT conv_id, turn, min(text) OVER (PARTITION BY conv_id, turn) AS text FROM conversations WHERE text IS NOT NULL) GROUP BY 1
""")
def str11_streamed_answers(spark, sf_dir):
    """STR-11: the final event replaces what was streamed."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    kind = F.when(F.col("turn") % 3 == 2, "done").otherwise("delta")
    return records.streamed_answers(turns.select(F.col("conv_id").alias("request"), F.col("turn").alias("seq"), kind.alias("kind"), "text"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'a' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'old' END AS anchor_id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 40 ELSE o_orderkey % 40 END AS article_number,
  o_custkey % 3 = 0 AND o_custkey % 40 <> o_orderkey % 40 AS renumbered FROM orders
""")
def ing15_backfill(spark, sf_dir):
    """ING-15: anchors of a table of contents brought to rows, with its numbers."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", (F.col("o_orderkey") % 40).alias("article_number"), F.when(F.col("o_orderkey") % 2 == 0, "old").alias("anchor_id"))
    hits = o.where("o_custkey % 3 = 0").select("o_orderkey", F.concat(F.lit("a"), F.col("o_custkey")).alias("anchor_id"), (F.col("o_custkey") % 40).alias("article_number"))
    return ingest.backfilled(rows, hits, "o_orderkey", fix_numbers=True)


@query("SELECT doc_id, replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents")
def sca29_markup_safe(spark, sf_dir):
    """SCA-29: text that may stand in markup."""
    return table(spark, sf_dir, "documents").select("doc_id", text.markup_safe(F.col("text")).alias("safe"))


@query("SELECT b.item_id AS query_id, CASE WHEN coalesce(length(d.text), 0) = 0 THEN b.text ELSE b.text || chr(10) || chr(10) || substr(d.text, 1, 4000) END AS wanted FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def sca32_question_with_document(spark, sf_dir):
    """SCA-32: a question with the beginning of the document that it asks about."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("document"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return b.join(d, "query_id", "left").select("query_id", text.question_with_document(F.col("question"), F.col("document")).alias("wanted"))


@query("""SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS payload FROM events""")
def sca53_payload(spark, sf_dir):
    """SCA-53: an alert's payload as JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("payload"))


@query("""
WITH n AS (SELECT o_custkey AS act_id, o_orderkey AS ordinal, CAST(o_orderkey % 12 AS VARCHAR) || '/' || o_orderstatus AS path FROM orders)
SELECT act_id, path, ordinal, row_number() OVER (PARTITION BY act_id ORDER BY path, ordinal) AS nth FROM n
""")
def srt12_tree_order(spark, sf_dir):
    """SRT-12, SRC-36: the nodes of an act by path, as a string, and ordinal."""
    path = F.concat((F.col("o_orderkey") % 12).cast("string"), F.lit("/"), F.col("o_orderstatus"))
    n = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("act_id"), path.alias("path"), F.col("o_orderkey").alias("ordinal"))
    return n.withColumn("nth", F.row_number().over(Window.partitionBy("act_id").orderBy("path", "ordinal")).cast("long"))


@query("SELECT o_orderkey AS payme_id, o_custkey AS user_id FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1")
def src38_waiting_payments(spark, sf_dir):
    """SRC-38: open transactions of users who have an earlier open one."""
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payme_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("create_time"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("state"))
    return records.one_open_each(ledger).select("payme_id", "user_id")
