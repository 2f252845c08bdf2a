"""Stores, versions at a time, names in titles, clauses and inverted lists over the given tables."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import ann, asof, clauses, containment, dense, payments
from ..scratch import folder
from ..session import table
from ..sources.buckets import BucketedTable, upserted
from ..sources.cache import CachedMap, rewrite
from ._register import query
from .retrieval import query_vectors, vectors


@query("""
WITH staged AS (
  SELECT o_custkey AS k, o_orderdate AS since, o_orderstatus || o_orderpriority AS body, o_orderkey % 3 AS part FROM orders
), newest AS (
  SELECT k, part, max(since) AS since FROM staged GROUP BY ALL
), given AS (
  SELECT s.k, s.part, s.since, max(body) AS body FROM staged s JOIN newest n ON n.k = s.k AND n.part = s.part AND n.since = s.since GROUP BY ALL
), ranked AS (
  SELECT k, since, body, part, row_number() OVER (PARTITION BY k ORDER BY part) AS nth FROM given
), folded AS (
  SELECT k, since, body FROM ranked WHERE nth = 1
), second AS (
  SELECT r.k, CASE WHEN f.k IS NULL THEN r.since WHEN r.body = f.body OR r.since < f.since THEN f.since ELSE r.since END AS since, CASE WHEN f.k IS NULL OR NOT (r.body = f.body OR r.since < f.since) THEN r.body ELSE f.body END AS body
  FROM ranked r LEFT JOIN folded f USING (k) WHERE r.nth = 2
), two AS (
  SELECT f.k, coalesce(s.since, f.since) AS since, coalesce(s.body, f.body) AS body FROM folded f LEFT JOIN second s USING (k)
), third AS (
  SELECT r.k, CASE WHEN r.body = t.body OR r.since < t.since THEN t.since ELSE r.since END AS since, CASE WHEN r.body = t.body OR r.since < t.since THEN t.body ELSE r.body END AS body FROM ranked r JOIN two t USING (k) WHERE r.nth = 3
)
SELECT t.k, coalesce(h.since, t.since) AS since, coalesce(h.body, t.body) AS body FROM two t LEFT JOIN third h USING (k)
""")
def str03_bucketed_upsert(spark, sf_dir):
    """STR-03, ING-12: three batches merged into a table in buckets; the newest content of a key stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since"), F.concat("o_orderstatus", "o_orderpriority").alias("body"), (F.col("o_orderkey") % 3).alias("part"))
    kinds = dict(o.dtypes)
    made = BucketedTable(spark, folder(spark, "upsert"), f"k {kinds['k']}, since {kinds['since']}, body string", ["k"], 16)
    for n in range(3):  # the table's batches, one after the other
        made.merge(o.where(F.col("part") == n).drop("part"), upserted(["k"], "body", "since"), ("orders", n))
    return made.read()


@query("""
WITH v AS (SELECT o_custkey AS custkey, o_orderdate AS since, max(o_orderkey) AS orderkey FROM orders GROUP BY ALL)
SELECT e.event_id, v.orderkey FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) - INTERVAL 29 YEAR AS at FROM events) e ASOF LEFT JOIN v ON v.custkey = e.user_id AND e.at >= v.since
""")
def join18_as_of_join(spark, sf_dir):
    """JOIN-18, JOIN-19, SRC-35: for each event the order that its customer had last by then, in one ordered pass."""
    v = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("since")).agg(F.max("o_orderkey").alias("orderkey")).withColumnRenamed("o_custkey", "custkey")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("custkey"), (F.col("ts").cast("timestamp_ntz") - F.expr("INTERVAL 29 YEAR")).alias("at"))
    return asof.as_of_join(e, v, ["custkey"], "at", "since").select("event_id", "orderkey")


_NAMES = "SELECT n_nationkey AS name_id, CASE WHEN n_nationkey % 2 = 0 THEN lower(substr(n_name, 1, 4)) ELSE '0' || n_nationkey END AS name FROM nation"


def _titles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("in_force", "repealed", "amended")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("act_id"), F.col("s_name").alias("short_name"), F.concat_ws(" ", "n_name", "s_name").alias("title_uz"), F.lit(None).cast("string").alias("title_ru"), F.col("n_name").alias("title_en"), status.alias("status"))


_FOUND = f"""names AS ({_NAMES}), acts AS (
  SELECT s_suppkey AS act_id, unnest([lower(s_name), lower(n_name || ' ' || s_name), lower(n_name)]) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 1
), best AS (
  SELECT name_id, act_id, min(length(text)) AS length FROM names JOIN acts ON contains(text, name) GROUP BY ALL
), found AS (
  SELECT name_id, act_id, row_number() OVER (PARTITION BY name_id ORDER BY length, act_id) AS pos FROM best
)"""


def _asked(spark, sf_dir):
    name = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN lower(substr(n_name, 1, 4)) ELSE '0' || n_nationkey END")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name_id"), name.alias("name"))


@query(f"WITH {_FOUND} SELECT name_id, act_id, pos FROM found WHERE pos <= 5")
def ret08_acts_by_name(spark, sf_dir):
    """RET-08, FLT-03: the acts whose name or title holds a name, the shortest first, five for each."""
    return containment.acts_by_name(_asked(spark, sf_dir), _titles(spark, sf_dir)).select("name_id", "act_id", F.col("pos").cast("long").alias("pos"))


@query(f"""
WITH {_FOUND}, hits AS (
  SELECT f.name_id, f.pos AS act_pos, act_id, ps.l_orderkey * 10 + ps.l_linenumber AS chunk_id FROM found f JOIN lineitem ps ON ps.l_suppkey = act_id AND ps.l_linenumber = f.name_id % 4 + 1 WHERE f.pos <= 3
)
SELECT name_id, chunk_id, act_id, row_number() OVER (PARTITION BY name_id ORDER BY act_pos, chunk_id) AS pos FROM hits QUALIFY pos <= 20
""")
def ret25_ask_by_article(spark, sf_dir):
    """RET-25: the chunks of an article of the acts that a name means."""
    chunk = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")
    chunks = table(spark, sf_dir, "lineitem").select(chunk, F.col("l_suppkey").alias("act_id"), F.col("l_linenumber").cast("string").alias("article_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    asked = _asked(spark, sf_dir).withColumn("article_number", (F.col("name_id") % 4 + 1).cast("string"))
    return containment.by_article(asked, _titles(spark, sf_dir), chunks).select("name_id", "chunk_id", "act_id", F.col("pos").cast("long").alias("pos"))


@query()
def ret30_clauses(spark, sf_dir):
    """RET-30: documents in their numbered clauses, with what they stand in; tests hold it against a plain split."""
    return clauses.clauses(table(spark, sf_dir, "documents")).select("doc_id", "ix", "start", F.length("text").alias("n_chars"), "number", "level", "parent")


@query()
def ret01_inverted_lists(spark, sf_dir):
    """RET-01: approximate search in probed lists; tests hold its recall against the exact search."""
    path = folder(spark, "lists")
    ann.build(vectors(spark, sf_dir), path, lists=16)
    found = ann.search(spark, path, query_vectors(spark, sf_dir), 40, probes=15)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id FROM (
  SELECT b.item_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(greatest(0.0, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
    / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])))), 9) DESC, c.vec_id) AS rank
  FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id CROSS JOIN embeddings c) WHERE rank <= 40)
SELECT count(*) AS expected, true AS recalled FROM e
""")
def ret01_inverted_lists_recall(spark, sf_dir):
    """RET-01: whether the probed lists hold 95 % of the exact neighbours."""
    found = ret01_inverted_lists(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    exact = dense.knn(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 40).select("query_id", "chunk_id")
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("expected"), (F.count("hit") >= 0.95 * F.count("*")).alias("recalled"))


@query()
def str08_payment_books(spark, sf_dir):
    """STR-08, STR-12, SRC-38: each user's payments after all calls, with time-outs and one open payment at a time."""
    price = payments.DEFAULT.price_tiyin
    at = (F.unix_millis(F.col("ts").cast("timestamp"))).alias("at")
    method = F.element_at(F.array(*[F.lit(m) for m in ("create", "perform", "create", "cancel")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").cast("string").alias("user_id"), F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 400)).alias("payme_id"), method.alias("method"), F.when(F.col("event_type") == "view", F.lit(1)).otherwise(price).cast("long").alias("amount"), at, F.when(F.col("event_type") == "purchase", 3).alias("reason"))
    return payments.books(calls)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS value, (SELECT count(DISTINCT text) FROM documents) AS mapped FROM documents")
def src21_cached_map(spark, sf_dir):
    """SRC-21, SCA-57: a costly map of texts behind a cache; a second run maps nothing."""
    cache = CachedMap(spark, folder(spark, "cache"), "long", 3600, 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measure = lambda rows: rows.withColumn("value", F.length("text").cast("long"))
    cache.apply(docs, measure, 0)
    again = cache.apply(docs, lambda rows: measure(rows).withColumn("value", F.lit(-1).cast("long")), 60)
    return again.select("doc_id", "value", F.lit(cache.table.read().count()).alias("mapped"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'made ' || o_orderkey ELSE o_orderstatus END AS body FROM orders")
def src20_rewrite_missing(spark, sf_dir):
    """SRC-20: the rows of a stored table that lack a value get one, some buckets at a time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("body"))
    made = BucketedTable(spark, folder(spark, "rewrite"), f"o_orderkey {dict(o.dtypes)['o_orderkey']}, body string", ["o_orderkey"], 8)
    made.merge(o, lambda current, staged: staged)
    rewrite(made, F.col("body").isNull(), lambda rows: rows.withColumn("body", F.concat(F.lit("made "), "o_orderkey")), 4)
    return made.read()
