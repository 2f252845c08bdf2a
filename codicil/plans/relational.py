"""Listings, statistics, joins, windows and records over the relational tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..config import DEFAULT as C
from ..operators import records
from ..operators.containment import held
from ..session import small, table
from ._register import query

long = lambda c: F.col(c).cast("long").alias(c)


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def src01_listing(spark, sf_dir):
    """SRC-01, SRT-09: filtered, ordered listing with limit and offset."""
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return rows.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(10).limit(50)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 64")
def src02_point_lookup(spark, sf_dir):
    """SRC-02: a key, pushed to the scan."""
    return table(spark, sf_dir, "orders").where("o_orderkey = 64").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT vec_id, round(list_dot_product(u, u), 6) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def src15_vector_export(spark, sf_dir):
    """SRC-15, SCA-45: unit vectors for a flat index."""
    from ..operators.dense import dot, l2_normalised

    rows = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalised(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("length"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderstatus AS content FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), s AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS content FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN t.content ELSE s.content END AS content,
  CASE WHEN t.o_orderkey IS NULL THEN 'new' WHEN s.o_orderkey IS NULL THEN 'kept' WHEN sha256(t.content) = sha256(s.content) THEN 'unchanged' ELSE 'amended' END AS change
FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey
""")
def src16_change_upsert(spark, sf_dir):
    """SRC-16, ING-12, JOIN full outer: upsert gated by a content hash."""
    o = table(spark, sf_dir, "orders")
    target = o.where("o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", F.col("o_orderstatus").alias("content"))
    staging = o.where("o_orderdate >= timestamp_ntz'1994-01-01'").select("o_orderkey", F.expr("CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END").alias("content"))
    return records.upsert(target, staging, ["o_orderkey"], "content")


@query("""
WITH fresh AS (SELECT l_orderkey, l_linenumber, l_returnflag, -1.0::DOUBLE AS l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01')
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.l_orderkey = l.l_orderkey AND f.l_returnflag = l.l_returnflag)
UNION ALL SELECT * FROM fresh
""")
def src17_slice_replace(spark, sf_dir):
    """SRC-17: replace the slices that a load brings."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    fresh = lines.where("l_returnflag = 'R' AND l_shipdate >= timestamp_ntz'1997-01-01'").select("l_orderkey", "l_linenumber", "l_returnflag", F.lit(-1.0).alias("l_quantity"))
    return records.replace_slice(rows, fresh, ["l_orderkey", "l_returnflag"])


@query("""
SELECT event_type AS connector, count(*) AS seen, count(*) FILTER (value > 50) AS created, count(*) FILTER (value < 1) AS errors, CASE WHEN count(*) FILTER (value < 1) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM events GROUP BY 1
""")
def src19_run_bookkeeping(spark, sf_dir):
    """SRC-19, AGG-10: counters of a run and its status."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("connector")).agg(F.count("*").alias("seen"), F.count_if(F.col("value") > 50).alias("created"), F.count_if(F.col("value") < 1).alias("errors"))
    return e.withColumn("status", F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed"))


@query("""
WITH h AS (SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1), cache AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE source = 'src0')
SELECT key, doc_id, n FROM h WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = h.key)
""")
def src21_embed_cache_dedupe(spark, sf_dir):
    """SRC-21, SCA-57: distinct texts that a cache does not hold."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    h = d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return h.join(d.where("source = 'src0'").select("key").distinct(), "key", "left_anti")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-23' ORDER BY ts DESC, event_id DESC LIMIT 100")
def src25_audit_log(spark, sf_dir):
    """SRC-24, SRC-25, FLT-05, STR-10: newest entries of a window of time."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error' AND ts >= timestamp_ntz'2024-01-23'")
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30' ORDER BY o_orderdate, o_orderkey")
def src29_ledger_statement(spark, sf_dir):
    """SRC-29: an inclusive range of time, ordered."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate BETWEEN timestamp_ntz'1995-01-01' AND timestamp_ntz'1995-06-30'")
    return rows.orderBy("o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT count(*) AS chunks, count(e.vec_id) AS embedded, CASE WHEN count(e.vec_id) = count(*) THEN 'ok' ELSE 'degraded' END AS status FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def src34_health(spark, sf_dir):
    """SRC-34, AGG-01, AGG-02: one row of counts and a status."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = d.join(e, d.doc_id == e.vec_id, "left").agg(F.count("*").alias("chunks"), F.count("vec_id").alias("embedded"))
    return rows.withColumn("status", F.when(F.col("embedded") == F.col("chunks"), "ok").otherwise("degraded"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), '#12') OR contains(lower(p_type), 'steel')")
def flt03_name_search(spark, sf_dir):
    """FLT-03, RET-08: case-insensitive containment over several columns."""
    has = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return table(spark, sf_dir, "part").where(has("p_name", "re") | has("p_brand", "#12") | has("p_type", "steel")).select("p_partkey", "p_name")


@query("""
SELECT DISTINCT s.user_id, c.c_custkey AS alert_id FROM customer c JOIN (SELECT s_suppkey AS user_id, CASE WHEN s_acctbal > 5000 THEN ['BUILDING', 'MACHINERY', 'AUTOMOBILE'][s_suppkey % 3 + 1] END AS act_type, CASE WHEN s_acctbal <= 5000 THEN '#' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS keyword FROM supplier) s
  ON c.c_mktsegment = s.act_type OR contains(lower(c.c_name), lower(s.keyword))
""")
def flt04_alerts_for_user(spark, sf_dir):
    """FLT-04, JOIN-13, SRC-28, SRC-37: alerts that a subscription to a kind or a keyword reaches."""
    subs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.expr("CASE WHEN s_acctbal > 5000 THEN element_at(array('BUILDING', 'MACHINERY', 'AUTOMOBILE'), cast(s_suppkey % 3 + 1 AS int)) END").alias("act_type"),
        F.expr("CASE WHEN s_acctbal <= 5000 THEN '#' || lpad(cast(s_suppkey AS string), 8, '0') END").alias("keyword"),
    )
    alerts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alert_id"), F.col("c_mktsegment").alias("act_type"), F.col("c_name").alias("name"))
    found = records.alerts_for(alerts, subs, ["name"]).select("user_id", "alert_id")
    # Rows are distinct already unless an alert stands in several.
    return found.distinct() if alerts.distinct().groupBy("alert_id").count().where("count > 1").limit(1).count() else found


@query("SELECT doc_id, 'S' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS tag, source || ', ' || (doc_id % 40) || '-modda' AS citation, round(n_chars / 7.0, 4) AS score FROM documents")
def flt07_citation_payload(spark, sf_dir):
    """FLT-07, SCA-30: tag, citation and a rounded score."""
    tag = F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), F.concat("source", F.lit(", "), F.col("doc_id") % 40, F.lit("-modda")).alias("citation"), F.round(F.col("n_chars") / 7.0, 4).alias("score"))


@query("SELECT n_name, r_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def join01_inner_dimensions(spark, sf_dir):
    """JOIN-01, JOIN-02: facts with small dimensions, which adaptive execution broadcasts."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "s_suppkey")


@query("SELECT c_mktsegment, count(DISTINCT c_custkey) AS acts, count(DISTINCT o_orderkey) AS nodes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join03_act_stats(spark, sf_dir):
    """JOIN-03, AGG-04, AGG-05: two distinct counts over a left join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("acts"), F.countDistinct("o_orderkey").alias("nodes"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS force, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS pos FROM orders)
SELECT query_id, higher, lower, rule FROM (
  SELECT a.o_custkey AS query_id, CASE WHEN a.force < b.force OR a.o_orderdate > b.o_orderdate THEN a.o_orderkey ELSE b.o_orderkey END AS higher, CASE WHEN a.force < b.force OR a.o_orderdate > b.o_orderdate THEN b.o_orderkey ELSE a.o_orderkey END AS lower,
    CASE WHEN a.force < b.force THEN 'lex superior' ELSE 'lex posterior' END AS rule, row_number() OVER (PARTITION BY a.o_custkey ORDER BY a.pos, b.pos) AS k
  FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.pos < b.pos WHERE a.force < b.force OR (a.force = b.force AND a.o_orderdate <> b.o_orderdate))
WHERE k <= 5
""")
def join08_conflict_pairs(spark, sf_dir):
    """JOIN-08, RET-28, SRT-07, SCA-40: the first five conflicts by force, then by date."""
    from ..operators.citations import conflicts

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("citation"), F.col("o_orderkey").alias("act_id"), (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("precedence"), F.col("o_orderdate").alias("effective"))
    order = Window.partitionBy("query_id").orderBy(F.col("precedence").desc(), F.col("effective").desc(), "citation")
    return conflicts(o.withColumn("pos", F.row_number().over(order)))


@query("""
WITH toc AS (SELECT page_id AS anchor_id, page_id % 60 AS base, page_id % 60 || '-' || page_id % 3 AS number, substr(url, 1, 20) AS heading FROM pages),
art AS (SELECT doc_id, doc_id % 60 AS base, (SELECT substr(url, 1, 20) FROM pages p WHERE p.page_id = doc_id % (SELECT count(*) FROM pages)) AS heading FROM documents),
m AS (SELECT doc_id, anchor_id, count(*) OVER (PARTITION BY doc_id) AS n, a.heading = t.heading AS same FROM art a JOIN toc t USING (base))
SELECT doc_id, CASE WHEN max(n) = 1 THEN min(anchor_id) WHEN count(*) FILTER (same) > 0 THEN min(anchor_id) FILTER (same) END AS anchor_id FROM m GROUP BY doc_id
""")
def join11_anchor_match(spark, sf_dir):
    """JOIN-11, ING-14: the only anchor of a base number, else the one of equal heading."""
    from ..operators.ingest import match_anchors

    p = table(spark, sf_dir, "pages")
    toc = p.select(F.col("page_id").alias("anchor_id"), (F.col("page_id") % 60).cast("string").alias("base"), F.substring("url", 1, 20).alias("heading"))
    pages = p.agg(F.count("*").alias("pages"))  # one row
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(pages)).select("doc_id", (F.col("doc_id") % 60).cast("string").alias("base"), (F.col("doc_id") % F.col("pages")).alias("page"))
    art = d.join(p.select(F.col("page_id").alias("page"), F.substring("url", 1, 20).alias("heading")), "page", "left").select("doc_id", "base", "heading")
    return match_anchors(art, toc, "doc_id").select("doc_id", "anchor_id")


@query("""
SELECT s_suppkey AS edge_id, p_partkey AS target, 0.75::DOUBLE AS confidence FROM (
  SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY length(p_name), p_partkey) AS k FROM supplier JOIN part ON contains(lower(p_name), chr(97 + CAST(s_suppkey % 26 AS INTEGER)) || chr(97 + CAST(s_suppkey * 7 % 26 AS INTEGER)))) WHERE k = 1
""")
def join12_late_resolution(spark, sf_dir):
    """JOIN-12, ING-10, T-15: dangling references resolved by the shortest name that holds them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.expr("char(97 + s_suppkey % 26) || char(97 + s_suppkey * 7 % 26)").alias("raw"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), "p_name")
    # Edges of one spelling have one target, so names meet spellings and not edges.
    edges = s.select("edge_id", F.lower("raw").alias("needle"))
    pairs = held(p.withColumn("name", F.lower("p_name")), edges.select("needle").distinct(), "name", "needle")
    best = pairs.groupBy("needle").agg(F.min(F.struct(F.length("p_name"), "target")).alias("b"))
    return edges.dropDuplicates(["edge_id", "needle"]).join(small(best, 100_000), "needle").groupBy("edge_id").agg(F.min("b").alias("b")).select("edge_id", F.col("b.target").alias("target"), F.lit(0.75).alias("confidence"))


@query("""
WITH RECURSIVE nodes AS (
  SELECT 'R' || r_regionkey AS id, NULL AS parent, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier
), t AS (SELECT id, label AS path, 1 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.label, t.depth + 1 FROM nodes n JOIN t ON n.parent = t.id)
SELECT id, path, CAST(depth AS BIGINT) AS depth FROM t
""")
def join14_tree_paths(spark, sf_dir):
    """JOIN-14, SRT-12, SRC-36: paths of a tree of bounded depth, one join for each level."""
    from ..operators.ingest import tree_paths

    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    nodes = r.select(key("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nodes = nodes.union(n.select(key("N", "n_nationkey"), key("R", "n_regionkey"), "n_name")).union(s.select(key("S", "s_suppkey"), key("N", "s_nationkey"), "s_name"))
    return tree_paths(nodes, 6)


@query("SELECT a.p_partkey AS item, b.p_partkey AS twin FROM part a JOIN part b ON lower(trim(a.p_name)) = lower(trim(b.p_name)) AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def join17_gold_audit(spark, sf_dir):
    """JOIN-17, RET-33: other articles of the same act and title."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower(F.trim("p_name")).alias("title"))
    q = p.select(F.col("p_partkey").alias("twin"), "p_brand", "title")
    return p.join(q, ["p_brand", "title"]).where("p_partkey < twin").select(F.col("p_partkey").alias("item"), "twin")


@query("""
SELECT o_custkey, o_orderstatus, valid_from, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderstatus) AS valid_to FROM (
  SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS before FROM orders) WHERE before IS NULL OR before <> o_orderstatus
""")
def win05_scd2_history(spark, sf_dir):
    """WIN-05, ING-11, WIN-15: versions of a value, unchanged rows dropped."""
    return records.history(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderstatus")


@query("""
WITH h AS (SELECT o_custkey, o_orderstatus, valid_from, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderstatus) AS valid_to FROM (
  SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS before FROM orders) WHERE before IS NULL OR before <> o_orderstatus)
SELECT o_custkey, o_orderstatus FROM h WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR TIMESTAMP '1996-01-01' < valid_to)
""")
def join18_as_of(spark, sf_dir):
    """JOIN-18, JOIN-19, SRC-35: what was valid at a date."""
    h = records.history(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderstatus")
    return records.as_of(h, F.expr("timestamp_ntz'1996-01-01'")).select("o_custkey", "o_orderstatus")


@query("SELECT coalesce(event_type, 'unknown') AS kind, count(*) AS n, count(*) FILTER (value > 10) AS answered, round(count(*) FILTER (value > 10) * 1.0 / count(*), 4) AS answer_rate, round(avg(value), 1) AS avg_value FROM events GROUP BY 1")
def agg03_log_stats(spark, sf_dir):
    """AGG-03, AGG-04: filtered counts and averages in one pass."""
    answered = F.count_if(F.col("value") > 10)
    return table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), answered.alias("answered"), F.round(answered / F.count("*"), 4).alias("answer_rate"), F.round(F.avg("value"), 1).alias("avg_value"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount FROM lineitem")
def agg06_article_index(spark, sf_dir):
    """AGG-06: distinct rows of five columns."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount").distinct()


@query("SELECT count(*) AS n, round(avg(CASE WHEN (quality = 0) = (toxic = 0) THEN 1.0 ELSE 0 END), 6) AS rate FROM labels WHERE quality = 0")
def agg09_refusal_rate(spark, sf_dir):
    """AGG-09: share of correct refusals."""
    return table(spark, sf_dir, "labels").where("quality = 0").agg(F.count("*").alias("n"), F.round(F.avg(F.when((F.col("quality") == 0) == (F.col("toxic") == 0), 1.0).otherwise(0.0)), 6).alias("rate"))


@query("""
SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_kind, list_slice(list_sort(list_distinct(list(event_type))), 1, 3) AS kinds FROM events GROUP BY user_id
""")
def agg11_profile(spark, sf_dir):
    """AGG-11, SET-05: count, last value and a sorted, cut set (sorted before the cut)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last_kind"), F.slice(F.sort_array(F.collect_set("event_type")), 1, 3).alias("kinds"))


@query("SELECT event_type AS model, count(*) AS requests, count(*) FILTER (value < 1) AS failures, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(floor(value) AS BIGINT)) // count(*) AS BIGINT) AS avg_latency FROM events GROUP BY 1")
def agg13_usage_by_model(spark, sf_dir):
    """AGG-13: usage with an integer mean."""
    whole = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("requests"), F.count_if(F.col("value") < 1).alias("failures"), F.sum(whole).alias("tokens"), F.expr("sum(cast(floor(value) as bigint)) div count(*)").alias("avg_latency"))


@query("SELECT source, round(100 * avg(CASE WHEN e.vec_id IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS coverage, count(*) AS n FROM documents LEFT JOIN embeddings e ON vec_id = doc_id GROUP BY ROLLUP (source)")
def agg14_coverage_rollup(spark, sf_dir):
    """AGG-14: coverage for each source and in total."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id")
    return d.join(e, d.doc_id == e.vec_id, "left").rollup("source").agg(F.round(100 * F.avg(F.when(F.col("vec_id").isNotNull(), 1.0).otherwise(0.0)), 4).alias("coverage"), F.count("*").alias("n"))


@query("SELECT l_returnflag, median(l_quantity) AS median_quantity, first(s) AS modal_size FROM lineitem JOIN (SELECT p_size AS s FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_size LIMIT 1) ON true GROUP BY 1")
def agg15_modal_value(spark, sf_dir):
    """AGG-15, AGG-08: the most frequent value (the smallest of several) and medians."""
    top = table(spark, sf_dir, "part").groupBy("p_size").count().orderBy(F.col("count").desc(), "p_size").limit(1)
    modal = top.first()["p_size"]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity")).withColumn("modal_size", F.lit(modal))


@query("SELECT l_orderkey, sha256(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY 1")
def agg16_digest(spark, sf_dir):
    """AGG-16, AGG-17: a digest of ordered rows."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat(F.col("l_linenumber"), F.lit(":"), F.col("l_partkey")).alias("s"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["s"]), "\n"), 256).alias("digest"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN length(text) > 60 AND role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question_turn FROM conversations
""")
def win07_carry_question(spark, sf_dir):
    """WIN-07: the last real question before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.when((F.length("text") > 60) & (F.col("role") == "user"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(asked, ignorenulls=True).over(w).alias("question_turn"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def win08_history_window(spark, sf_dir):
    """WIN-08, JOIN-15, SRC-26: the newest messages of each conversation."""
    return records.capped(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", 4).select("conv_id", "turn", "role")


@query("""
SELECT user_id, event_id, round(value * pow(2, -((epoch(TIMESTAMP '2024-03-01') - floor(epoch(ts))) / 604800.0) / 14), 6) AS effective FROM events
WHERE ts >= TIMESTAMP '2024-01-05' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20
""")
def win09_memory_cap_decay(spark, sf_dir):
    """WIN-09, STR-09, SCA-37, SCA-38: the newest rows of each user and their decayed weights at a fixed time."""
    rows = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05'")
    rows = records.capped(rows, "user_id", "ts", "event_id", 20)
    return rows.select("user_id", "event_id", F.round(records.decayed(F.col("value"), F.col("ts").cast("timestamp"), F.expr("timestamp'2024-03-01'")), 6).alias("effective"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal, list(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trail FROM customer")
def win16_sibling_ordinal(spark, sf_dir):
    """WIN-12, WIN-16: ordinals among siblings and the last three headings before each."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    trail = F.collect_list("c_name").over(w.rowsBetween(-2, 0))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), trail.alias("trail"))


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def win14_consecutive_duplicates(spark, sf_dir):
    """WIN-14: consecutive repeats dropped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    return rows.where(~F.col("event_type").eqNullSafe(F.col("before"))).select("user_id", "event_id")


@query("""
SELECT user_id, CAST(island AS BIGINT) AS run_start, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (
  SELECT user_id, event_id, sum(flag) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS flag FROM events)) GROUP BY 1, 2
""")
def win13_islands(spark, sf_dir):
    """WIN-13, ING-13: consecutive rows of one kind as one group."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    flag = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("flag", flag).withColumn("run_start", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run_start").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""
SELECT identity, bucket, count(*) AS n, greatest(0, count(*) - CASE WHEN CAST(identity AS BIGINT) % 3 = 0 THEN 1 ELSE 4 END) AS refused, max(greatest(1, bucket + 86400 - sec)) AS retry_after
FROM (SELECT CAST(user_id AS VARCHAR) AS identity, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS bucket, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) GROUP BY identity, bucket
""")
def str01_quota_daily(spark, sf_dir):
    """STR-01, STR-02, SCA-36: a fixed daily window for each identity, by tier."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("identity"), F.when(F.col("user_id") % 3 == 0, "free").otherwise("pro").alias("tier"), F.col("ts").cast("timestamp").alias("ts"))
    limits = F.when(F.col("tier") == "free", 1).otherwise(4)
    counted = records.quota(rows, limits)
    wait = rows.groupBy("identity", records.bucket(F.col("ts")).alias("bucket")).agg(F.max(records.retry_after(F.col("ts"))).alias("retry_after"))
    return counted.join(wait, ["identity", "bucket"]).select("identity", "bucket", "n", "refused", "retry_after")


@query("""
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS length, count(*) >= 3 AS opened FROM (
  SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) WHERE event_type = 'error' GROUP BY 1, 2
""")
def str07_breaker_runs(spark, sf_dir):
    """STR-07: runs of failures, and whether they open the breaker."""
    rows = records.error_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.select("user_id", "run", "length", (F.col("length") >= C.breaker_failures).alias("opened"))


@query()
def str08_payments_fold(spark, sf_dir):
    """STR-08, STR-12, SRC-38, SCA-42, SCA-51: orders as payment calls, repeated, folded into a ledger."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("payme_id"), F.col("o_custkey").cast("string").alias("user_id"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("at"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    price = F.when(F.col("o_totalprice") < 20_000, 1).otherwise(C.price_tiyin).cast("long")
    call = lambda m, at, where: o.where(where).select("payme_id", "user_id", F.lit(m).alias("method"), price.alias("amount"), (F.col("at") + at).alias("at"), F.lit(5).alias("reason"))
    calls = call("create", 0, "true").union(call("create", 1000, "o_orderpriority < '3'")).union(call("perform", 60_000, "o_orderstatus <> 'O'")).union(call("perform", 13 * 3_600_000, "o_orderpriority LIKE '4%'")).union(call("cancel", 120_000, "o_orderpriority LIKE '5%'"))
    return records.fold_payments(calls)


@query("SELECT user_id, round(avg(1 / (1 + exp(-(value - 50) / 10))), 6) AS score, round(sum(least(60.0, 1.5 * pow(2, event_id % 8))), 6) AS waited, CAST(max(CASE WHEN event_id % 3 = 0 THEN 'hour' WHEN event_id % 3 = 1 THEN 'day' ELSE '90s' END) AS VARCHAR) AS label FROM events GROUP BY 1")
def sca44_math(spark, sf_dir):
    """SCA-43, SCA-44, SCA-49: sigmoid, backoff and window labels."""
    e = table(spark, sf_dir, "events")
    seconds = F.when(F.col("event_id") % 3 == 0, 3600).when(F.col("event_id") % 3 == 1, 86_400).otherwise(90)
    return e.groupBy("user_id").agg(F.round(F.avg(records.sigmoid((F.col("value") - 50) / 10)), 6).alias("score"), F.round(F.sum(records.backoff(F.col("event_id") % 8)), 6).alias("waited"), F.max(records.window_label(seconds)).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'event: ' || event_type || chr(10) || 'data: ' || props AS frame FROM events")
def sca54_json(spark, sf_dir):
    """SCA-54, SCA-56: JSON fields and event frames."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props").alias("frame"))


@query("""
SELECT c_custkey, '+998' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone FROM customer WHERE c_custkey % 4 <> 3
UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 4 = 3
""")
def sca26_phone(spark, sf_dir):
    """SCA-26: any spelling of a number becomes one."""
    n = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    raw = F.when(F.col("c_custkey") % 4 == 0, n).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("+998 ("), F.substring(n, 1, 2), F.lit(") "), F.substring(n, 3, 7))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("8-998-"), n)).otherwise(F.concat(F.lit("7"), n))
    return table(spark, sf_dir, "customer").select("c_custkey", records.e164(raw).alias("phone"))


@query("SELECT c_custkey, greatest(TIMESTAMP '1997-01-01', coalesce(max(o_orderdate), TIMESTAMP '1997-01-01')) + INTERVAL 30 DAY AS expires FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def sca39_extension(spark, sf_dir):
    """SCA-39: a subscription runs on from the later of now and its expiry."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"))
    return rows.select("c_custkey", records.extended(F.expr("timestamp_ntz'1997-01-01'"), F.col("last")).alias("expires"))
