"""The remaining listings, predicates and text rules of the inventory."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import legal, text
from ..operators import citations, layout, lexical
from ..session import table
from ._register import query
from .texts import matches_sql


@query("SELECT d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NOT NULL AND d.text IS NOT NULL AND d.source IS NOT NULL")
def flt02_null_rejection(spark, sf_dir):
    """FLT-02: rows that have all that a branch needs."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.where("text IS NOT NULL AND source IS NOT NULL").join(e.where("embedding IS NOT NULL"), d.doc_id == e.vec_id, "left_semi").select("doc_id")


@query("SELECT item_id AS query_id, list_distinct_lang[1] AS first_lang, len(list_distinct_lang) AS n FROM (SELECT item_id, list_concat([['uz-Latn', 'uz-Cyrl', 'ru', 'en'][item_id % 4 + 1]], list_filter(['uz-Latn', 'uz-Cyrl', 'ru', 'en'], lambda x: x <> ['uz-Latn', 'uz-Cyrl', 'ru', 'en'][item_id % 4 + 1])) AS list_distinct_lang FROM benchmark)")
def flt08_language_order(spark, sf_dir):
    """FLT-08: languages to search, the question's first."""
    lang = F.element_at(F.array(*[F.lit(x) for x in ("uz-Latn", "uz-Cyrl", "ru", "en")]), (F.col("item_id") % 4 + 1).cast("int"))
    order = text.target_languages(lang)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.get(order, F.lit(0)).alias("first_lang"), F.size(order).cast("long").alias("n"))


@query("SELECT conv_id, turn FROM conversations c LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = c.conv_id WHERE u.user_id IS NULL OR u.user_id = 7")
def flt09_ownership(spark, sf_dir):
    """FLT-09, SRC-27: rows of nobody, or of the one who asks."""
    c, u = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events").select("user_id").distinct()
    return c.join(u, c.conv_id == u.user_id, "left").where("user_id IS NULL OR user_id = 7").select("conv_id", "turn")


@query("SELECT event_id, user_id, event_type, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type IN ('purchase', 'signup') AND ts >= TIMESTAMP '2024-01-15'")
def join02_recent_alerts(spark, sf_dir):
    """JOIN-02, SRC-37: recent alerts with their acts."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup') AND ts >= timestamp_ntz'2024-01-15'")
    c = table(spark, sf_dir, "customer")
    return e.join(c, e.user_id == c.c_custkey).select("event_id", "user_id", "event_type", "c_mktsegment")


@query("SELECT CAST(user_id AS VARCHAR) AS identity, event_type AS route, date_trunc('day', ts) AS day, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL")
def src22_audit_rows(spark, sf_dir):
    """SRC-22: audit rows by day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("identity"), F.col("event_type").alias("route"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


_KEYS = " ".join(f"WHEN {matches_sql('name', p)} THEN '{k}'" for k, p in citations.ACT_KEYS)


@query(f"""
WITH n AS (SELECT doc_id, left(text, 60) || CASE lang WHEN 'en' THEN ' labour code' WHEN 'de' THEN ' Уголовно-процессуальный кодекс' WHEN 'fr' THEN ' Ер кодекси' ELSE '' END || CASE WHEN n_chars % 2 = 0 THEN ' and the Constitution' ELSE '' END AS name FROM documents)
SELECT doc_id, CASE {_KEYS} END AS key FROM n
""")
def sca20_act_key(spark, sf_dir):
    """SCA-20: the code that a name means, the first rule that fits."""
    own = F.when(F.col("lang") == "en", " labour code").when(F.col("lang") == "de", " Уголовно-процессуальный кодекс").when(F.col("lang") == "fr", " Ер кодекси").otherwise("")
    name = F.concat(F.substring("text", 1, 60), own, F.when(F.col("n_chars") % 2 == 0, " and the Constitution").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", citations.act_key(name).alias("key"))


@query(r'''
WITH t AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_ʻʼ‘’''´`]{2,}'), lambda x: translate(lower(x), 'ʻʼ‘’''´`', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^\p{Nd}+$')) AS w FROM conversations),
k AS (SELECT *, list_filter(w, lambda x: NOT list_contains(string_split('@FRAMING@', ' '), x)) AS l FROM t), j AS (SELECT *, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE w END, ' ') AS joined FROM k)
SELECT conv_id, turn, CASE WHEN joined <> '' AND length(joined) >= 0.4 * length(trim(text)) THEN joined ELSE text END AS stripped FROM j
'''.replace("@FRAMING@", " ".join(text.FRAMING["en"])))
def sca12_strip_framing(spark, sf_dir):
    """SCA-10, SCA-12: the content of messages, unless too little is left."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_framing(F.col("text"), "en").alias("stripped"))


BLOCKS = ("Audioni tinglash | ", "hujjatga taklif yuborish — ", " - 12 - ", "bet 7", "1999", "20245", "page 3 of 9", "")


@query(r"""
WITH b AS (SELECT page_id, ['Audioni tinglash | ', 'hujjatga taklif yuborish — ', ' - 12 - ', 'bet 7', '1999', '20245', 'page 3 of 9', ''][page_id % 8 + 1] || CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS line FROM pages)
SELECT page_id, regexp_replace(replace(replace(lower(line), 'audioni tinglash', ''), 'hujjatga taklif yuborish', ''), '[\s|/·—–-]+', '', 'g') = '' AS chrome, regexp_matches(line, '(?i)^\s*(\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—]|(page|bet|стр\.?)\s*\d{1,4})\s*$') AS noise FROM b
""")
def sca28_chrome(spark, sf_dir):
    """SCA-28, SCA-33: page furniture and page numbers among the lines of pages."""
    at = (F.col("page_id") % len(BLOCKS) + 1).cast("int")
    line = F.concat(F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), at), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", layout.is_chrome(line).alias("chrome"), layout.is_page_noise(line).alias("noise"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment < 'F' THEN c_mktsegment END, CASE WHEN c_acctbal > 0 THEN c_name END, CASE WHEN c_nationkey > 5 THEN 'nation ' || c_nationkey END, 'short') AS title FROM customer")
def sca31_display_title(spark, sf_dir):
    """SCA-31: a title in the asked language, or the next that there is."""
    uz, ru, en = F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.when(F.col("c_mktsegment") < "F", F.col("c_mktsegment")), F.when(F.col("c_nationkey") > 5, F.concat(F.lit("nation "), "c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.display_title("ru", uz, ru, en, F.lit("short")).alias("title"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN ', part ' || l_linenumber ELSE '' END || CASE WHEN l_linestatus = 'F' THEN ', clause ' || l_suppkey ELSE '' END AS suffix FROM lineitem")
def sca34_citation_suffix(spark, sf_dir):
    """SCA-34: part and clause of a citation, where there are any."""
    part, clause = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("string")), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", legal.citation_suffix(part, clause).alias("suffix"))


@query("SELECT event_id, 'event_type=' || event_type || chr(10) || 'user_id=' || user_id AS line FROM events")
def sca35_check_string(spark, sf_dir):
    """SCA-35: sorted key=value lines of allowed keys."""
    fields = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("props"), F.col("props"), F.lit("event_type"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", layout.check_string(fields, ["event_type", "user_id", "hash"]).alias("line"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'ru' THEN 'russian' ELSE 'simple' END AS config FROM documents")
def sca55_map_default(spark, sf_dir):
    """SCA-55: a map with a default."""
    configs = F.create_map(F.lit("ru"), F.lit("russian"), F.lit("en"), F.lit("english"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(configs, F.col("lang")), F.lit("simple")).alias("config"))


@query("""
SELECT o_custkey, CAST(run AS BIGINT) AS nth, min(o_orderstatus) AS o_orderstatus, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS o_orderpriority FROM (
  SELECT *, sum(flag) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS flag FROM orders)) GROUP BY 1, 2
""")
def ing13_article_groups(spark, sf_dir):
    """ING-13, AGG-17: consecutive rows of one article joined in order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return layout.article_groups(o, "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query(r"""
SELECT lexeme, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS lexeme FROM documents) GROUP BY 1
""")
def ing18_vocabulary(spark, sf_dir):
    """ING-18: the lexemes of all texts with their frequencies."""
    posts = lexical.postings(table(spark, sf_dir, "documents"), {"text": 0.2}, "doc_id")
    return posts.groupBy("lexeme").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT o_orderkey, o_custkey, valid_from, valid_to IS NULL AS is_current FROM (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)")
def win15_timeline(spark, sf_dir):
    """WIN-15: versions in order, the last one current."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("valid_to", F.lead("o_orderdate").over(w))
    return o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), F.col("valid_to").isNull().alias("is_current"))


@query("""
WITH n AS (SELECT l_orderkey, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, l_quantity AS body FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_quantity) = 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity > 1.15 * m.body AS heading FROM lineitem l JOIN m USING (l_orderkey)
""")
def agg15_body_size(spark, sf_dir):
    """AGG-15, SRC-05 (its text rules): the body's type size by document, and what is larger."""
    rows_ = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", F.col("l_quantity").alias("size"))
    joined = rows_.join(layout.body_sizes(rows_), "doc_id")
    heading = layout.is_printed_heading(F.lit("small letters"), F.col("size"), F.col("body_size"))
    return joined.select(F.col("doc_id").alias("l_orderkey"), "l_linenumber", "l_partkey", heading.alias("heading"))
