"""Text functions over documents and conversations."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import answers, legal, text, translit
from ..operators import citations, query_terms
from ..session import table
from ._register import query
from .retrieval import TERMS, cyrillic_sql, latin_sql, questions, synonyms


@query(f"SELECT doc_id, md5({cyrillic_sql('text')}) AS made FROM documents")
def sca03_latin_to_cyrillic(spark, sf_dir):
    """SCA-02, SCA-03: whole texts in Cyrillic letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(translit.latin_to_cyrillic(F.col("text"))).alias("made"))


@query(f"SELECT conv_id, turn, {latin_sql('c')} AS made FROM (SELECT conv_id, turn, {cyrillic_sql('text')} AS c FROM conversations)")
def sca04_cyrillic_to_latin(spark, sf_dir):
    """SCA-04: messages in Cyrillic letters, and back in Latin ones."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", translit.cyrillic_to_latin(translit.latin_to_cyrillic(F.col("text"))).alias("made"))


@query(f'''
WITH t AS (SELECT conv_id, turn, text, {cyrillic_sql("text")} AS c, {latin_sql("text")} AS l FROM conversations), v AS (SELECT *, [text, c, replace(c, 'тс', 'ц'), l] AS f FROM t)
SELECT conv_id, turn, list_filter(f, lambda x, i: x <> '' AND list_position(f, x) = i) AS variants FROM v
''')
def sca07_script_variants(spark, sf_dir):
    """SCA-07: the spellings of messages in both scripts."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", translit.script_variants(F.col("text")).alias("variants"))


@query(r"""
SELECT doc_id, CASE WHEN c + l = 0 THEN 'unknown' WHEN c * 1.0 / (c + l) > 0.8 THEN 'cyrl' WHEN c * 1.0 / (c + l) < 0.2 THEN 'latn' ELSE 'mixed' END AS script
FROM (SELECT doc_id, length(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)
""")
def sca05_script(spark, sf_dir):
    """SCA-05, SCA-06: script by the share of letters."""
    return table(spark, sf_dir, "documents").select("doc_id", translit.script_of(F.col("text")).alias("script"))


@query(
    r"""
WITH n AS (SELECT doc_id, translate(text, 'ʻʼ’''`´', '‘‘‘‘‘‘') AS x FROM documents), w AS (SELECT *, list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_‘ʼ'']+')) AS l FROM n),
s AS (SELECT *, len(list_intersect(l, string_split('@EN@', ' '))) AS en, len(list_intersect(l, string_split('@UZ@', ' '))) AS uz FROM w)
SELECT doc_id, CASE WHEN trim(x) = '' THEN 'uz-Latn' WHEN uz > en THEN 'uz-Latn' WHEN en > uz THEN 'en' ELSE 'uz-Latn' END AS lang FROM s
""".replace("@EN@", " ".join(text.MARKERS["en"])).replace("@UZ@", " ".join(text.MARKERS["uz"]))
)
def sca08_detect_language(spark, sf_dir):
    """SCA-08, SCA-01: the language of whole texts (all in Latin letters here)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("lang"))


@query(r"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_‘ʼ'']+')) AS w FROM documents)
SELECT doc_id, CAST(len(list_intersect(w, string_split('"""
    + " ".join(text.MARKERS["en"])
    + """', ' '))) AS BIGINT) AS en, CAST(len(list_intersect(w, string_split('"""
    + " ".join(text.MARKERS["uz"])
    + """', ' '))) AS BIGINT) AS uz FROM t
""")
def sca08_marker_counts(spark, sf_dir):
    """SCA-08: marker words of each language in a text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_‘ʼ']+"), F.lit(0)))
    n = lambda k: F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in text.MARKERS[k]]))).cast("long").alias(k)
    return table(spark, sf_dir, "documents").select("doc_id", n("en"), n("uz"))


@query(r"""
SELECT doc_id, CAST(greatest(1, floor(length(text) / 3.0)) AS BIGINT) AS plain, CAST(CASE WHEN length(text) = 0 THEN 1 ELSE floor(c / 1.7 + (length(text) - c) / 3.5) + 1 END AS BIGINT) AS blended
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) AS c FROM documents)
""")
def ing06_token_estimate(spark, sf_dir):
    """ING-06, ING-07: tokens of a text by its length."""
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("plain"), text.blended_tokens(F.col("text")).cast("long").alias("blended"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(translate(lower(text), 'ʻʼ‘’''´`', ''), '[\p{L}\p{N}_]{2,}') AS raw FROM conversations),
u AS (SELECT *, list_filter(raw, lambda x: NOT regexp_matches(x, '^\p{Nd}+$')) AS words FROM t),
v AS (SELECT *, list_filter(words, lambda x: NOT list_contains(string_split('"""
    + " ".join(text.FRAMING["en"]).replace("'", "''")
    + r"""', ' '), x)) AS kept FROM u)
SELECT conv_id, turn, CASE WHEN len(kept) > 0 THEN kept ELSE words END AS tokens FROM v
""")
def sca11_content_tokens(spark, sf_dir):
    """SCA-09, SCA-11, SCA-52: content words of a message."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_tokens(F.col("text"), "en").alias("tokens"))


@query(r"""
SELECT DISTINCT w AS token, CASE WHEN length(w) >= 6 THEN [w, substr(w, 1, greatest(4, length(w) - 3))] ELSE [w] END AS stems
FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents)
""")
def sca13_stem_variants(spark, sf_dir):
    """SCA-13: a word and its shortened form."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", text.stem_variants(F.col("token")).alias("stems"))


@query(f"WITH {TERMS} SELECT query_id, list_sort(list(DISTINCT term)) AS added FROM raw WHERE size > 0 GROUP BY query_id")
def sca14_expand_tokens(spark, sf_dir):
    """SCA-14, T-18: what a glossary adds to questions, by runs of their content words; sorted."""
    found = query_terms.additions(query_terms.contents(questions(spark, sf_dir)), synonyms(spark, sf_dir))
    return found.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("added"))


@query("""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN doc_id || '|' || (n_chars % 9 + 1) || '|' WHEN n_chars % 3 = 1 THEN doc_id || '|' || (n_chars % 9 + 1) || '|' || (n_chars % 5 + 1) ELSE doc_id || '||;' || (doc_id + 1) || '||' END AS found FROM documents
""")
def sca15_parse_references(spark, sf_dir):
    """SCA-15, UDF-02: article, part and clause of each provision that a question about a document names."""
    d = table(spark, sf_dir, "documents")
    n, part, clause = F.col("doc_id").cast("string"), (F.col("n_chars") % 9 + 1).cast("string"), (F.col("n_chars") % 5 + 1).cast("string")
    asked = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("qonun "), n, F.lit("-moddasi "), part, F.lit("-qismi"))).when(F.col("n_chars") % 3 == 1, F.concat(n, F.lit("-modda "), part, F.lit("-qism "), clause, F.lit("-band")))
    asked = F.coalesce(asked, F.concat(F.lit("ст. "), n, F.lit(" и статья "), (F.col("doc_id") + 1).cast("string")))
    form = lambda x: F.concat(x["article"], F.lit("|"), F.coalesce(x["part"], F.lit("")), F.lit("|"), F.coalesce(x["clause"], F.lit("")))
    return d.select("doc_id", F.array_join(F.transform(legal.parse_references(asked), form), ";").alias("found"))


@query(r"""
SELECT doc_id, CASE WHEN length(text) <= 260 THEN text ELSE rtrim(CASE WHEN cutat > 156 THEN substr(head, 1, cutat) ELSE head END) || '…' END AS excerpt
FROM (SELECT doc_id, text, substr(text, 1, 260) AS head, CASE WHEN contains(substr(text, 1, 260), ' ') THEN 260 - instr(reverse(substr(text, 1, 260)), ' ') ELSE 0 END AS cutat FROM documents)
""")
def sca17_excerpt(spark, sf_dir):
    """SCA-17: a cut at a blank with an ellipsis."""
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[#*`_>]+', '', 'g'), '\s+', ' ', 'g')), 1, 350) AS summary FROM documents")
def sca18_answer_summary(spark, sf_dir):
    """SCA-18: plain text, cut."""
    return table(spark, sf_dir, "documents").select("doc_id", text.answer_summary(F.col("text")).alias("summary"))


@query(r"""
SELECT conv_id, turn, list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(?:the|with|code|data|model|please)\b'))), 1, 20) AS topics FROM conversations
""")
def sca19_topics(spark, sf_dir):
    """SCA-19: distinct keywords, sorted, twenty at most."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("\\b(?:the|with|code|data|model|please)\\b"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.sort_array(F.array_distinct(found)), 1, 20).alias("topics"))


@query(r"""
WITH m AS (SELECT conv_id, turn, split_part(text, '.', 1) AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(trim(said), '\S+')) > 6 OR trim(said) = '' THEN 'legal' WHEN regexp_matches(lower(trim(said)), '^(hi|hello|hey|good\s*(morning|afternoon|evening))[\s!.,?…]*$') THEN 'greeting'
  WHEN regexp_matches(lower(trim(said)), '^((hi|hello|hey)[\s,!.-]*)?(thanks?|thank\s*you|ok(ay)?|zo{0,2}r)[\s!.,?…]*$') THEN 'smalltalk' ELSE 'legal' END AS intent FROM m
""")
def sca21_intent(spark, sf_dir):
    """SCA-21: the first sentences of messages."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.classify_intent(F.split_part("text", F.lit("."), F.lit(1))).alias("intent"))


@query(r"""
SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(trim(text), '\S+')) > 6 OR trim(text) = '' THEN 'legal' WHEN regexp_matches(lower(trim(text)), '^(hi|hello|hey|good\s*(morning|afternoon|evening))[\s!.,?…]*$') THEN 'greeting'
  WHEN regexp_matches(lower(trim(text)), '^((hi|hello|hey)[\s,!.-]*)?(thanks?|thank\s*you|ok(ay)?|zo{0,2}r)[\s!.,?…]*$') THEN 'smalltalk' ELSE 'legal' END AS intent FROM conversations
""")
def sca21_intent_route(spark, sf_dir):
    """SCA-21: messages of conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.classify_intent(F.col("text")).alias("intent"))


def re2(pattern: str) -> str:
    """A pattern for regexp_matches: word characters of all scripts, and edges of words spelled out."""
    word = "[\\p{L}\\p{N}_]"
    pattern = pattern.replace("\\w", word).replace("'", "''")
    pattern = re.sub(r"\\b(?=\w|\(|\[)", lambda _: f"(?:^|[^{word[1:-1]}])", pattern)
    return "(?is)" + pattern.replace("\\b", f"(?:$|[^{word[1:-1]}])")


def matches_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{re2(pattern)}')"


_LEGAL = " OR ".join([matches_sql("said", p) for _, p in legal.ACT_HINTS] + [matches_sql("said", f"\\b(?:{answers.LEGAL})(?:$|[^\\p{{L}}\\p{{N}}_])")])


@query(f"""
WITH m AS (SELECT doc_id, text || CASE lang WHEN 'en' THEN ' what the law says' WHEN 'de' THEN ' Какая погода' WHEN 'fr' THEN ' mehnat kodeksi va futbol' ELSE '' END AS said FROM documents)
SELECT doc_id, {_LEGAL} AS legal, {matches_sql("said", answers.EVERYDAY)} AS everyday FROM m
""")
def sca22_scope(spark, sf_dir):
    """SCA-22, RET-23: two judgements that are not each other's negation, over whole texts."""
    more = F.when(F.col("lang") == "en", " what the law says").when(F.col("lang") == "de", " Какая погода").when(F.col("lang") == "fr", " mehnat kodeksi va futbol").otherwise("")
    said = F.concat("text", more)
    return table(spark, sf_dir, "documents").select("doc_id", answers.looks_legal(said).alias("legal"), answers.looks_non_legal(said).alias("everyday"))


@query(f"""
WITH m AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' Please make it shorter' WHEN role = 'user' THEN ' explain more' ELSE '' END AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN {matches_sql("said", f"\\b(?:{answers.DETAILED})(?:$|[^\\p{{L}}\\p{{N}}_])")} THEN 'detailed' WHEN {matches_sql("said", f"\\b(?:{answers.BRIEF})(?:$|[^\\p{{L}}\\p{{N}}_])")} THEN 'brief' END AS directive, false AS bare FROM m
""")
def sca23_verbosity(spark, sf_dir):
    """SCA-23: requests for a length behind messages, and whether there is anything else."""
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Please make it shorter").when(F.col("role") == "user", " explain more").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.detect_directive(said).alias("directive"), F.coalesce(answers.is_bare_directive(said), F.lit(False)).alias("bare"))


@query(r"""
SELECT l.doc_id, CASE WHEN quality = 1 THEN 'low' WHEN toxic = 1 THEN 'high' ELSE 'medium' END AS level, md5(text || chr(10) || '**Risk level:** HIGH — ' || source) AS rewritten FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def sca24_stated_risk(spark, sf_dir):
    """SCA-24: the level that an answer states, read and replaced; answers are documents with a stated level."""
    level = F.expr("CASE WHEN quality = 1 THEN 'LOW' WHEN toxic = 1 THEN 'high' ELSE 'Medium' END")
    answer = F.concat("text", F.lit("\n**Risk level:** "), level, F.lit(" — "), "source")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.select("doc_id", answers.stated_risk(answer).alias("level"), F.md5(answers.rewrite_stated_risk(answer, F.lit("high"))).alias("rewritten"))


@query("SELECT conv_id, string_agg(replace(left(text, 40), chr(10), ' ') || '?', '|' ORDER BY turn) AS found FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def sca25_follow_ups(spark, sf_dir):
    """SCA-25: up to three of the questions that stand behind an answer; here a conversation's first five messages."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 5")
    asked = F.concat(F.col("n").cast("string"), F.lit(". "), F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")), F.lit("?"))
    lines = F.sort_array(F.collect_list(F.struct("n", asked.alias("line"))))
    answer = F.concat(F.lit("An answer.\n---FOLLOW-UP---\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    return c.groupBy("conv_id").agg(answer.alias("answer")).select("conv_id", F.array_join(answers.follow_ups(F.col("answer")), "|").alias("found"))


_SUBJECTS = "(?is)" + "|".join(p for _, p in answers.HIGH_RISK).replace("'", "''")
_HEDGES = "(?is)" + answers.HEDGING.replace("'", "''")


@query(f"""
SELECT l.doc_id, CASE WHEN quality = 0 AND toxic = 1 OR regexp_matches(text, '{_SUBJECTS}') THEN 'high' WHEN quality = 0 OR regexp_matches(text, '{_HEDGES}') THEN 'medium' ELSE 'low' END AS level
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def ret29_risk_levels(spark, sf_dir):
    """RET-29, AGG-12, SCA-55: the highest of all factors."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    bad = F.col("quality") == 0
    given = j.select("doc_id", F.lit("").alias("question"), F.col("text").alias("answer"), F.lit(3).alias("n_chunks"), F.when(bad, 1).otherwise(3).alias("n_primary"), F.lit(1.0).alias("best_score"), F.lit(False).alias("constitutional"), (bad & (F.col("toxic") == 1)).alias("only_non_binding"), F.lit(0).alias("n_conflicts"), F.lit(False).alias("truncated"))
    return citations.risk(given).select("doc_id", "level")


_FLAGS = [(code, p) for code, p in answers.RED_FLAGS if "(?!" not in p]
_FLAGGED = ", ".join(f"CASE WHEN {matches_sql('contract', p)} THEN '{code}' END" for code, p in _FLAGS)
_COVERED = " + ".join(f"CAST({matches_sql('contract', p)} AS INTEGER)" for _, p in answers.TOPICS)


@query(f"""
WITH c AS (SELECT doc_id, text || CASE lang WHEN 'en' THEN ' The party waives all rights. It shall automatically renew.' WHEN 'de' THEN ' A fine for the employee: unlimited liability' WHEN 'fr' THEN ' Price and payment term.' ELSE '' END AS contract FROM documents)
SELECT doc_id, array_to_string(list_filter([{_FLAGGED}], lambda x: x IS NOT NULL), '|') AS flags, CAST(CASE WHEN {_COVERED} = 0 THEN 5 ELSE {_COVERED} END AS INTEGER) AS topics FROM c
""")
def ret30_clause_flags(spark, sf_dir):
    """RET-30: clauses that call for a look, and topics covered, in texts with clauses of their language behind them."""
    more = F.when(F.col("lang") == "en", " The party waives all rights. It shall automatically renew.").when(F.col("lang") == "de", " A fine for the employee: unlimited liability").when(F.col("lang") == "fr", " Price and payment term.").otherwise("")
    contract = F.concat("text", more)
    c = table(spark, sf_dir, "documents").select("doc_id", answers.red_flags(contract).alias("f"), answers.contract_topics(contract).alias("t"))
    return c.select("doc_id", F.array_join(F.transform("f", lambda f: f["code"]), "|").alias("flags"), F.size("t").alias("topics"))


@query(r"""
WITH a AS (SELECT conv_id, turn, text, 'S' || turn AS tag, conv_id % 90 + 10 AS article FROM conversations),
b AS (SELECT *, turn IN (1, 2) AS known, trim(regexp_replace(text || CASE WHEN turn IN (1, 2) THEN ' [' || tag || ']' ELSE ' ' END || ' modda ' || article, '[ \t]{2,}', ' ', 'g')) AS clean FROM a)
SELECT conv_id, turn, CASE WHEN known THEN tag ELSE '' END AS used, CASE WHEN known THEN '' ELSE tag END AS invalid, NOT known AND length(clean) > 400 AS rejected FROM b
""")
def ret27_citation_validation(spark, sf_dir):
    """RET-27, SET-04, SET-06: tags used, unknown tags and rejected answers; answers are messages that cite a tag."""
    c = table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.lit(" [S"), F.col("turn").cast("string"), F.lit("] modda "), (F.col("conv_id") % 90 + 10).cast("string"))
    a = c.select("conv_id", "turn", answer.alias("answer"), F.array(F.lit("S1"), F.lit("S2")).alias("tags"), F.array(F.lit("12")).alias("articles"), F.array(F.lit("Civil code")).alias("laws"))
    j = lambda c: F.array_join(c, "|")
    return citations.validated(a).select("conv_id", "turn", j("used_tags").alias("used"), j("invalid_tags").alias("invalid"), "rejected")


@query("""
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p + bonus DESC, effective DESC, chunk_id) AS pos, row_number() OVER (PARTITION BY query_id ORDER BY p + bonus DESC, effective DESC, chunk_id) = 1 AS controlling FROM (
  SELECT o_custkey AS query_id, o_orderkey AS chunk_id, CAST(o_orderdate AS DATE) AS effective, [100, 80, 70, 60, 10][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS p, [0, 2, 0, 0, 0][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS bonus FROM orders) WHERE p > 10
""")
def ret28_legal_force(spark, sf_dir):
    """RET-28, SRT-07, SRT-08: binding provisions by force, date and score."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("constitution", "code", "law", "presidential_decree", "commentary")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), kind.alias("act_type"), F.to_date("o_orderdate").alias("last_updated"), F.lit(None).cast("date").alias("date_of_adoption"), F.lit(0.0).alias("score"), F.col("o_orderkey").alias("pos"))
    return citations.legal_order(o).select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"), "controlling")


@query()
def ret26_context(spark, sf_dir):
    """RET-26, WIN-06, UDF-06: provisions put together within a budget of tokens."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in legal.PRECEDENCE]), (F.col("doc_id") % 11 + 1).cast("int"))
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    r = d.select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit(", "), F.col("doc_id")).alias("citation"), F.lit(None).cast("string").alias("heading"), "text", kind.alias("act_type"), legal.precedence(kind).alias("precedence"), F.when(F.col("doc_id") % 5 == 0, "S1").alias("via"))
    return citations.build_context(r.withColumn("pos", F.row_number().over(w)))
