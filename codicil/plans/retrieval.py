"""Retrieval queries over documents (chunks), embeddings and benchmark (questions)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..config import DEFAULT as C
from ..functions.legal import PRECEDENCE
from ..functions import translit
from ..functions.text import FRAMING, TOKEN_MARKS, WORD, tokens
from ..operators import dense, fusion, hybrid, inverted, lexical, query_terms
from ..scratch import folder, stored
from ..session import table
from ._register import query

ACT_TYPES = list(PRECEDENCE)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: an act is a source and a language, an article a remainder of the id."""
    act_type = F.element_at(F.array(*[F.lit(t) for t in ACT_TYPES]), (F.pmod(F.col("doc_id"), F.lit(len(ACT_TYPES))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("act_id"),
        F.col("source").alias("law_name"),
        F.pmod(F.col("doc_id"), F.lit(40)).cast("string").alias("article_number"),
        F.col("lang").alias("language"),
        act_type.alias("act_type"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("heading"),
        "text",
        F.col("doc_id").alias("ordinal"),
    )


CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_id, source AS act_id, source AS law_name, CAST(doc_id % 40 AS VARCHAR) AS article_number, lang AS language,
    {ACT_TYPES}[doc_id % {len(ACT_TYPES)} + 1] AS act_type, split_part(text, chr(10), 1) AS heading, text, doc_id AS ordinal
  FROM documents
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, language: benchmark items, every other one taken as Uzbek, so that scripts and stems count."""
    language = F.when(F.col("item_id") % 2 == 0, "en").otherwise("uz-Latn")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", language.alias("language"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary made from the items: the first two words of each and its last one mean the same."""
    words = tokens(F.col("text"))
    both = F.array(F.array_join(F.slice(words, 1, 2), " "), F.element_at(words, -1))
    rows = table(spark, sf_dir, "benchmark").where(F.size(words) > 1).select(F.col("item_id").alias("group"), F.explode(both).alias("term"), F.lit(False).alias("english"))
    return query_terms.synonym_table(rows)


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The single terms and the phrases of each question, sixty terms at most."""
    found = stored(query_terms.query_terms(questions(spark, sf_dir), synonyms(spark, sf_dir)), "terms")
    return query_terms.single(found).distinct(), query_terms.phrases(found)


def _replacements(sql: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


def cyrillic_sql(column: str) -> str:
    """Latin letters to Cyrillic, as ``translit.latin_to_cyrillic``."""
    folded = f"translate({column}, '{translit.APOSTROPHES.replace(chr(39), chr(39) * 2)}', '{translit.FOLDED * len(translit.APOSTROPHES)}')"
    for letter, initial in (("e", "э"), ("E", "Э")):
        folded = f"regexp_replace({folded}, '(^|[^\\p{{L}}\\p{{N}}_]){letter}', '\\1{initial}', 'g')"
    return _replacements(folded, translit._cased(translit.LATIN_TO_CYRILLIC))


def latin_sql(column: str) -> str:
    """Cyrillic letters to Latin, as ``translit.cyrillic_to_latin``."""
    for letter, initial in (("е", "ye"), ("Е", "Ye")):
        column = f"regexp_replace({column}, '(^|[^\\p{{L}}\\p{{N}}_]){letter}', '\\1{initial}', 'g')"
    return _replacements(column, translit._cased(translit.CYRILLIC_TO_LATIN))


_MARKS = TOKEN_MARKS.replace("'", "''")
_FRAMING = {k: "string_split('" + " ".join(FRAMING[k]).replace("'", "''") + "', ' ')" for k in ("en", "uz")}

TERMS = f"""asked AS (
  SELECT item_id AS query_id, text, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'uz-Latn' END AS language FROM benchmark
), cyrillic AS (
  SELECT *, {cyrillic_sql("text")} AS c FROM asked
), variants AS (
  SELECT *, CASE WHEN language = 'en' THEN [text] WHEN replace(c, 'тс', 'ц') <> c THEN [text, c, replace(c, 'тс', 'ц')] WHEN c <> text THEN [text, c] ELSE [text] END AS v FROM cyrillic
), spelled AS (
  SELECT query_id, language, unnest(v) AS spelling, unnest(range(0, len(v))) AS variant FROM variants
), worded AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(spelling, '[\\p{{L}}\\p{{N}}_{_MARKS}]{{2,}}'), lambda x: translate(lower(x), '{_MARKS}', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^\\p{{Nd}}+$')) AS w FROM spelled
), kept AS (
  SELECT *, list_filter(w, lambda x: NOT list_contains(CASE WHEN language = 'en' THEN {_FRAMING["en"]} ELSE {_FRAMING["uz"]} END, x)) AS k FROM worded
), contents AS (
  SELECT query_id, language, variant, CASE WHEN len(k) > 0 THEN k ELSE w END AS content FROM kept
), pairs_of AS (
  SELECT item_id AS g, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM benchmark
), glossed AS (
  SELECT g, unnest([w[1] || ' ' || w[2], w[-1]]) AS term FROM pairs_of WHERE len(w) > 1
), members AS (
  SELECT DISTINCT g, unnest([translate(lower(term), '{_MARKS}', ''), translate(lower({cyrillic_sql("term")}), '{_MARKS}', '')]) AS form FROM glossed
), synonyms AS (
  SELECT DISTINCT a.form AS phrase, b.form AS synonym FROM members a JOIN members b USING (g) WHERE a.form <> b.form
), runs AS (
  SELECT query_id, language, variant, content, 1 AS size, unnest(range(0, len(content))) AS start FROM contents
  UNION ALL SELECT query_id, language, variant, content, 2, unnest(range(0, len(content) - 1)) FROM contents
), raw AS (
  SELECT query_id, language, variant, 0 AS size, unnest(range(0, len(content))) AS start, unnest(content) AS term FROM contents
  UNION ALL SELECT query_id, language, variant, size, start, synonym FROM runs JOIN synonyms ON phrase = array_to_string(content[start + 1 : start + size], ' ') WHERE NOT list_contains(content, synonym)
), formed AS (
  SELECT *, CASE WHEN language = 'en' OR length(term) < 6 THEN [term] ELSE [term, substr(term, 1, greatest(4, length(term) - 3))] END AS f FROM raw
), ordered AS (
  SELECT query_id, form, row_number() OVER (PARTITION BY query_id ORDER BY variant, size, start, term, nth) AS n FROM (
    SELECT query_id, variant, size, start, term, unnest(f) AS form, unnest(range(0, len(f))) AS nth FROM formed)
), qterms AS (
  SELECT query_id, list_filter(string_split(form, ' '), lambda x: x <> '') AS words, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS ix FROM (
    SELECT query_id, form, min(n) AS n FROM ordered WHERE form <> '' GROUP BY 1, 2)
  QUALIFY ix < 60
), terms AS (
  SELECT DISTINCT query_id, words[1] AS term FROM qterms WHERE len(words) = 1
), phrases AS (
  SELECT query_id, ix, words[1] AS a, words[2] AS b FROM qterms WHERE len(words) = 2
)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: a vector for each benchmark item, that of the same number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


DENSE = """dense AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT b.item_id AS query_id, c.vec_id AS chunk_id,
      round(greatest(0.0, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
        / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])))), 9) AS score
    FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id CROSS JOIN embeddings c)
  QUALIFY rank <= 40
)"""

POSTS = r"""posts AS (
  SELECT chunk_id, field, weight, pos, words[pos] AS lexeme FROM (
    SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM (
      SELECT chunk_id, 'law_name' AS field, 1.0 AS weight, regexp_extract_all(lower(law_name), '[\p{L}\p{N}_]{2,}') AS words FROM chunks
      UNION ALL SELECT chunk_id, 'heading', 0.4, regexp_extract_all(lower(heading), '[\p{L}\p{N}_]{2,}') FROM chunks
      UNION ALL SELECT chunk_id, 'text', 0.2, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') FROM chunks))
)"""

SPARSE = """expanded AS (
  SELECT DISTINCT query_id, lexeme FROM terms JOIN (SELECT DISTINCT lexeme FROM posts) v ON starts_with(lexeme, term)
), begun AS (
  SELECT query_id, x.chunk_id, x.field, x.pos FROM phrases JOIN posts x ON x.lexeme = a JOIN posts y ON y.chunk_id = x.chunk_id AND y.field = x.field AND y.pos = x.pos + 1 AND starts_with(y.lexeme, b)
), places AS (
  SELECT query_id, chunk_id, field, pos FROM posts JOIN expanded USING (lexeme)
  UNION SELECT query_id, chunk_id, field, pos FROM begun UNION SELECT query_id, chunk_id, field, pos + 1 FROM begun
), matched AS (
  SELECT query_id, p.chunk_id, x.weight FROM places p JOIN posts x ON x.chunk_id = p.chunk_id AND x.field = p.field AND x.pos = p.pos
), sparse AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(w / (w + 1), 9) AS score FROM (
      SELECT query_id, chunk_id, round(sum(weight::DOUBLE), 9) AS w FROM matched JOIN allowed USING (query_id, chunk_id) GROUP BY ALL))
  QUALIFY rank <= 40
)"""

TITLE = r"""tposts AS (
  SELECT chunk_id, pos, words[pos] AS lexeme, len(words) AS n FROM (
    SELECT chunk_id, words, unnest(range(1, len(words) + 1)) AS pos FROM (
      SELECT chunk_id, regexp_extract_all(lower(heading), '[\p{L}\p{N}_]{2,}') AS words FROM chunks WHERE heading IS NOT NULL))
), texpanded AS (
  SELECT DISTINCT query_id, lexeme FROM terms JOIN (SELECT DISTINCT lexeme FROM tposts) v ON starts_with(lexeme, term)
), tbegun AS (
  SELECT DISTINCT query_id, x.chunk_id, x.pos FROM phrases JOIN tposts x ON x.lexeme = a JOIN tposts y ON y.chunk_id = x.chunk_id AND y.pos = x.pos + 1 AND starts_with(y.lexeme, b)
), tplaces AS (
  SELECT query_id, chunk_id, pos FROM tposts JOIN texpanded USING (lexeme) UNION SELECT query_id, chunk_id, pos FROM tbegun UNION SELECT query_id, chunk_id, pos + 1 FROM tbegun
), title AS (
  SELECT query_id, chunk_id, phrase_hit, score, row_number() OVER (PARTITION BY query_id ORDER BY phrase_hit DESC, score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM tbegun) AS phrase_hit, round(round(count(*) * 0.1, 9) / n, 9) AS score
    FROM tplaces JOIN (SELECT DISTINCT chunk_id, n FROM tposts) USING (chunk_id) JOIN allowed USING (query_id, chunk_id) GROUP BY query_id, chunk_id, n)
  QUALIFY rank <= 40
)"""

#: Every chunk is allowed; ``FILTERED`` has the filters of the whole course.
ALLOWED = "allowed AS (SELECT query_id, chunk_id FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) CROSS JOIN chunks)"


@query(f"WITH {DENSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense")
def ret01_dense_topk(spark, sf_dir):
    """RET-01, RET-02, SRT-01, WIN-01, WIN-03: exact vector search for all questions."""
    return dense.knn(query_vectors(spark, sf_dir), vectors(spark, sf_dir), C.top_k_dense).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""
WITH pairs AS (
  SELECT q.vec_id AS query_id, d.lang, c.vec_id AS chunk_id,
    round(greatest(0.0, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
      / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])))), 9) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN documents d ON q.vec_id = d.doc_id JOIN (SELECT vec_id, embedding, lang FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang IN ('de', 'fr', 'es') AND source <> 'src0') c ON c.lang = d.lang)
SELECT query_id, lang, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 10
""")
def ret03_dense_filtered(spark, sf_dir):
    """RET-03, FLT-01, JOIN-01, JOIN-07: search within a language, filters before the ranking."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    rows = e.join(d.select("doc_id", "lang", "source"), e.vec_id == d.doc_id)
    asked = rows.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "lang")
    kept = rows.where("lang IN ('de', 'fr', 'es') AND source <> 'src0'").select(F.col("vec_id").alias("chunk_id"), "embedding", "lang")
    found = dense.knn_expression(asked, kept, 10, on=["lang"])
    return found.select("query_id", "lang", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHUNKS}, {ALLOWED}, {TERMS}, {POSTS}, {SPARSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sparse")
def ret05_lexical_or_prefix(spark, sf_dir):
    """RET-05, RET-09, JOIN-09, SRT-02, SCA-14: OR of prefixes and phrases (spellings, synonyms, stems) over weighted fields."""
    words, phrases = asked(spark, sf_dir)
    found = lexical.sparse_branch(chunks(spark, sf_dir), words, C.top_k_sparse, phrases=phrases)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {POSTS} SELECT lexeme, count(DISTINCT chunk_id) AS chunks, max(weight) AS top FROM (SELECT lexeme, chunk_id, round(sum(weight::DOUBLE), 9) AS weight FROM posts GROUP BY ALL) GROUP BY lexeme")
def ing18_stored_index(spark, sf_dir):
    """ING-18: the words of a stored inverted index with their chunks and largest weights."""
    path = folder(spark, "index")
    inverted.build(chunks(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/lexemes")


@query(f"WITH {CHUNKS}, {ALLOWED}, {TERMS}, phrases AS (SELECT 0 AS query_id, '' AS a, '' AS b WHERE false), {POSTS}, {SPARSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sparse".replace("phrases AS (\n  SELECT query_id, ix", "both_words AS (\n  SELECT query_id, ix"))
def ret05_stored_index(spark, sf_dir):
    """RET-05, ING-18: the OR of prefixes answered from the stored index, which is built once; no text is read for the questions."""
    path = folder(spark, "index")
    inverted.build(chunks(spark, sf_dir), path)
    found = inverted.search(spark, path, asked(spark, sf_dir)[0], C.top_k_sparse)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {ALLOWED}, {TERMS}, {TITLE} SELECT query_id, chunk_id, phrase_hit, rank, round(score, 6) AS score FROM title")
def ret06_title_branch(spark, sf_dir):
    """RET-06, RET-10, RET-11, SRT-03: headings only, phrases first."""
    words, phrases = asked(spark, sf_dir)
    found = lexical.title_branch(chunks(spark, sf_dir), words, phrases)
    return found.select("query_id", "chunk_id", "phrase_hit", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def exact(spark, sf_dir):
    numbers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.pmod(F.col("item_id"), F.lit(40)).cast("string").alias("article_number"))
    return lexical.exact_branch(chunks(spark, sf_dir).where("language = 'en'"), numbers, C.exact_limit)


EXACT = """exact AS (
  SELECT item_id AS query_id, chunk_id, 1.0 AS score, row_number() OVER (PARTITION BY item_id ORDER BY ordinal, chunk_id) AS rank
  FROM benchmark JOIN chunks ON article_number = CAST(item_id % 40 AS VARCHAR) WHERE language = 'en'
  QUALIFY rank <= 12
)"""


@query(f"WITH {CHUNKS}, {EXACT} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, rank FROM exact")
def ret07_exact_article(spark, sf_dir):
    """RET-07, RET-25, SRT-04: chunks of the articles that a question names."""
    return exact(spark, sf_dir).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def fused(spark, sf_dir):
    every = chunks(spark, sf_dir)
    words, phrases = asked(spark, sf_dir)
    return fusion.rrf(
        {
            "dense": (dense.knn(query_vectors(spark, sf_dir), vectors(spark, sf_dir), C.top_k_dense), 1.0),
            "sparse": (lexical.sparse_branch(every, words, C.top_k_sparse, phrases=phrases), 1.0),
            "title": (lexical.title_branch(every, words, phrases), C.heading_weight),
        },
        C.rrf_k,
    )


LISTS = """lists AS (
  SELECT query_id, chunk_id, rank, score, 0 AS nth, 1.0 AS w FROM dense
  UNION ALL SELECT query_id, chunk_id, rank, score, 1, 1.0 FROM sparse
  UNION ALL SELECT query_id, chunk_id, rank, score, 2, 2.5 FROM title
), fused AS (
  SELECT query_id, chunk_id, round(sum(w::DOUBLE / (20 + rank)), 9) AS fused_score, min(nth * 1000000 + rank) AS first_seen,
    min(CASE WHEN nth = 0 THEN rank END) AS dense_rank, min(CASE WHEN nth = 1 THEN rank END) AS sparse_rank, min(CASE WHEN nth = 2 THEN rank END) AS title_rank
  FROM lists GROUP BY query_id, chunk_id
)"""
FUSED = f"{CHUNKS}, {ALLOWED}, {TERMS}, {POSTS}, {SPARSE}, {TITLE}, {DENSE}, {LISTS}"


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(fused_score, 6) AS fused_score, CAST(first_seen AS BIGINT) AS first_seen, dense_rank, sparse_rank, title_rank FROM fused")
def ret12_rrf_fusion(spark, sf_dir):
    """RET-12, AGG-07, JOIN-04, SET-01, SRT-06, SCA-46: weighted reciprocal rank fusion of three lists."""
    rank = lambda b: F.col(f"{b}_rank").cast("long").alias(f"{b}_rank")
    return fused(spark, sf_dir).select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"), "first_seen", rank("dense"), rank("sparse"), rank("title"))


def pinned(spark, sf_dir):
    rest = fusion.positions(fused(spark, sf_dir).select("query_id", "chunk_id", "fused_score", "first_seen"), F.col("fused_score").desc(), F.col("first_seen"), F.col("chunk_id"))
    first = exact(spark, sf_dir).select("query_id", "chunk_id", F.lit(0.0).alias("fused_score"), F.col("rank").alias("pos"))
    return fusion.pinned(first, rest)


PIN = """rest AS (
  SELECT query_id, chunk_id, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, first_seen, chunk_id) AS pos FROM fused
), pinned AS (
  SELECT query_id, chunk_id, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY block, pos, chunk_id) AS pos FROM (
    SELECT query_id, chunk_id, 1.0::DOUBLE AS fused_score, rank AS pos, 0 AS block FROM exact
    UNION ALL SELECT query_id, chunk_id, fused_score, pos, 1 FROM rest r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = r.query_id AND e.chunk_id = r.chunk_id))
)"""
PINNED = f"{FUSED}, {EXACT}, {PIN}"


@query(f"WITH {PINNED} SELECT query_id, chunk_id, round(fused_score, 6) AS fused_score, pos FROM pinned")
def ret13_pin_then_rest(spark, sf_dir):
    """RET-13, SET-02, SET-03, JOIN-05: exact hits first, the rest without them."""
    return pinned(spark, sf_dir).select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"), F.col("pos").cast("long").alias("pos"))


def deduplicated(spark, sf_dir):
    meta = chunks(spark, sf_dir).select("chunk_id", "act_id", "article_number", "language", "act_type", "heading", "law_name")
    return fusion.best_per_article(pinned(spark, sf_dir).join(meta, "chunk_id"))


DEDUP = """dedup AS (
  SELECT query_id, chunk_id, act_id, article_number, language, act_type, heading, law_name, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS pos FROM (
    SELECT p.*, c.act_id, c.article_number, c.language, c.act_type, c.heading, c.law_name,
      min(pos) OVER (PARTITION BY query_id, act_id, article_number, language) AS place,
      row_number() OVER (PARTITION BY query_id, act_id, article_number, language ORDER BY fused_score DESC, pos) AS nth
    FROM pinned p JOIN chunks c USING (chunk_id)) WHERE nth = 1
)"""
DEDUPED = f"{PINNED}, {DEDUP}"


@query(f"WITH {DEDUPED} SELECT query_id, chunk_id, act_id, article_number, language, pos FROM dedup WHERE pos <= 12")
def ret14_dedupe_by_article(spark, sf_dir):
    """RET-14, WIN-02, SRT-10: the best chunk of each article, twelve for each question."""
    return deduplicated(spark, sf_dir).where("pos <= 12").select("query_id", "chunk_id", "act_id", "article_number", "language", F.col("pos").cast("long").alias("pos"))


@query("""
WITH scored AS (
  SELECT doc_id % 20 AS query_id, doc_id AS chunk_id, CASE WHEN doc_id % 20 IN (3, 7) THEN NULL WHEN doc_id % 20 IN (5, 11) THEN 0.01 ELSE quality * (doc_id % 10) / 10.0 END AS rerank_score,
    row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS pos FROM labels
), counted AS (
  SELECT *, count(rerank_score) OVER (PARTITION BY query_id) AS scored, count(*) FILTER (rerank_score >= 0.25) OVER (PARTITION BY query_id) AS passing FROM scored
)
SELECT query_id, chunk_id, CAST(rerank_score AS DOUBLE) AS rerank_score, pos FROM counted
WHERE CASE WHEN scored = 0 THEN pos <= 12 WHEN passing = 0 THEN pos <= 3 ELSE coalesce(rerank_score >= 0.25, false) END
""")
def ret16_threshold_fallback(spark, sf_dir):
    """RET-16, FLT-06: a relevance threshold with a fallback."""
    score = F.expr("CASE WHEN doc_id % 20 IN (3, 7) THEN NULL WHEN doc_id % 20 IN (5, 11) THEN 0.01D ELSE quality * (doc_id % 10) / 10.0D END")
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("chunk_id"), score.alias("rerank_score"))
    rows = fusion.positions(rows, F.col("chunk_id"))
    return fusion.relevant(rows).select("query_id", "chunk_id", "rerank_score", F.col("pos").cast("long").alias("pos"))


def sparse_ranked(spark, sf_dir):
    """query_id, chunk_id, score, rank of the sparse branch."""
    words, phrases = asked(spark, sf_dir)
    return lexical.sparse_branch(chunks(spark, sf_dir), words, C.top_k_sparse, phrases=phrases)


def sparse_candidates(spark, sf_dir):
    return sparse_ranked(spark, sf_dir).select("query_id", "chunk_id")


def _words_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query(rf"""
WITH {CHUNKS}, {ALLOWED}, {TERMS}, {POSTS}, {SPARSE}, pairs AS (
  SELECT b.item_id AS query_id, c.chunk_id, {_words_sql("b.text")} AS q, {_words_sql("c.heading")} AS t
  FROM sparse s JOIN benchmark b ON b.item_id = s.query_id JOIN chunks c ON c.chunk_id = s.chunk_id
), counted AS (
  SELECT *, len(list_filter(q, lambda a: len(list_filter(t, lambda b: a = b OR (length(a) >= 4 AND length(b) >= 4 AND substr(a, 1, 4) = substr(b, 1, 4)))) > 0)) / nullif(len(q), 0) AS a,
    len(list_filter(t, lambda b: len(list_filter(q, lambda a: a = b OR (length(a) >= 4 AND length(b) >= 4 AND substr(a, 1, 4) = substr(b, 1, 4)))) > 0)) / nullif(len(t), 0) AS b FROM pairs
)
SELECT query_id, chunk_id, round(coalesce(CASE WHEN a > 0 AND b > 0 THEN 2 * a * b / (a + b) END, 0), 6) AS affinity FROM counted
""")
def ret17_title_affinity(spark, sf_dir):
    """RET-17, JOIN-10, SCA-47: harmonic mean of both coverages under a common prefix of four, for each question's sparse candidates."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD + "{2,}"), F.lit(0))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("q"))
    c = chunks(spark, sf_dir).select("chunk_id", words(F.col("heading")).alias("t"))
    pairs = sparse_candidates(spark, sf_dir).join(b, "query_id").join(c, "chunk_id")
    return pairs.select("query_id", "chunk_id", F.round(fusion.title_affinity(F.col("q"), F.col("t")), 6).alias("affinity"))


EDGES = """edges AS (
  SELECT doc_id AS edge_id, source AS source_act_id, CAST(doc_id % 40 AS VARCHAR) AS source_article, 'src' || ((doc_id * 7 + 3) % 20) AS target_act_id,
    CAST((doc_id * 7 + 3) % 40 AS VARCHAR) AS target_article, CASE WHEN doc_id % 5 = 0 THEN 0.4 ELSE 0.8 END AS confidence FROM documents
)"""


def edges(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("edge_id"),
        F.col("source").alias("source_act_id"),
        (F.col("doc_id") % 40).cast("string").alias("source_article"),
        F.concat(F.lit("src"), (F.col("doc_id") * 7 + 3) % 20).alias("target_act_id"),
        ((F.col("doc_id") * 7 + 3) % 40).cast("string").alias("target_article"),
        F.when(F.col("doc_id") % 5 == 0, 0.4).otherwise(0.8).alias("confidence"),
    )


def languages(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    order = F.array_distinct(F.concat(F.array(F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.pmod(F.col("query_id"), F.lit(4)) + 1).cast("int"))), F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])))
    return asked.select("query_id", F.posexplode(order).alias("ord", "language"))


LANGUAGES = """langs AS (
  SELECT query_id, unnest(l) AS language, unnest(range(0, 4)) AS ord FROM (
    SELECT item_id AS query_id, list_concat([['en', 'fr', 'de', 'es'][item_id % 4 + 1]], list_filter(['en', 'fr', 'de', 'es'], lambda x: x <> ['en', 'fr', 'de', 'es'][item_id % 4 + 1])) AS l FROM benchmark)
)"""

CROSSED = f"""{EDGES}, {LANGUAGES}, seeds AS (SELECT * FROM dedup WHERE pos <= 12), hops AS (
  SELECT query_id, target_act_id, target_article, min({{'pos': pos, 'edge': edge_id, 'cit': law_name || ', ' || article_number || '-modda'}}) AS hop
  FROM seeds JOIN edges ON act_id = source_act_id AND article_number = source_article WHERE pos <= 5 AND confidence >= 0.5 GROUP BY ALL
), found AS (
  SELECT h.query_id, h.hop, c.chunk_id, row_number() OVER (PARTITION BY h.query_id, target_act_id, target_article ORDER BY ord, ordinal, c.chunk_id) AS nth
  FROM hops h JOIN chunks c ON c.act_id = target_act_id AND c.article_number = target_article JOIN langs l ON l.query_id = h.query_id AND l.language = c.language
  WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h.query_id AND s.chunk_id = c.chunk_id)
), crossed AS (
  SELECT query_id, chunk_id, hop.cit AS via, row_number() OVER (PARTITION BY query_id ORDER BY hop.pos, hop.edge, chunk_id) AS pos FROM found WHERE nth = 1 QUALIFY pos <= 6
)"""


def crossed(spark, sf_dir, seeds):
    cited = seeds.withColumn("citation", F.concat("law_name", F.lit(", "), "article_number", F.lit("-modda")))
    return fusion.crossref_expand(cited, edges(spark, sf_dir), chunks(spark, sf_dir).select("chunk_id", "act_id", "article_number", "language", "ordinal"), languages(spark, sf_dir))


@query(f"WITH {DEDUPED}, {CROSSED} SELECT query_id, chunk_id, CAST(0.3 AS DOUBLE) AS score, via, pos FROM crossed")
def ret19_crossref_expand(spark, sf_dir):
    """RET-19, JOIN-06, WIN-04: one hop along the references of the first five."""
    seeds = deduplicated(spark, sf_dir).where("pos <= 12")
    return crossed(spark, sf_dir, seeds).select("query_id", "chunk_id", "score", "via", F.col("pos").cast("long").alias("pos"))


@query("""
WITH rows AS (
  SELECT o_custkey AS query_id, o_orderkey AS chunk_id, round(o_totalprice / 500000, 3) AS score, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 10 AS precedence,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders
)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, precedence DESC, pos) AS final_pos FROM rows
""")
def ret20_final_order(spark, sf_dir):
    """RET-20, SRT-05, SCA-48: score to three places, legal force, the place before."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") / 500000).alias("score"), (F.substring("o_orderpriority", 1, 1).cast("int") * 10).alias("precedence"))
    return fusion.final_order(fusion.positions(rows, F.col("chunk_id"))).select("query_id", "chunk_id", F.col("final_pos").cast("long").alias("final_pos"))


STATUSES = ("in_force", "amended", "repealed", "in_force", "in_force", "draft", "amended")
LAW_NAME = "CASE WHEN doc_id % 3 = 0 THEN source || ' ' || split_part(text, ' ', 1) ELSE source END"

#: The tables of the whole course: chunks in force, and what each question asks for.
COURSE = CHUNKS.replace("source AS law_name", f"{LAW_NAME} AS law_name").replace("FROM documents", f"FROM documents WHERE {list(STATUSES)}[doc_id % {len(STATUSES)} + 1] IN ('in_force', 'amended')")
FILTERED = f"""wanted AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN [{{types}}[item_id % {len(ACT_TYPES)} + 1], {{types}}[(item_id + 3) % {len(ACT_TYPES)} + 1]] END AS act_types FROM benchmark
), allowed AS (
  SELECT query_id, chunk_id FROM wanted JOIN chunks ON act_types IS NULL OR list_contains(act_types, act_type)
)""".replace("{types}", str(ACT_TYPES))
_COURSE_DENSE = DENSE.replace("FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id CROSS JOIN embeddings c)", "FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id JOIN allowed a ON a.query_id = b.item_id JOIN embeddings c ON c.vec_id = a.chunk_id)")
_COURSE_EXACT = EXACT.replace("FROM benchmark JOIN chunks ON article_number = CAST(item_id % 40 AS VARCHAR) WHERE language = 'en'", "FROM benchmark JOIN chunks ON article_number = CAST(item_id % 40 AS VARCHAR) JOIN allowed a ON a.query_id = item_id AND a.chunk_id = chunks.chunk_id").replace("SELECT item_id AS query_id, chunk_id,", "SELECT item_id AS query_id, chunks.chunk_id,").replace("ORDER BY ordinal, chunk_id)", "ORDER BY ordinal, chunks.chunk_id)")
_ALIKE = "(x = y OR (length(x) >= 4 AND length(y) >= 4 AND substr(x, 1, 4) = substr(y, 1, 4)))"

COURSE_SQL = f"""
WITH {COURSE}, {FILTERED}, {TERMS}, {POSTS}, {SPARSE}, {TITLE}, {_COURSE_DENSE}, {LISTS}, {_COURSE_EXACT}, {PIN}, {DEDUP}, {LANGUAGES}, {EDGES}, passages AS (
  SELECT d.*, c.text AS body, b.text AS question FROM dedup d JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = d.query_id WHERE d.pos <= 12
), scored AS (
  SELECT *, list_distinct(regexp_extract_all(lower(question), '[^ \\t\\n\\x0b\\f\\r]+')) AS q,
    regexp_extract_all(lower(concat_ws(chr(10), law_name || ', ' || article_number, heading, body)), '[^ \\t\\n\\x0b\\f\\r]+') AS p FROM passages
), judged AS (
  SELECT *, len(list_intersect(q, p)) / len(q) AS rerank FROM scored
), reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, pos) AS place, count(*) FILTER (rerank >= 0.25) OVER (PARTITION BY query_id) AS passing FROM judged
), shown AS (
  SELECT * FROM reranked WHERE CASE WHEN passing = 0 THEN place <= 3 ELSE rerank >= 0.25 END
), worded_titles AS (
  SELECT *, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS qw, regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tw, regexp_extract_all(lower(law_name), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS lw FROM shown
), covered AS (
  SELECT *, len(list_filter(qw, lambda x: len(list_filter(tw, lambda y: {_ALIKE})) > 0)) / nullif(len(qw), 0) AS a, len(list_filter(tw, lambda x: len(list_filter(qw, lambda y: {_ALIKE})) > 0)) / nullif(len(tw), 0) AS b,
    coalesce(len(list_filter(lw, lambda x: len(list_filter(qw, lambda y: {_ALIKE})) > 0)) / nullif(len(lw), 0), 0) AS act FROM worded_titles
), lifted AS (
  SELECT *, round(fused_score + 0.15 * coalesce(CASE WHEN a > 0 AND b > 0 THEN 2 * a * b / (a + b) END, 0) + 0.10 * act, 9) AS lifted_score,
    row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, place) AS nth FROM covered
), again AS (
  SELECT query_id, chunk_id, fused, judged_score, row_number() OVER (PARTITION BY query_id ORDER BY block, nth, chunk_id) AS pos FROM (
    SELECT e.query_id, e.chunk_id, greatest(coalesce(l.lifted_score, 1.0), 1.0) AS fused, CASE WHEN l.rerank IS NOT NULL THEN greatest(l.rerank, 0.99) END AS judged_score, 0 AS block, e.rank AS nth
    FROM exact e LEFT JOIN lifted l ON l.query_id = e.query_id AND l.chunk_id = e.chunk_id
    UNION ALL SELECT query_id, chunk_id, lifted_score, rerank, 1, nth FROM lifted l WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = l.query_id AND e.chunk_id = l.chunk_id))
), seeds AS (
  SELECT a.*, coalesce(judged_score, fused) AS score, c.act_id, c.article_number, c.law_name, {[PRECEDENCE[t] for t in ACT_TYPES]}[list_position({ACT_TYPES}, c.act_type)] AS force FROM again a JOIN chunks c USING (chunk_id)
), hops AS (
  SELECT query_id, target_act_id, target_article, min({{'pos': pos, 'edge': edge_id, 'cit': law_name || ', ' || article_number || '-modda'}}) AS hop
  FROM seeds JOIN edges ON act_id = source_act_id AND article_number = source_article WHERE pos <= 5 AND confidence >= 0.5 GROUP BY ALL
), reached AS (
  SELECT h.query_id, h.hop, c.chunk_id, row_number() OVER (PARTITION BY h.query_id, target_act_id, target_article ORDER BY ord, ordinal, c.chunk_id) AS nth
  FROM hops h JOIN chunks c ON c.act_id = target_act_id AND c.article_number = target_article JOIN langs l ON l.query_id = h.query_id AND l.language = c.language
  WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h.query_id AND s.chunk_id = c.chunk_id)
), crossed AS (
  SELECT query_id, chunk_id, hop.cit AS via, row_number() OVER (PARTITION BY query_id ORDER BY hop.pos, hop.edge, chunk_id) AS pos FROM reached WHERE nth = 1 QUALIFY pos <= 6
), final AS (
  SELECT query_id, chunk_id, 0 AS block, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 3) DESC, force DESC, pos) AS place, score, fused AS fused_score, judged_score AS rerank_score, NULL AS via FROM seeds WHERE pos <= 12
  UNION ALL SELECT query_id, chunk_id, 1, pos, 0.3, NULL, NULL, via FROM crossed
)
SELECT query_id, chunk_id, round(score, 6) AS score, round(fused_score, 6) AS fused_score, round(rerank_score, 6) AS rerank_score, via, row_number() OVER (PARTITION BY query_id ORDER BY block, place) AS rank FROM final
"""


def course(spark, sf_dir) -> tuple[hybrid.Questions, hybrid.Corpus]:
    """What the whole course reads: acts in force, questions with and without named kinds of acts."""
    status = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (F.pmod(F.col("chunk_id"), F.lit(len(STATUSES))) + 1).cast("int"))
    law = F.when(F.col("chunk_id") % 3 == 0, F.concat_ws(" ", "act_id", F.split_part("text", F.lit(" "), F.lit(1)))).otherwise(F.col("act_id"))
    rows = lexical.admitted(chunks(spark, sf_dir).withColumn("status", status).withColumn("law_name", law), in_force_only=True)
    rows = rows.withColumn("title_terms", tokens(F.col("heading"))).withColumn("act_terms", tokens(F.col("law_name")))
    item, kinds = F.col("query_id"), F.array(*[F.lit(t) for t in ACT_TYPES])
    kind = lambda n: F.element_at(kinds, (F.pmod(item + n, F.lit(len(ACT_TYPES))) + 1).cast("int"))
    named = F.when(item % 3 == 0, F.array(kind(0), kind(3)))
    q = questions(spark, sf_dir).select("query_id", "text", tokens(F.col("text")).alias("terms"), named.alias("act_types"))
    words, phrases = asked(spark, sf_dir)
    numbers = q.select("query_id", F.pmod(item, F.lit(40)).cast("string").alias("article_number"))
    return hybrid.Questions(q, words, phrases, query_vectors(spark, sf_dir), numbers, languages(spark, sf_dir)), hybrid.Corpus(rows, vectors(spark, sf_dir), edges(spark, sf_dir))


@query(COURSE_SQL)
def ret21_hybrid_retrieval(spark, sf_dir):
    """RET-21, RET-15, RET-16, RET-17, RET-18, FLT-01, FLT-06: the whole course from filters to references."""
    found = hybrid.retrieve(*course(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("fused_score", 6).alias("fused_score"), F.round("rerank_score", 6).alias("rerank_score"), "via", F.col("rank").cast("long").alias("rank"))


RANKS = f"""{DEDUPED}, gold AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS act, item_id % 40 AS a, (item_id + 20) % 40 AS b FROM benchmark
), ranks AS (
  SELECT g.query_id, min(pos) AS rank FROM gold g LEFT JOIN dedup d ON d.query_id = g.query_id AND contains(lower(d.law_name), lower(g.act)) AND CAST(d.article_number AS INTEGER) IN (g.a, g.b) GROUP BY g.query_id
)"""


def gold_ranks(spark, sf_dir):
    """query_id, rank of the first hit whose law name holds the gold act and whose article is accepted; null if none."""
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("act"), F.array((F.col("item_id") % 40).cast("string"), ((F.col("item_id") + 20) % 40).cast("string")).alias("accepted"))
    hits = deduplicated(spark, sf_dir).select("query_id", "law_name", "article_number", "pos")
    found = gold.join(hits, "query_id", "left")
    fits = F.contains(F.lower("law_name"), F.lower("act")) & F.array_contains("accepted", F.col("article_number"))
    return found.groupBy("query_id").agg(F.min(F.when(fits, F.col("pos"))).cast("long").alias("rank"))


@query(f"WITH {RANKS} SELECT query_id, rank FROM ranks")
def ret32_rank_of_gold(spark, sf_dir):
    """RET-32, JOIN-16, FLT-10: where the accepted article stands."""
    return gold_ranks(spark, sf_dir)


@query(f"""
WITH {RANKS} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ranks
""")
def agg08_recall_mrr(spark, sf_dir):
    """AGG-08: recall at k and mean reciprocal rank."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return gold_ranks(spark, sf_dir).agg(F.count("*").alias("n"), *[hit(k) for k in (1, 3, 5, 10)], F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
