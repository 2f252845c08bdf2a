"""One query for each operator of this subpackage, over its whole table, and the SQL for it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ._common import read
from .cutting_stock import CuttingStockConfig, packed_pieces
from .exact_topk import TopKConfig, exact_topk
from .line_dedup import line_deduplicated
from .minhash_dedup import MinHashConfig, near_duplicates
from .mixing import MixConfig, mixed
from .quality_classifier import PerplexityConfig, quality_scores
from .quality_rules import BASE, POLICIES, judged, ledger
from .substring_dedup import PassageConfig, repeated_passages
from .token_packing import TokenPackingConfig, packed_tokens
from .prefix_trie import TrieConfig, coded_turns, prefix_trie, rebuilt
from .spelling import SpellingConfig, spelling_variants
from .url_filter import UrlFilterConfig, url_verdicts
from .vector_packing import VectorPackingConfig, vector_packed


def tokenizer_path() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(read(spark, sf_dir, "documents"), TokenPackingConfig(tokenizer=tokenizer_path(), markers=True))


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_scores(docs, trusted_documents(spark, sf_dir), PerplexityConfig()).drop("ref")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"), MixConfig(partial=True)).select("doc_id", "size", "source_size", "target", "taken", "copies", "words_more")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(ledger(read(spark, sf_dir, "documents")), POLICIES[-1])
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"), PassageConfig())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, UrlFilterConfig(rules=URL_RULES)).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), MinHashConfig(width=2))


def op9_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"), CuttingStockConfig(tokenizer=tokenizer_path(), markers=True))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), TopKConfig(k=20, every=20))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(coded_turns(read(spark, sf_dir, "conversations"))), TrieConfig())


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return vector_packed(read(spark, sf_dir, "documents"), VectorPackingConfig(tokenizer=public_tokenizers.path("word_bpe_49k.json")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), SpellingConfig())


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS three
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM counted, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id
), judged AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * word_chars < 5 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_exclamations > 3 * n_words THEN 128 ELSE 0 END) AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM judged
"""

OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, i, [l[i], l[i + 1], l[i + 2]] AS three
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines)
  WHERE regexp_matches(concat(l[i], l[i + 1], l[i + 2]), '[^\x20\x09-\x0D]')
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM later, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM lines t LEFT JOIN covered c ON t.doc_id = c.doc_id
"""

OP10_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.terms, c.terms) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP11_SQL = """
WITH entries AS (
  SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
  FROM (SELECT unnest(range(0, 256)) AS i)
), crc AS (
  SELECT list(e ORDER BY i) AS t FROM entries
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS size FROM turns GROUP BY conv_id
), plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM sizes, crc
), firsts AS (
  SELECT p.*, least(h, coalesce(size, 0)) AS lent FROM plan p LEFT JOIN sizes s ON s.conv_id = base
), rebuilt AS (
  SELECT f.conv_id, pos, role, text FROM firsts f JOIN turns t ON t.conv_id = base AND pos < h
  UNION ALL SELECT f.conv_id, pos - h + lent, role, text FROM firsts f JOIN turns t ON t.conv_id = f.conv_id AND pos >= h
), sequences AS (
  SELECT f.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s FROM firsts f LEFT JOIN rebuilt r ON r.conv_id = f.conv_id GROUP BY f.conv_id
), prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends, CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM sequences)
), nodes AS (
  SELECT p, d, min(conv_id) AS m, count(*) AS n, any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefixes GROUP BY p, d
), placed AS (
  SELECT x.conv_id, x.d, m FROM prefixes x JOIN nodes v ON v.d = x.d AND v.p = x.p
), linked AS (
  SELECT v.m, v.d, v.n, v.bytes, v.ids, a.m AS parent FROM nodes v LEFT JOIN placed a ON a.conv_id = v.m AND a.d = v.d - 1
), children AS (
  SELECT parent AS m, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.m = l.m AND c.d = l.d
), sums AS (
  SELECT a.m, a.d, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.bytes) AS saved FROM counted v JOIN placed a ON a.conv_id = v.m AND a.d <= v.d GROUP BY a.m, a.d
)
SELECT c.m AS conv_id, c.d AS depth, c.parent AS parent_conv_id, c.n AS n_convs, c.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(c.ids) AS ends_sha256
FROM counted c JOIN sums s ON s.m = c.m AND s.d = c.d
"""

OP13_SQL = r"""
WITH RECURSIVE entries AS (
  SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
  FROM (SELECT unnest(range(0, 256)) AS i)
), crc AS (
  SELECT list(e ORDER BY i) AS t FROM entries
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc
), typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), shorter AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest
), ranked AS (
  SELECT x.word, other, o.n AS other_n, count(*) OVER (PARTITION BY x.word) AS n_near, row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, other) AS nth FROM near x JOIN words o ON o.word = other
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND nth = 1
), walked AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT w.word, f.form, step + 1 FROM walked w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
), ended AS (
  SELECT word, arg_max(root, step) AS root FROM walked GROUP BY word
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ended e ON e.word = f.word
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_packing, op2_quality_classifier, op3_source_mixing, op4_quality_rules, op5_substring_dedup, op6_line_dedup, op7_url_filter, op8_minhash_near_dedup, op9_cutting_stock_packing, op10_exact_topk, op11_prefix_trie, op12_vector_packing, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op6_line_dedup": OP6_SQL, "op10_exact_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
