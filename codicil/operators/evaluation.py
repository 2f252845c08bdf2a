"""Measuring retrieval, re-ranking in a slot, versions compared, caches of expensive maps."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def rank_of_gold(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, rank: the first hit whose article is accepted and whose law name holds an accepted act.

    gold: query_id, acts, articles (arrays); hits: query_id, pos, law_name, article_number.
    """
    pairs = gold.join(hits, "query_id", "left")
    fits = F.array_contains("articles", F.col("article_number")) & F.exists("acts", lambda a: F.contains(F.lower("law_name"), F.lower(a)))
    return pairs.groupBy("query_id").agg(F.min(F.when(fits, F.col("pos"))).alias("rank"))


def recall_mrr(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: n, recall at each k, mrr; a null rank is a miss."""
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in at]
    return ranks.agg(F.count("*").alias("n"), *hits, F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))


def lexical_scorer(questions: pd.Series, passages: pd.Series) -> pd.Series:
    """The share of a question's words that a passage has: what stands in for a trained pair scorer here."""

    def score(q, p):
        words = set((q or "").lower().split())
        return len(words & set((p or "").lower().split())) / len(words) if words else 0.0

    return pd.Series([score(q, p) for q, p in zip(questions, passages)], dtype="float64")


def reranked(rows: DataFrame, top_k: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] = lexical_scorer) -> DataFrame:
    """rows by the score of (question, passage) pairs, ``top_k`` for each question; a failing scorer keeps the order.

    rows: query_id, question, citation, heading, text, pos, any more.  The scorer sees batches.
    """

    @pandas_udf(T.DoubleType())
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        try:
            return scorer(question, passage)
        except Exception:  # a scorer that fails leaves its rows without a score
            return pd.Series([None] * len(question), dtype="float64")

    passage = F.concat_ws("\n", "citation", "heading", "text")
    rows = rows.withColumn("rerank_score", score(F.col("question"), passage))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top_k)


@pandas_udf(T.DoubleType())
def diff_ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """Similarity of two texts, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(old, new)], dtype="float64")


@pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The lines that changed, with two of context."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=2)) for a, b in zip(old, new)])


def mapped_once(texts: DataFrame, cache: DataFrame, function: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(texts with value, cache with what is new): an expensive map over distinct texts that a cache lacks.

    texts: id, text; cache: key, value, key the SHA-256 of the text; ``function`` turns (key, text)
    into (key, value).
    """
    keyed = texts.withColumn("key", F.sha2("text", 256))
    fresh = function(keyed.groupBy("key").agg(F.first("text").alias("text")).join(cache.select("key"), "key", "left_anti")).select("key", "value")
    grown = cache.select("key", "value").unionByName(fresh)
    return keyed.join(grown, "key", "left").drop("key"), grown


def degraded(branches: dict[str, Callable[[], DataFrame]], empty: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The plans of retrieval branches, and the reason of each that can't be built, which is then empty."""
    plans, reasons = {}, {}
    for name, build in branches.items():
        try:
            plans[name] = build()
        except Exception as e:
            plans[name], reasons[name] = empty, f"{type(e).__name__}: {str(e)[:200]}"
    return plans, reasons
