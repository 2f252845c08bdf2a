"""Ranked lists: reciprocal rank fusion, pins, deduplication, thresholds, final order.

Every list is (query_id, chunk_id, ...) and ties are always settled by a column.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import bound


def rrf(branches: dict[str, tuple[DataFrame, float]], k: int = 20) -> DataFrame:
    """query_id, chunk_id, fused_score = sum of w / (k + rank), first_seen, and each branch's rank and score.

    branches: name to (query_id, chunk_id, rank, score) and weight.  One grouped aggregation;
    ``first_seen`` is the place in the lists one after another, which settles ties.
    """
    rows = reduce(DataFrame.unionByName, [df.select("query_id", "chunk_id", "rank", "score", F.lit(n).alias("branch"), F.lit(float(w)).alias("w"), F.lit(i).alias("nth")) for i, (n, (df, w)) in enumerate(branches.items())])
    best = [F.min(F.when(F.col("branch") == n, F.col("rank"))).alias(f"{n}_rank") for n in branches]
    best += [F.max(F.when(F.col("branch") == n, F.col("score"))).alias(f"{n}_score") for n in branches]
    seen = F.min(F.col("nth").cast("long") * 1_000_000 + F.col("rank")).alias("first_seen")
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))), 9).alias("fused_score"), seen, *best)


def positions(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def pinned(exact: DataFrame, rest: DataFrame) -> DataFrame:
    """Exact hits first with fused_score at least 1, then the rest without them; ``pos`` is the new order.

    Both: query_id, chunk_id, fused_score, pos.
    """
    first = exact.select("query_id", "chunk_id", F.greatest("fused_score", F.lit(1.0)).alias("fused_score"), "pos", F.lit(0).alias("block"))
    other = rest.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "fused_score", "pos", F.lit(1).alias("block"))
    return positions(first.unionByName(other), F.col("block"), F.col("pos"), F.col("chunk_id"), name="new").drop("pos", "block").withColumnRenamed("new", "pos")


def best_per_article(rows: DataFrame) -> DataFrame:
    """One chunk for each (act_id, article_number, language), the best fused; null numbers are one article.

    The article keeps the place of its first chunk.
    """
    article = Window.partitionBy("query_id", "act_id", "article_number", "language")
    rows = rows.withColumn("place", F.min("pos").over(article)).withColumn("nth", F.row_number().over(article.orderBy(F.col("fused_score").desc(), "pos")))
    rows = rows.where("nth = 1").drop("nth", "pos")
    return positions(rows, F.col("place"), F.col("chunk_id")).drop("place")


def relevant(rows: DataFrame, top_k: int = 12, least: float = 0.25, fallback: int = 3) -> DataFrame:
    """Rows of rerank_score >= least, or the first ``fallback`` if none is; unranked queries keep their first ``top_k``."""
    query = Window.partitionBy("query_id")
    passes = F.coalesce(F.col("rerank_score") >= least, F.lit(False))
    rows = rows.withColumn("scored", F.count("rerank_score").over(query)).withColumn("passing", F.count_if(passes).over(query))
    keep = F.when(F.col("scored") == 0, F.col("pos") <= top_k).when(F.col("passing") == 0, F.col("pos") <= fallback).otherwise(passes)
    return rows.where(keep).drop("scored", "passing")


def final_order(rows: DataFrame) -> DataFrame:
    """By score to three places, then legal force, then the place before."""
    return positions(rows, F.bround("score", 3).desc(), F.col("precedence").desc(), F.col("pos"), name="final_pos")


def same_term(a: Column, b: Column, least: int = 4) -> Column:
    """Equal, or at least ``least`` leading characters in common."""
    return (a == b) | ((F.length(a) >= least) & (F.length(b) >= least) & (F.substring(a, 1, least) == F.substring(b, 1, least)))


def coverage(of: Column, by: Column) -> Column:
    """Share of the words ``of`` that match one of ``by``, as by ``same_term``."""
    # Words match if their first four characters (all, if fewer) are equal, so it takes a set of those, not pairs.
    heads = lambda words: F.transform(words, lambda w: F.substring(w, 1, 4))

    def share(h: Column) -> Column:
        hit = bound(F.array_intersect(h["of"], h["by"]), lambda both: F.size(F.filter(h["of"], lambda w: F.array_contains(both, w))))
        return F.coalesce(hit, F.lit(0)) / F.when(F.size(h["of"]) > 0, F.size(h["of"]))

    return bound(F.struct(heads(of).alias("of"), heads(by).alias("by")), share)


def title_affinity(query: Column, title: Column) -> Column:
    """Harmonic mean of both coverages of word arrays; 0 without words or matches."""
    a, b = coverage(query, title), coverage(title, query)
    return F.coalesce(F.when((a > 0) & (b > 0), 2 * a * b / (a + b)), F.lit(0.0))


# Words of act names that tell nothing about which act it is.
ACT_NAME_NOISE = (
    "кодекс", "кодекса", "кодексе", "кодекси", "кодексининг", "республики", "республикаси", "республикасининг", "узбекистан", "ўзбекистон",
    "uzbekiston", "respublikasining", "kodeksi", "ответственности", "ответственность", "javobgarlik",
)


def act_affinity(query: Column, name: Column) -> Column:
    """Share of the act name's telling words that the question has."""
    noise = F.array(*[F.lit(w) for w in ACT_NAME_NOISE])
    own = F.filter(name, lambda t: ~F.array_contains(noise, t))
    return F.coalesce(coverage(own, query), F.lit(0.0))


def crossref_expand(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, languages: DataFrame, *, seeds_most: int = 5, limit: int = 6, confidence: float = 0.5, score: float = 0.3) -> DataFrame:
    """query_id, chunk_id, score, via, pos: provisions that the first seeds refer to, one for each article.

    seeds: query_id, chunk_id, act_id, article_number, pos, citation; edges: edge_id,
    source_act_id, source_article, target_act_id, target_article, confidence; languages:
    query_id, language, ord (the asked language first).  Seeds' own chunks are left out.
    """
    first = seeds.where(F.col("pos") <= seeds_most)
    good = edges.where(F.col("target_act_id").isNotNull() & F.col("target_article").isNotNull() & (F.col("confidence") >= confidence))
    hops = first.join(good, (F.col("act_id") == F.col("source_act_id")) & (F.col("article_number") == F.col("source_article")))
    hops = hops.groupBy("query_id", "target_act_id", "target_article").agg(F.min(F.struct("pos", "edge_id", "citation")).alias("by"))
    found = hops.join(chunks, (F.col("target_act_id") == chunks["act_id"]) & (F.col("target_article") == chunks["article_number"]))
    found = found.select("query_id", "target_act_id", "target_article", "by", "chunk_id", "language", "ordinal").join(languages, ["query_id", "language"])
    found = found.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    article = Window.partitionBy("query_id", "target_act_id", "target_article").orderBy("ord", "ordinal", "chunk_id")
    found = found.withColumn("nth", F.row_number().over(article)).where("nth = 1")
    found = positions(found, F.col("by.pos"), F.col("by.edge_id"), F.col("chunk_id")).where(F.col("pos") <= limit)
    return found.select("query_id", "chunk_id", F.lit(score).alias("score"), F.col("by.citation").alias("via"), "pos")
