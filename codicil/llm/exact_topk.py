"""Exhaustive inner-product search, one term of the queries after another over blocks of postings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ._common import cut


@dataclass(frozen=True)
class TopKConfig:
    k: int = 20
    #: Queries are the rows whose id this divides.
    every: int = 20
    #: Components become floor(scale * x).
    scale: int = 64
    #: Candidates and queries that meet in one group at most, about, and groups of candidates at least.
    candidates: int = 16_384
    queries: int = 4_096
    groups: int = 32
    #: Query rows whose dense score arrays are filled at a time.
    tile: int = 16


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    terms = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


def _matrix(column, width: int) -> np.ndarray:
    rows = [np.asarray(r.values.to_numpy(zero_copy_only=False)) for r in column]
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def term_at_a_time(query_ids, queries: np.ndarray, ids, matrix: np.ndarray, k: int, tile: int):
    """(query id, id, score) of the k best of this block for each query; ``ids`` ascend.

    The block's postings of a term are its non-zero weights; the non-zero weights of a tile of
    queries scatter them into dense score arrays.  A partition of each array finds the k-th
    score; ties at it go to the smaller ids.
    """
    n = len(ids)
    top = int(np.abs(matrix).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, matrix.shape[1])
    kind = np.int32 if top < 2**31 - 1 else np.int64
    lowest = np.iinfo(kind).min
    postings = []
    for t in range(matrix.shape[1]):
        rows = np.flatnonzero(matrix[:, t])
        postings.append((rows, matrix[rows, t].astype(kind), matrix[:, t].astype(kind) if 2 * len(rows) >= n else None))
    out = []
    for at in range(0, len(query_ids), tile):
        part = queries[at : at + tile].astype(kind)
        scores = np.zeros((len(part), n), dtype=kind)
        for t, (rows, weights, dense) in enumerate(postings):
            has = np.flatnonzero(part[:, t])
            if not len(has) or not len(rows):
                continue
            if dense is None:
                scores[np.ix_(has, rows)] += np.multiply.outer(part[has, t], weights)
            elif len(has) == len(part):
                scores += np.multiply.outer(part[:, t], dense)
            else:
                scores[has] += np.multiply.outer(part[has, t], dense)
        for i, q in enumerate(query_ids[at : at + tile]):
            row = scores[i]
            row[np.searchsorted(ids, q) : np.searchsorted(ids, q, side="right")] = lowest
            least = np.partition(row, n - k)[n - k] if n > k else lowest
            above = np.flatnonzero(row > least)
            ties = np.flatnonzero(row == least)[: max(0, k - len(above))] if least > lowest else above[:0]
            picked = np.concatenate([above, ties])
            out.append((np.full(len(picked), q), ids[picked], row[picked].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)]


def exact_topk(vectors: DataFrame, config: TopKConfig = TopKConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best of all other vectors.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id.  Rows that repeat an id are candidates and queries each; a query meets no row
    of its own id, and the rows of a query_id share its ``k`` places.  Missing trailing
    components of a shorter vector count as 0.  Scores are integer inner products; ties go to
    the smaller vec_id.  Queries and candidates are dealt by hash into groups, and each pair of
    groups is one task's grouped work, so memory depends on the group sizes only; the best k of
    each pair meet per query.
    """
    k, tile = config.k, config.tile
    rows = cut(quantised(vectors, config.scale))
    asked = rows.where(F.col("vec_id") % config.every == 0)
    n, m = rows.count(), asked.count()
    of_rows, of_queries = max(config.groups, -(-n // config.candidates)), max(1, -(-m // config.queries))
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(of_queries)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(of_rows - 1)).cast("array<long>")).alias("b"), "vec_id", "terms")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1)).cast("array<long>")).alias("a"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(of_rows)).alias("b"), "vec_id", "terms")

    def run(queries, candidates):
        import pyarrow as pa

        if not queries.num_rows or not candidates.num_rows:
            found = [np.zeros(0, dtype=np.int64)] * 3
        else:
            candidates = candidates.sort_by("vec_id")
            width = max(len(r) for t in (queries, candidates) for r in t.column("terms"))
            found = term_at_a_time(queries.column("vec_id").to_numpy(), _matrix(queries.column("terms"), width), candidates.column("vec_id").to_numpy(), _matrix(candidates.column("terms"), width), k, tile)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), found)})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
