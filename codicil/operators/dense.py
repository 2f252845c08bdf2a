"""Exact vector search for a table of questions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.transform(F.array(norm(a)), lambda v: F.when(v > 0, v).otherwise(1.0))[0]
    return F.transform(F.array(n), lambda v: F.transform(a, lambda x: x.cast("double") / v))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def similarity(a: Column, b: Column) -> Column:
    """max(0, 1 - cosine distance)."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 40, key: str = "chunk_id", block: int = 4096) -> DataFrame:
    """query_id, key, score, rank of each question's k nearest vectors by inner product of unit vectors.

    queries: query_id, query (array); vectors: key, embedding.  The questions are dealt into
    blocks of about ``block`` and every block meets every partition of the vectors once, as one
    matrix product; a task hands on k rows for each question, so what is shuffled does not grow
    with the vectors.  Questions of a block travel to all executors, which ``block`` bounds.
    With a ``mask`` in queries a question meets the vectors whose ``bit`` its mask has, before
    any cut.
    """
    n = queries.count()
    found = None
    for i in range(max(1, -(-n // block))):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))) == i)
        rows = _knn_block(part, vectors, k, key)
        rows = rows.withColumn("score", F.round("score", 9))
        found = rows if found is None else found.union(rows)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _knn_block(queries: DataFrame, vectors: DataFrame, k: int, key: str) -> DataFrame:
    import numpy as np

    masked = "mask" in queries.columns
    rows = queries.select("query_id", "query", *(["mask"] if masked else [])).collect()  # one block
    ids = np.array([r["query_id"] for r in rows])
    matrix = np.array([r["query"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    masks = np.array([r["mask"] for r in rows], dtype=np.int64) if masked else None
    sent = vectors.sparkSession.sparkContext.broadcast((matrix / np.where(lengths > 0, lengths, 1), masks))
    id_type, key_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        unit, masks = sent.value
        held = None

        def best(q, keys, scores):
            """The k best of each question, ties to the smaller key."""
            order = np.lexsort((np.unique(keys, return_inverse=True)[1], -scores, q))
            ordered = q[order]
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            order = order[nth < k]
            return q[order], keys[order], scores[order]

        for batch in batches:
            for lo in range(0, len(batch) if len(ids) else 0, 2048):
                part = batch.iloc[lo : lo + 2048]
                v = np.array(part["embedding"].tolist(), dtype=np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                # Rounded first, so that ties are ties.
                scores = np.round(np.maximum(0.0, unit @ (v / np.where(size > 0, size, 1)).T), 9)
                if masks is not None:
                    scores[(masks[:, None] & part["bit"].to_numpy()[None, :]) == 0] = -1.0
                m = min(k, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
                q, c = np.nonzero((scores >= least[:, None]) & (scores >= 0))
                new = best(q, part[key].to_numpy()[c], scores[q, c])
                held = new if held is None else best(*(np.concatenate(x) for x in zip(held, new)))
        if held is not None and len(held[0]):
            yield pd.DataFrame({"query_id": ids[held[0]], key: held[1], "score": held[2]})

    columns = [key, "embedding", *(["bit"] if masked else [])]
    return vectors.where("embedding is not null").select(*columns).mapInPandas(run, f"query_id {id_type}, {key} {key_type}, score double")


def knn_expression(queries: DataFrame, vectors: DataFrame, k: int = 40, key: str = "chunk_id", on: list[str] | None = None) -> DataFrame:
    """The same by SQL expressions within groups ``on`` (say, a user), for small groups."""
    pairs = queries.join(vectors, on)
    scored = pairs.select("query_id", key, *(on or []), F.round(similarity(F.col("query"), F.col("embedding")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
