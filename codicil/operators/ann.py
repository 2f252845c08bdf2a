"""Approximate vector search by inverted lists: probed partitions, exact scores within them.

Centroids come from k-means over a sample of documented size; every vector is stored under its
nearest centroid, and a question reads the lists of its nearest centroids only.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .dense import _knn_block

#: Vectors that the centroids are fitted on at most.
SAMPLE = 20_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size > 0, size, 1)


def k_means(points: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit points by inner product; an empty one moves to the point that is worst off."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        scores = points @ centroids.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        empty = np.bincount(nearest, minlength=len(centroids)) == 0
        sums[empty] = points[np.argsort(scores.max(axis=1))[: int(empty.sum())]]
        centroids = _unit(sums)
    return centroids


def build(vectors: DataFrame, path: str, lists: int = 64, key: str = "chunk_id", seed: int = 0) -> None:
    """Write all vectors (key, embedding, any more) to ``path`` by list, and the centroids.

    The centroids are fitted on at most SAMPLE vectors, those of smallest hash of the key.
    """
    spark = vectors.sparkSession
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), key)).limit(SAMPLE).select("embedding").collect()
    if not some:
        raise ValueError("no vectors")
    centroids = k_means(_unit(np.array([r["embedding"] for r in some], dtype=np.float64)), lists, seed=seed)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    sent = spark.sparkContext.broadcast(centroids)

    def nearest(batches):
        for batch in batches:
            if len(batch):
                v = np.array(batch["embedding"].tolist(), dtype=np.float64)
                yield batch.assign(list=(v @ sent.value.T).argmax(axis=1).astype(np.int32))

    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", list int"
    assigned = vectors.where("embedding IS NOT NULL").mapInPandas(nearest, schema)
    # A list with most of the vectors is several files.
    assigned.repartition(F.col("list"), F.pmod(F.xxhash64(key), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 40, probes: int = 8, key: str = "chunk_id", block: int = 4096) -> DataFrame:
    """query_id, key, score, rank of the k nearest vectors in each question's ``probes`` nearest lists.

    queries: query_id, query.  Questions of one block stand near each other, so a block reads
    few lists; only those partitions are scanned.  Scores are exact.
    """
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    matrix = np.array([c["centroid"] for c in centroids])
    n = max(1, -(-queries.count() // block))
    sent = spark.sparkContext.broadcast(matrix)

    def probed(batches):
        for batch in batches:
            if len(batch):
                scores = _unit(np.array(batch["query"].tolist(), dtype=np.float64)) @ sent.value.T
                order = np.argsort(-scores, axis=1, kind="stable")[:, : min(probes, scores.shape[1])]
                yield batch.assign(first=order[:, 0].astype(np.int32), lists=[o.tolist() for o in order])

    kinds = ", ".join(f"`{c}` {t}" for c, t in queries.select("query_id", "query").dtypes)
    placed = queries.select("query_id", "query").mapInPandas(probed, f"{kinds}, first int, lists array<int>")
    # As many questions a block as ``block``, near ones together.
    placed = placed.withColumn("block", F.ntile(n).over(Window.orderBy("first", "query_id")) if n > 1 else F.lit(1))
    vectors = spark.read.parquet(f"{path}/lists")
    found = None
    for i in range(1, n + 1):
        part = placed.where(F.col("block") == i)
        wanted = sorted({x for r in part.select("lists").distinct().collect() for x in r["lists"]})  # numbers of lists
        rows = vectors.where(F.col("list").isin(wanted))
        # 63 bits at a time say which lists a question reads.
        for lo in range(0, len(wanted), 63):
            some = wanted[lo : lo + 63]
            bit, mask = F.lit(0).cast("long"), F.lit(0).cast("long")
            for j, x in enumerate(some):
                one = F.shiftleft(F.lit(1).cast("long"), j)
                bit = F.when(F.col("list") == x, one).otherwise(bit)
                mask = mask.bitwiseOR(F.when(F.array_contains("lists", x), one).otherwise(F.lit(0).cast("long")))
            got = _knn_block(part.select("query_id", "query", mask.alias("mask")), rows.where(F.col("list").isin(some)).withColumn("bit", bit), k, key)
            found = got if found is None else found.union(got)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
