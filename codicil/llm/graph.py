"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ._common import cut, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge, the component named by its smallest id.

    The stars halve path lengths, so the rounds grow with the logarithm of the graph's
    diameter; every round ends in the shared folder, and the files of the one before it go.  A
    centre with very many edges is a skewed key of plain inner joins, which adaptive execution
    splits, and of minima, which are taken before the shuffle.
    """
    edges = edges.where(F.col(a) != F.col(b))
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        large = both.join(least, both.u == least.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        nearest = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"))
        small = large.join(nearest, large.u == nearest.c).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(nearest.select("c", "m"))
        done, now = now, cut(small.where("u != v").distinct())
        drop(done, least, large, nearest)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = cut(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots))
    drop(now)
    return found
