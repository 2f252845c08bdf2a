"""Costly maps over stored rows: a cache of results with a time to live, and a rewrite that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..scratch import stored
from .buckets import BucketedTable


class CachedMap:
    """Values of a map of texts by the SHA-256 of the text, each good for ``ttl_s`` seconds."""

    def __init__(self, spark: SparkSession, path: str, value: str, ttl_s: int, buckets: int = 64):
        self.table = BucketedTable(spark, path, f"key string, value {value}, expires long", ["key"], buckets)
        self.ttl = ttl_s

    def apply(self, texts: DataFrame, function: Callable[[DataFrame], DataFrame], now_s: int) -> DataFrame:
        """texts (text, any more) with ``value``; ``function`` turns (key, text) into (key, value).

        It gets each distinct text once whose value the table lacks or holds no longer, and what
        it returns is written in one change.  Null texts have no value.
        """
        keyed = texts.withColumn("_key", F.sha2("text", 256))
        held = self.table.read().where(F.col("expires") > now_s).select(F.col("key").alias("_key"), "value")
        lacking = keyed.where("_key IS NOT NULL").join(held.select("_key"), "_key", "left_anti").groupBy(F.col("_key").alias("key")).agg(F.first("text").alias("text"))
        fresh = stored(function(stored(lacking, "lacking")).select("key", "value", F.lit(now_s + self.ttl).cast("long").alias("expires")), "fresh")
        known = stored(held, "held")
        self.table.merge(fresh, lambda current, staged: current.where(F.col("expires") > now_s).join(staged.select("key"), "key", "left_anti").unionByName(staged))
        every = known.unionByName(fresh.select(F.col("key").alias("_key"), "value"))
        return keyed.join(every, "_key", "left").drop("_key")


def rewrite(table: BucketedTable, needs: Column, function: Callable[[DataFrame], DataFrame], step: int = 8) -> int:
    """Replace the rows that ``needs`` names by ``function`` of them, ``step`` buckets in a change; returns the changes made.

    A rewrite that stops is taken up again where it was: what is done needs nothing any more.
    """
    made = 0
    for first in range(0, table.buckets, step):
        some = list(range(first, min(first + step, table.buckets)))
        rows = table.read(some)
        if rows.where(needs).isEmpty():
            continue
        keys = rows.where(needs).select(*table.keys).distinct()
        whole = lambda current, _: current.where(~F.coalesce(needs, F.lit(False))).unionByName(function(current.where(needs)).select(*current.columns))
        table.merge(keys, whole)
        made += 1
    return made
