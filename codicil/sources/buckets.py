"""Tables in hash buckets, of which a change rewrites only the buckets that it touches.

A table is a folder.  ``data/change=n/bucket=b`` holds what change n wrote, and is never written
again once the change is committed; ``heads/n`` says which change holds each bucket after change
n.  A head counts once Spark has marked it as written, and the one before stays until then, so a
driver that dies in a change leaves the state before it, and the change runs again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

HEAD = "bucket int, change long, stream string, batch long"


class BucketedTable:
    """Rows of ``schema`` by ``keys``, in ``buckets`` parts (a number that stays the same for the life of the table)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def changes(self) -> list[int]:
        """Numbers of the committed changes whose heads are there, in order."""
        fs, path = self._fs(f"{self.path}/heads")
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _head(self, change: int | None = None) -> tuple[int, dict[int, int], dict[str, int]]:
        """(change, change that holds each bucket, last batch of each stream); at most ``buckets`` rows."""
        numbers = self.changes()
        if not numbers:
            return 0, {}, {}
        at = numbers[-1] if change is None else change
        rows = self.spark.read.schema(HEAD).parquet(f"{self.path}/heads/{at:012d}").collect()
        return at, {r["bucket"]: r["change"] for r in rows if r["stream"] is None}, {r["stream"]: r["batch"] for r in rows if r["stream"] is not None}

    def read(self, some: list[int] | None = None, change: int | None = None) -> DataFrame:
        """The rows, or those of some buckets, now or after a change; only the files of those buckets are read."""
        _, held, _ = self._head(change)
        paths = [f"{self.path}/data/change={n:012d}/bucket={b}" for b, n in sorted(held.items()) if some is None or b in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, staged: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stream: tuple[str, int] | None = None) -> list[int]:
        """Replace the touched buckets by ``combine(their rows, staged)`` and return their numbers.

        ``staged`` holds the keys.  ``stream`` (name, batch) names the batch of a stream: one that
        is committed already changes nothing.  Memory of the driver: one number for each bucket.
        """
        last, held, streams = self._head()
        if stream is not None and streams.get(stream[0], -1) >= stream[1]:
            return []
        touched = sorted(r[0] for r in staged.select(self.bucket().alias("b")).distinct().collect())
        if not touched and stream is None:
            return []
        number = last + 1
        if touched:
            at = f"{self.path}/data/change={number:012d}"
            rows = combine(self.read(touched), staged).select(*[f.name for f in self.schema.fields])
            # One file a bucket; a change that died half way is written over.
            rows.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            fs, path = self._fs(at)
            full = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}
            held = {b: n for b, n in held.items() if b not in touched} | {b: number for b in touched if b in full}
        if stream is not None:
            streams[stream[0]] = stream[1]
        head = [(b, n, None, None) for b, n in held.items()] + [(None, None, s, n) for s, n in streams.items()]
        self.spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/{number:012d}")
        return touched

    def replace(self, staged: DataFrame, slices: list[str], gone: DataFrame | None = None) -> list[int]:
        """Put ``staged`` in the place of the slices (of columns among the keys) that it or ``gone`` has."""
        named = staged.select(*slices) if gone is None else staged.select(*slices).union(gone.select(*slices))
        named = named.distinct()

        def combine(current: DataFrame, _: DataFrame) -> DataFrame:
            return current.join(named, slices, "left_anti").unionByName(staged.select(*current.columns))

        return self.merge(named, combine)

    def vacuum(self, keep: int = 2) -> int:
        """Delete heads but the last ``keep`` and the data that none of those holds; returns the number of folders."""
        numbers = self.changes()
        kept = numbers[-keep:]
        used = {(b, n) for k in kept for b, n in self._head(k)[1].items()}
        deleted = 0
        for n in [n for n in numbers if n not in kept]:
            fs, path = self._fs(f"{self.path}/heads/{n:012d}")
            deleted += bool(fs.delete(path, True))
        fs, path = self._fs(f"{self.path}/data")
        for change in fs.listStatus(path) if fs.exists(path) else ():
            n = int(change.getPath().getName().removeprefix("change="))
            parts = [s.getPath() for s in fs.listStatus(change.getPath()) if s.getPath().getName().startswith("bucket=")]
            for p in parts:
                if n <= (numbers[-1] if numbers else 0) and (int(p.getName().removeprefix("bucket=")), n) not in used:
                    deleted += bool(fs.delete(p, True))
        return deleted


def upserted(keys: list[str], content: str, newest: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A ``combine`` that keeps of each key the newest row, stored or staged; equal content stays as it is stored.

    Rows of one batch and key: the largest ``newest`` (then the largest content) counts.  A
    staged row that is older than the stored one changes nothing.
    """

    def combine(current: DataFrame, staged: DataFrame) -> DataFrame:
        names = current.columns
        order = F.struct(*([F.col(newest)] if newest else []), F.col(content), *[F.col(c) for c in names if c not in (*keys, newest, content)])
        fresh = staged.groupBy(*keys).agg(F.max(order).alias("_new"))
        old = current.select(*keys, order.alias("_old"))
        both = old.join(fresh, keys, "full")
        same = F.col("_old")[content].eqNullSafe(F.col("_new")[content])
        older = F.lit(False) if newest is None else F.coalesce(F.col("_new")[newest] < F.col("_old")[newest], F.lit(False))
        stays = F.col("_new").isNull() | (F.col("_old").isNotNull() & (same | older))
        return both.withColumn("_row", F.when(stays, F.col("_old")).otherwise(F.col("_new"))).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in names])

    return combine
