"""What the operators share: lineage cuts, prefix sums over sorted data, small expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship

#: A word is a run of characters other than these (space and U+0009..U+000D).
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"

#: Folders of cuts that are not deleted yet, oldest first, with a session each.
_FOLDERS: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without the setting, a local session takes a temporary folder; on a cluster each executor
    would write to a disk of its own, so that is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local") and "cluster" not in spark.conf.get("spark.master"):
        spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="codicil-"))
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings (dots as ``__``) for the work inside, and what they were before after it."""
    named = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there.

    A lost executor costs at most the work since the last cut, both sides of a later join are
    plain exchanges that adaptive execution can split, sizes are those of the files, and the
    shuffle files of the work go as soon as it is written.  ``drop`` deletes the files.
    """
    spark = df.sparkSession
    ship(spark)
    path = path or f"{shared_folder(spark)}/codicil-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(path: str) -> None:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    where.delete_dir(at)


def drop(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing will read any more; other frames stay as they are."""
    for made in cuts:
        path = made.__dict__.get("_folder")
        if _FOLDERS.pop(path, None) is None:
            continue
        try:
            _delete(path)
        except (OSError, ValueError):  # a store that only Spark writes to: its rows go, one empty file stays
            made.limit(0).coalesce(1).write.mode("overwrite").parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete what was cut inside and is still there, but for the last cut: the result of the work."""
    before = set(_FOLDERS)
    yield
    _forget([p for p in _FOLDERS if p not in before][:-1])


def _forget(paths) -> None:
    for path in list(paths):
        _FOLDERS.pop(path, None)
        with contextlib.suppress(OSError, ValueError):
            _delete(path)


#: A result that is read lazily still needs its last cuts; they go when the driver ends.
atexit.register(lambda: _forget(_FOLDERS))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of ``rows``, unless the session says another number than the default.

    A batch is held on both sides at once; the default of 10000 texts can take more memory than
    the work on them.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def private(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has."""
    low = {c.lower() for c in taken}
    while f"_{name}" in low:
        name = f"_{name}"
    return f"_{name}"


def aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that are not in ``used`` under names of their own, and what selects all as they were named.

    So what an operator adds can't take the place of a column that it doesn't read.
    """
    hidden = {c: private(f"own{i}", docs.columns) for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(hidden), [F.col(hidden.get(c, c)).alias(c) for c in docs.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def bounded(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 250_000) -> DataFrame:
    """Join with ``right`` sent to every executor if it has at most ``most`` rows, else by a shuffle."""
    return left.join(F.broadcast(right) if bounded(right, most) else right, on, how)


#: Segments of an id filter, bits for each id, and bytes of a filter at least and at most.
SEGMENTS, ID_BITS, LEAST_BYTES, MOST_BYTES = 64, 16, 1 << 16, 1 << 25


def id_filter(ids: DataFrame, column: str):
    """A Bloom filter of a long column, broadcast for ``maybe_in``.

    Its size follows the number of ids between LEAST_BYTES and MOST_BYTES, the bound of what is
    broadcast.  Each segment is built by one task, so the driver gets SEGMENTS rows.  At
    ID_BITS bits an id one in 400 others passes; with ids beyond the bound more pass.  So it may
    only spare work, and what passes must be harmless or be joined exactly.
    """
    import numpy as np

    rows = ids.select(F.col(column).cast("long").alias("i")).where("i is not null")
    each = max(1, ID_BITS * rows.count() // SEGMENTS)
    size = min(8 * MOST_BYTES // SEGMENTS, max(8 * LEAST_BYTES // SEGMENTS, 1 << (each - 1).bit_length()))
    segment = F.col("i").bitwiseXOR(F.shiftright("i", 6)).bitwiseXOR(F.shiftright("i", 12)).bitwiseAND(F.lit(SEGMENTS - 1))

    def build(batches):
        import numpy as np
        import pyarrow as pa

        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            segments, places = _places(batch.column(0).to_numpy(), size)
            for s in np.unique(segments):
                found = maps.setdefault(int(s), np.zeros(size, dtype=bool))
                for p in places:
                    found[p[segments == s]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(b).tobytes() for b in maps.values()], pa.binary())], names=["segment", "bits"])

    out = np.zeros((SEGMENTS, size // 8), dtype=np.uint8)
    # A cut, so that the shuffle files of the ids go before the next work starts.
    parts = cut(rows.repartition(SEGMENTS, segment).mapInArrow(build, "segment int, bits binary"))
    found = parts.toArrow()
    for segment, bits in zip(found.column("segment"), found.column("bits")):
        out[segment.as_py()] |= np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    del found
    drop(parts)
    return ids.sparkSession.sparkContext.broadcast(out)


def _places(ids, size: int):
    """The segment of each id and its four places among ``size`` bits there."""
    import numpy as np

    from ._text import mix

    h = mix(ids.view(np.uint64))
    spots = [(h >> np.uint64(k) & np.uint64(size - 1)).astype(np.int64) for k in (0, 14, 28, 42)]
    return (ids ^ (ids >> 6) ^ (ids >> 12)) & (SEGMENTS - 1), spots


def maybe_in(sent, ids):
    """Which of an int64 array may be in an ``id_filter``; ids in it always are."""
    import numpy as np

    bits, (segments, spots) = sent.value, _places(np.ascontiguousarray(ids), sent.value.shape[1] * 8)
    found = np.ones(len(ids), dtype=bool)
    for p in spots:
        found &= (bits[segments, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``group`` in ``order``.

    One range exchange on (group, order) deals even a group with most of the rows
    over many tasks; each task sums its own run of sorted rows, and the offsets of
    the runs (at most one row for each task and group) are summed by a window.
    ``order`` must tell rows apart unless equal rows may stand in any order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField(out, T.LongType()), T.StructField("_sum", T.LongType())])
    at, val = df.columns.index(group), df.columns.index(value)

    def sums(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        run, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups, values = batch.column(at).to_pylist(), batch.column(val).to_pylist()
            before, after = [], []
            for g, v in zip(groups, values):
                if g != last:
                    last, total = g, 0
                before.append(total)
                total += v
                after.append(total)
            more = [pa.array([run] * batch.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_run", out, "_sum"])

    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    runs = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(sums, schema))
    ends = runs.groupBy("_run", group).agg(F.max("_sum").alias("_end"))
    earlier = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(ends.select("_run", F.col(group).alias("_group"), F.coalesce(F.sum("_end").over(earlier), F.lit(0)).alias("_start")))
    starts = starts.withColumnRenamed("_run", "_run2")
    joined = runs.join(starts, (F.col("_run") == F.col("_run2")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col(out) + F.col("_start")).alias(out))
