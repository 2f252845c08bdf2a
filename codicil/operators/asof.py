"""The version of a key that is valid at a time, for a table of requests, in one ordered pass.

Requests and versions stand in one sequence by key and time, dealt by ranges of (key, time), so a
key with most of the rows is many tasks' work.  Each task carries the last version along; where
a run of a key goes on from an earlier task, that task's last version (one row for each task) is
filled in.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from ..scratch import stored


def as_of_join(requests: DataFrame, versions: DataFrame, keys: list[str], at: str, valid_from: str, valid_to: str | None = None, newest: str | None = None, strict: bool = False) -> DataFrame:
    """requests with the other columns of versions: the latest one with ``valid_from`` <= ``at`` (< if ``strict``).

    With ``valid_to`` a version that has ended by then (``valid_to`` <= ``at``) is none; an open
    one has null there.  Versions of one key and time are ordered by ``newest``, the largest
    counting, then by their other columns.  Requests without a version have nulls.  Rows with a
    null key or time find none, and versions with one are none.
    """
    taken = [c for c in versions.columns if c not in keys]
    clash = [c for c in taken if c in requests.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in keys]))
    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    # At equal times versions stand first, or last if strict; the largest ``newest`` stands last of them.
    kind = F.lit(1 if strict else 0)
    tie = F.struct(*[F.col(c) for c in ([newest] if newest else []) + [c for c in taken if c != newest]])
    kinds = dict(requests.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(f"r_{c}") for c in requests.columns]
    v = versions.where(whole & F.col(valid_from).isNotNull()).select(key.alias("_k"), F.col(valid_from).alias("_at"), kind.alias("_kind"), tie.alias("_v"), *blank)
    named = whole & F.col(at).isNotNull()
    r = requests.select(F.when(named, key).alias("_k"), F.col(at).alias("_at"), (F.lit(1) - kind).alias("_kind"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"r_{c}") for c in requests.columns])
    both = v.select(*v.columns, F.lit(True).alias("_is")).unionByName(r.withColumn("_is", F.lit(False)))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_k", "_at", "_kind", "_v"]
    sequence = both.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = [f"r_{c}" for c in requests.columns]
    fields = sequence.schema
    schema = T.StructType([*[fields[c] for c in own], fields["_v"], fields["_k"], T.StructField("_run", T.IntegerType()), T.StructField("_open", T.BooleanType()), T.StructField("_end", T.BooleanType())])

    def carry(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        run, last_key, held, seen = TaskContext.get().partitionId(), None, None, False
        kept, shape = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shape = shape or batch
            k, is_version, version = batch.column("_k"), batch.column("_is").to_numpy(zero_copy_only=False), batch.column("_v")
            codes = k.dictionary_encode()
            code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.append(True, code[1:] != code[:-1])
            goes_on = seen and k[0].as_py() == last_key
            place = np.where(is_version, np.arange(len(code)), -1)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
            latest = np.maximum.accumulate(place)
            latest = np.where(latest >= begin, latest, -1)
            # A version of before this batch stands at the end.
            pool = version if held is None else pa.concat_arrays([version, held])
            if goes_on and held is not None:
                latest = np.where((latest < 0) & (begin == 0), len(version), latest)
            asks = np.flatnonzero(~is_version)
            if kept is None or (seen and not goes_on):
                opening = begin == 0 if kept is None else np.zeros(len(code), dtype=bool)
            else:
                opening = (begin == 0) & kept
            # In the task's first key, what has found nothing may find it in an earlier task.
            is_open = opening & (latest < 0)
            at = latest[asks]
            found = pool.take(pa.array(at, mask=at < 0))
            columns = [batch.column(c).take(pa.array(asks)) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, found, k.take(pa.array(asks)), pa.array(np.full(len(asks), run, dtype=np.int32)), pa.array(is_open[asks]), pa.array(np.zeros(len(asks), dtype=bool))], names=schema.names)
            end = latest[-1]
            held = pool.slice(int(end), 1) if end >= 0 else None
            kept = bool(opening[-1])
            last_key, seen = k[-1].as_py(), True
        if seen:
            nothing = [pa.nulls(1, shape.column(c).type) for c in own]
            value = held if held is not None else pa.nulls(1, shape.column("_v").type)
            yield pa.RecordBatch.from_arrays([*nothing, value, pa.array([last_key], shape.column("_k").type), pa.array([run], pa.int32()), pa.array([False]), pa.array([True])], names=schema.names)

    rows = stored(sequence.mapInArrow(carry, schema), "asof")
    # One row for each task: the last version of its last key, and so of all earlier tasks that end in that key.
    ends = rows.where("_end").select("_run", F.col("_k").alias("_ek"), "_v")
    earlier = Window.partitionBy("_ek").orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_ev", F.last("_v", ignorenulls=True).over(earlier))
    along = Window.orderBy("_run")
    before = ends.select(F.col("_run").alias("_br"), F.lag("_ek").over(along).alias("_bk"), F.lag("_ev").over(along).alias("_bv"))
    asked = rows.where("NOT _end")
    joined = asked.join(F.broadcast(before), (F.col("_run") == F.col("_br")) & (F.col("_k") == F.col("_bk")), "left")
    version = F.when(F.col("_open"), F.col("_bv")).otherwise(F.col("_v"))
    version = F.when(F.col("_k").isNotNull(), version)
    if valid_to is not None:
        over = version[valid_to].isNotNull() & (version[valid_to] <= F.col(f"r_{at}"))
        version = F.when(~over, version)
    return joined.select(*[F.col(f"r_{c}").alias(c) for c in requests.columns], version.alias("_found")).select(*requests.columns, *[F.col("_found")[c].alias(c) for c in taken])
