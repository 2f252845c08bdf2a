"""Structured Streaming: windows, quotas, histories, breakers, one-time codes, payments, ingestion."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULT
from ..session import small


def timed(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events with ts as a timestamp (tables hold it without a zone) and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(events: DataFrame, key: str, size: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    return timed(events, lateness).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding(events: DataFrame, key: str, size: str = "1 day", step: str = "12 hours", lateness: str = "1 hour") -> DataFrame:
    return timed(events, lateness).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    return timed(events, lateness).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def quota_stream(requests: DataFrame, subscriptions: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """start, identity, n, refused for each fixed day, with the tier of a static table (identity, tier).

    Unknown identities are anonymous.
    """
    rows = timed(requests, lateness).join(small(subscriptions, DEFAULT.broadcast_rows), "identity", "left")
    limit = F.when(F.col("tier") == "pro", DEFAULT.quota_pro).when(F.col("tier") == "user", DEFAULT.quota_user).otherwise(DEFAULT.quota_anonymous)
    counted = rows.groupBy(F.window("ts", f"{DEFAULT.quota_seconds} seconds"), "identity", limit.alias("allowed")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "identity", "n", F.greatest(F.lit(0), F.col("n") - F.col("allowed")).cast("long").alias("refused"))


def joined_streams(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Pairs of a key at most ``within`` apart, the right not before the left."""
    a = timed(left, lateness).select(F.col(key), F.col("ts").alias("left_ts"))
    b = timed(right, lateness).select(F.col(key).alias("_key"), F.col("ts").alias("right_ts"))
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))).drop("_key")


def once(calls: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The first of repeated calls within the watermark."""
    return timed(calls, lateness).dropDuplicatesWithinWatermark(keys)


class History(StatefulProcessor):
    """The open version of a key; a changed value closes it and opens the next.

    Rows: key, value, ts; out: key, value, valid_from, valid_to (null while open).
    """

    OUT = "key string, value string, valid_from timestamp, valid_to timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "value string, since timestamp")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        out = []
        current = self.open.get() if self.open.exists() else None
        frame = pd.concat(list(rows)).sort_values(["ts", "value"])
        for r in frame.itertuples():
            if current is None or current[0] != r.value:
                if current is not None:
                    out.append((key[0], current[0], current[1], r.ts))
                current = (r.value, r.ts.to_pydatetime())
        self.open.update(current)
        yield pd.DataFrame(out, columns=["key", "value", "valid_from", "valid_to"])

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """A circuit breaker for each model: consecutive failures open it, a success closes it.

    Rows: key, failed, ts; out: key, ts, failures, open.  Once open, calls pass after the
    cool-down; a failed probe does not start it anew, as the opening time is set once.
    """

    OUT = "key string, ts timestamp, failures int, open boolean"

    def __init__(self, most: int = DEFAULT.breaker_failures, cooldown_s: int = DEFAULT.breaker_cooldown_s):
        self.most, self.cooldown = most, cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, opened timestamp")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        failures, opened = self.state.get() if self.state.exists() else (0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            if r.failed:
                failures += 1
                if failures >= self.most and opened is None:
                    opened = r.ts.to_pydatetime()
            else:
                failures, opened = 0, None
            shut = opened is not None and (r.ts - pd.Timestamp(opened)).total_seconds() < self.cooldown
            out.append((key[0], r.ts, failures, bool(shut)))
        self.state.update((failures, opened))
        yield pd.DataFrame(out, columns=["key", "ts", "failures", "open"])

    def close(self) -> None:
        pass


class OneTimeCodes(StatefulProcessor):
    """Codes by phone: a cool-down before the next, a time to live, a number of attempts, the newest only.

    Rows: key (phone), kind (send or verify), code, ts; out: key, ts, kind, result.
    """

    OUT = "key string, ts timestamp, kind string, result string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("code", "code string, sent timestamp, attempts int")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        code, sent, attempts = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            age = (r.ts - pd.Timestamp(sent)).total_seconds() if sent is not None else None
            if r.kind == "send":
                if age is not None and age < DEFAULT.otp_cooldown_s:
                    result = "cooldown"
                else:
                    code, sent, attempts, result = r.code, r.ts.to_pydatetime(), 0, "sent"
            elif code is None:
                result = "none"
            elif age > DEFAULT.otp_ttl_s:
                result = "expired"
            elif attempts >= DEFAULT.otp_attempts:
                result = "too_many"
            elif r.code == code:
                code, result = None, "ok"
            else:
                attempts, result = attempts + 1, "wrong"
            out.append((key[0], r.ts, r.kind, result))
        self.state.update((code, sent, attempts))
        yield pd.DataFrame(out, columns=["key", "ts", "kind", "result"])

    def close(self) -> None:
        pass


def stateful(events: DataFrame, processor: StatefulProcessor, out: str | None = None) -> DataFrame:
    """``processor`` over events by ``key``; needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out or processor.OUT, outputMode="append", timeMode="none")


def available_now(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there into a table in memory, for checks against the batch form."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_stream(source: DataFrame, target: str, keys: list[str], content: str, checkpoint: str, newest: str | None = None, buckets: int = 64, columns: str | None = None) -> StreamingQuery:
    """Upsert each micro-batch by key into a ``BucketedTable`` at ``target``, gated by content.

    A batch reads and writes the buckets of its own keys only.  Of a key's rows the one with the
    largest ``newest`` counts, whether stored or staged (then, in a batch, the largest content);
    equal content changes nothing.  A batch that is run again after it was committed, which the
    table knows by checkpoint and number, does nothing; one that died before is done whole.
    """
    from ..sources.buckets import BucketedTable, upserted

    kept = [*keys, *([newest] if newest else []), content]
    kinds = dict(source.dtypes)
    schema = columns or ", ".join(f"`{c}` {kinds[c]}" for c in kept)

    def load(batch: DataFrame, number: int) -> None:
        table = BucketedTable(batch.sparkSession, target, schema, keys, buckets)
        table.merge(batch.select(*[f.name for f in table.schema.fields]), upserted(keys, content, newest), (checkpoint, number))

    q = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def alert_stream(changes: DataFrame, subscriptions: DataFrame, names: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Fan each micro-batch of changed acts (alert_id, act_type, names) out to the users whom it concerns.

    Subscriptions (user_id, act_type, keyword) are read anew for each batch.  A batch writes its
    own folder, so one that runs again after a failure replaces what it wrote.
    """
    from ..operators.records import alerts_for

    def emit(batch: DataFrame, number: int) -> None:
        alerts_for(batch, subscriptions, names).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = changes.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
