"""Keyed state with timers: each stream equals its batch form in any order of the rows, over restarts, and without further events."""

import random

import pyspark.sql.functions as F
import pytest

from codicil.config import DEFAULT
from codicil.operators import payments
from codicil.streaming import stateful

PRICE, HOUR = DEFAULT.price_tiyin, 3_600_000
T0 = 1_700_000_000_000


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def write(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(rows, target, checkpoint):
    q = rows.writeStream.format("parquet").option("path", str(target)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


CALLS = "key string, payme_id string, method string, amount long, reason int, ts timestamp"


def call(user, pay, method, at, amount=PRICE, reason=None):
    return (user, pay, method, amount, reason, at)


def calls(seed):
    r, out = random.Random(seed), []
    for u in range(12):
        at = T0
        for p in range(r.randint(1, 4)):
            pay = f"p{u}-{p}"
            for method in r.choices(["create", "create", "perform", "perform", "cancel"], k=r.randint(1, 5)):
                at += r.choice([0, 1000, HOUR, 13 * HOUR])
                out.append(call(f"u{u}", pay, method, at, r.choice([PRICE] * 5 + [1]), r.choice([None, 3, 5])))
    out += [call("idle", "open", "create", T0), call("two", "a", "create", T0), call("two", "b", "create", T0 + 1), call("two", "a", "perform", T0 + 2), call("two", "b", "create", T0 + 3)]
    return out


def as_rows(spark, some):
    return spark.createDataFrame(some, CALLS.replace("ts timestamp", "at long")).select("key", "payme_id", "method", "amount", "reason", F.timestamp_millis("at").alias("ts"))


def test_payments_equal_the_batch_fold(spark, tmp_path):
    every = calls(1)
    random.Random(2).shuffle(every)
    for part in (every[:40], every[40:], [call("last", "z", "cancel", T0 + 10_000 * HOUR)]):
        as_rows(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # A restart from the checkpoint after each file.
        run(stateful.by_event_time(stream(spark, tmp_path / "in", CALLS), stateful.Payments(), "2000 hours"), tmp_path / "out", tmp_path / "cp")
    got = payments.latest(spark.read.parquet(str(tmp_path / "out"))).where("user_id <> 'last'")
    table = spark.createDataFrame([(c[0], c[1], c[2], c[3], c[5], c[4]) for c in every], "user_id string, payme_id string, method string, amount long, at long, reason int")
    want = payments.books(table, until=T0 + 9_000 * HOUR)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(rows_of(got), key=key) == sorted(rows_of(want), key=key) and want.count() > 20
    by = {r.payme_id: r for r in got.collect()}
    assert (by["open"].state, by["open"].reason, by["open"].cancelled) == (-1, payments.TIMED_OUT, T0 + DEFAULT.payment_timeout_ms)
    assert (by["a"].state, by["b"].state, by["b"].refused) == (2, -1, 1)


def rows_of(df):
    return [tuple(r[c] for c in ("user_id", "payme_id", "amount", "state", "created", "performed", "cancelled", "reason", "refused", "revoked")) for r in df.collect()]


def test_the_book_of_one_user():
    book = {}
    put = lambda *c: payments.apply(book, dict(zip(("payme_id", "method", "at", "amount", "reason"), c)))
    put("a", "create", 0, 1, None)
    assert book["a"]["state"] == 0 and book["a"]["refused"] == 1
    put("a", "create", 1, PRICE, None)
    put("b", "create", 2, PRICE, None)
    assert (book["a"]["state"], book["b"]["state"], book["b"]["refused"]) == (1, 0, 1)
    put("a", "perform", 3, None, None)
    put("a", "perform", 4, None, None)
    assert (book["a"]["state"], book["a"]["performed"], book["a"]["refused"]) == (2, 3, 1)
    put("b", "create", 5, PRICE, None)
    put("a", "cancel", 6, None, 5)
    assert (book["a"]["state"], book["a"]["reason"], book["a"]["revoked"]) == (-2, 5, True)
    put("b", "perform", 5 + DEFAULT.payment_timeout_ms + 1, None, None)
    assert (book["b"]["state"], book["b"]["reason"], book["b"]["refused"], book["b"]["revoked"]) == (-1, 4, 2, False)
    put("b", "perform", 5 + DEFAULT.payment_timeout_ms, None, None)
    put("c", "cancel", 9, None, None)
    assert book["c"]["refused"] == 1


CODES = "key string, kind string, code string, ts timestamp"


def test_codes_expire_without_an_event(spark, tmp_path):
    s = 1000
    sends = [("a", "send", "1", 0), ("a", "send", "2", 30 * s), ("a", "verify", "1", 40 * s), ("b", "send", "7", 0), ("b", "verify", "8", 1 * s), ("b", "verify", "7", 301 * s), ("c", "send", "3", 5 * s)]
    sends += [("d", "send", "4", 0)] + [("d", "verify", "0", k * s) for k in range(1, 7)] + [("e", "send", "5", 0), ("e", "send", "6", 61 * s), ("e", "verify", "5", 62 * s), ("e", "verify", "6", 63 * s)]
    random.Random(4).shuffle(sends)
    for k, part in enumerate((sends[:9], sends[9:], [("z", "verify", "0", 10**7)])):
        spark.createDataFrame(part, CODES.replace("ts timestamp", "at long")).select("key", "kind", "code", F.timestamp_millis(F.col("at") + T0).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stateful.by_event_time(stream(spark, tmp_path / "in", CODES), stateful.Codes(), "1 hour"), tmp_path / "out", tmp_path / "cp")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "kind").collect():
        got.setdefault(r.key, []).append((r["at"] - T0, r.kind, r.result))
    assert got["a"] == [(0, "send", "sent"), (30 * s, "send", "cooldown"), (40 * s, "verify", "ok")]
    assert got["b"] == [(0, "send", "sent"), (1 * s, "verify", "wrong"), (300 * s, "timer", "expired"), (301 * s, "verify", "none")]
    assert got["c"] == [(5 * s, "send", "sent"), (305 * s, "timer", "expired")]
    assert [x[2] for x in got["d"]] == ["sent"] + ["wrong"] * 5 + ["too_many", "expired"]
    assert [x[2] for x in got["e"]] == ["sent", "sent", "wrong", "ok"]


MEMORIES = "key string, memory_id long, weight double, ts timestamp"


def test_memories_are_capped_and_pruned(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"u{k % 3}", k, r.choice([0.06, 0.53, 1.1, 4.3]), T0 + r.randint(0, 60) * 86_400_000) for k in range(120)] + [("idle", 900, 0.1, T0)]
    parts = [rows[:50], rows[50:], [("z", 999, 1.0, T0 + 90 * 86_400_000)]]
    for part in parts:
        spark.createDataFrame(part, MEMORIES.replace("ts timestamp", "at long")).select("key", "memory_id", "weight", F.timestamp_millis("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stateful.by_event_time(stream(spark, tmp_path / "in", MEMORIES), stateful.Memories(most=10, half_life_weeks=2.0), "0 seconds" if part is parts[-1] else "100 days"), tmp_path / "out", tmp_path / "cp")
    now = T0 + 90 * 86_400_000
    held = {}
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        held.setdefault(x.key, {}).setdefault(x.change, set()).add(x.memory_id)
    effective = lambda w, c: w * 2 ** (-(now - c) / (2 * stateful.WEEK_MS))
    for u in ("u0", "u1", "u2", "idle"):
        own = [x for x in rows if x[0] == u]
        top = sorted(own, key=lambda x: (-effective(x[2], x[3]), x[1]))[:10]
        got = held[u]
        left = got["kept"] - got.get("evicted", set())
        assert left == {x[1] for x in top}
        assert got.get("pruned", set()) & left == {x[1] for x in top if effective(x[2], x[3]) < DEFAULT.memory_prune_weight}


def test_a_tier_is_cached_for_its_time(spark, tmp_path):
    schema, tiers = "key string, request long", str(tmp_path / "tiers")
    read = lambda: spark.read.schema("key string, tier string").parquet(tiers)
    for n, tier in enumerate(["user", "pro"]):
        spark.createDataFrame([("a", tier)], "key string, tier string").write.mode("overwrite").parquet(tiers)
        write(spark, tmp_path / "in", schema, [("a", n), ("nobody", 100 + n)])
        rows = stateful.cached_tiers(stream(spark, tmp_path / "in", schema), read(), 600_000)
        # A time to live keeps a stream awake: it never says that all is done.
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
        q.awaitTermination(15)
        q.stop()
    assert {r.request: r.tier for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "user", 1: "user", 100: "anonymous", 101: "anonymous"}


def test_unknown_calls_take_no_part(spark):
    table = spark.createDataFrame([(None, "p", "create", PRICE, T0, None), ("u", None, "create", PRICE, T0, None)], "user_id string, payme_id string, method string, amount long, at long, reason int")
    assert payments.books(table).count() == 0
    with pytest.raises(KeyError):
        payments.in_order([{"at": 1, "method": "other", "payme_id": "p", "amount": 1, "reason": None}, {"at": 1, "method": "create", "payme_id": "p", "amount": 1}])
