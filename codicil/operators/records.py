"""Records that change: versions, upserts, alerts, memory, quotas, subscriptions, the payment ledger."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..config import DEFAULT
from ..session import small, spread


def history(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, value, valid_from, valid_to: one row for each change of ``value``, the last one open.

    Equal neighbours are one version; rows of one time are ordered by value.
    """
    order = Window.partitionBy(*keys).orderBy(at, value)
    first = F.lag(F.lit(1)).over(order).isNull()
    rows = rows.withColumn("_first", first).withColumn("_before", F.lag(value).over(order))
    changed = rows.where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value)))
    return changed.select(*keys, value, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """Versions valid at a time."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def open_version(versions: DataFrame, keys: list[str], captured: str = "captured_at") -> DataFrame:
    """The open row of each key, the latest captured."""
    latest = Window.partitionBy(*keys).orderBy(F.col(captured).desc(), F.col("valid_from").desc())
    return versions.where("valid_to IS NULL").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, staging: DataFrame, keys: list[str], content: str, force: bool = False) -> DataFrame:
    """keys, content, change: new, amended, unchanged or kept (absent from staging).

    Content is compared by SHA-256, so unchanged rows cost nothing downstream.
    """
    t = target.select(*keys, F.col(content).alias("_old"), F.sha2(content, 256).alias("_old_hash"), F.lit(True).alias("_in_target"))
    s = staging.select(*keys, F.col(content).alias("_new"), F.sha2(content, 256).alias("_new_hash"), F.lit(True).alias("_in_staging"))
    rows = t.join(s, keys, "full")
    same = F.col("_old_hash").eqNullSafe(F.col("_new_hash")) & F.lit(not force)
    change = F.when(F.col("_in_target").isNull(), "new").when(F.col("_in_staging").isNull(), "kept").when(same, "unchanged").otherwise("amended")
    return rows.select(*keys, F.when(F.col("_in_staging").isNull(), F.col("_old")).otherwise(F.col("_new")).alias(content), change.alias("change"))


def replace_slice(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """target without the slices that ``fresh`` brings, and fresh."""
    return target.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def alerts_for(alerts: DataFrame, subscriptions: DataFrame, names: list[str]) -> DataFrame:
    """user_id and alert columns of alerts whose act_type or any of whose names a user subscribes to.

    The disjunction is two joins: an equality on the kind, and a containment for keyword
    subscriptions, which meet the alerts by their rarest characters; neither is a nested loop.
    An empty keyword reaches nothing.  Both sides are made distinct before they meet and what a kind
    reaches is left out of the other join, so the pairs, which may be many times the alerts, need no
    shuffle.
    """
    from .containment import SENT, held

    kinds = subscriptions.where("act_type IS NOT NULL").select("user_id", "act_type").distinct()
    words = subscriptions.where("keyword IS NOT NULL").select("user_id", F.lower("keyword").alias("_keyword")).distinct()
    alerts, columns = spread(alerts.distinct()), alerts.columns
    by_kind = alerts.join(small(kinds, SENT), "act_type").select("user_id", *columns)
    text = F.lower(F.concat_ws("\n", *names))
    by_word = held(alerts.withColumn("_text", text), words, "_text", "_keyword", counted=False)
    by_word = by_word.select("user_id", *columns).distinct().join(small(kinds, SENT), ["user_id", "act_type"], "left_anti")
    return by_kind.unionByName(by_word.select("user_id", *columns))


def decayed(weight: Column, created: Column, now: Column, half_life_weeks: float = DEFAULT.memory_half_life_weeks) -> Column:
    """The weight after its half-lives; ``now`` is given, never the clock."""
    weeks = (F.unix_timestamp(now) - F.unix_timestamp(created)) / (7 * 86_400)
    return weight * F.pow(F.lit(2.0), -weeks / half_life_weeks)


def capped(rows: DataFrame, by: str, newest: str, key: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each ``by``."""
    order = Window.partitionBy(by).orderBy(F.col(newest).desc(), F.col(key).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def recall(memories: DataFrame, questions: DataFrame, now: Column, least: float = 0.1, near: int = 5, most: int = 3) -> DataFrame:
    """user_id, query_id, memory_id, score, effective: of a user's ``near`` nearest memories those still heavy enough.

    memories: memory_id, user_id, embedding, weight, created_at; questions: query_id, user_id, query.
    """
    from .dense import similarity

    pairs = questions.join(memories.where(F.col("weight") > least), "user_id")
    pairs = pairs.withColumn("score", F.round(similarity(F.col("query"), F.col("embedding")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    close = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= near).withColumn("effective", decayed(F.col("weight"), F.col("created_at"), now))
    close = close.where(F.col("effective") >= least).withColumn("_m", F.row_number().over(order)).where(F.col("_m") <= most)
    return close.select("user_id", "query_id", "memory_id", "score", "effective")


def bucket(ts: Column, seconds: int = DEFAULT.quota_seconds) -> Column:
    """Start of the fixed window of a time, in epoch seconds."""
    return (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")


def retry_after(ts: Column, seconds: int = DEFAULT.quota_seconds) -> Column:
    """Seconds to the end of the window, never 0."""
    return F.greatest(F.lit(1), bucket(ts, seconds) + seconds - F.unix_timestamp(ts)).cast("long")


def window_label(seconds: Column) -> Column:
    # Names of common windows.
    return F.when(seconds == 3600, "hour").when(seconds == 86_400, "day").when(seconds == 60, "minute").otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def quota(requests: DataFrame, limits: Column, seconds: int = DEFAULT.quota_seconds) -> DataFrame:
    """identity, bucket, n, over: requests of a window and how many were refused.

    limits: the allowed number for an identity, null for none.
    """
    rows = requests.groupBy("identity", "tier", bucket(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.withColumn("refused", F.greatest(F.lit(0), F.col("n") - F.coalesce(limits, F.col("n"))).cast("long"))


def error_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """key, run, length, first, last of consecutive failures: what a circuit breaker counts."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_bad", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_bad")).over(w))
    return rows.where("_bad = 1").groupBy(key, F.col("_run").alias("run")).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def extended(now: Column, expires: Column, days: int = DEFAULT.subscription_days) -> Column:
    """A new expiry from the later of now and the present one."""
    return F.greatest(now, F.coalesce(expires, now)) + F.make_dt_interval(F.lit(days))


def e164(raw: Column) -> Column:
    """+998 and nine digits from any usual spelling; null if it is none."""
    digits = F.regexp_replace(raw, "\\D", "")
    full = F.when(F.length(digits) == 9, F.concat(F.lit("998"), digits)).when((F.length(digits) == 13) & F.startswith(digits, F.lit("8998")), F.substring(digits, 2, 12)).otherwise(digits)
    return F.when(full.rlike("^998\\d{9}$"), F.concat(F.lit("+"), full))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def backoff(attempt: Column) -> Column:
    """Seconds before a retry, without jitter."""
    return F.least(F.lit(60.0), F.lit(1.5) * F.pow(F.lit(2.0), attempt))


LEDGER = "payme_id string, user_id string, amount long, state int, create_time long, perform_time long, cancel_time long, reason int, refused int"

#: Calls of one time stand in this order.
CALL_ORDER = {"create": 0, "perform": 1, "cancel": 2}


def fold_payments(calls: DataFrame, price: int = DEFAULT.price_tiyin, timeout_ms: int = DEFAULT.payment_timeout_ms) -> DataFrame:
    """The ledger after a table of calls: payme_id, user_id, method, amount, at (epoch ms), reason.

    create, perform and cancel of one transaction in order of time (at one time in that order); a repeated call changes
    nothing.  States: 1 created, 2 performed, -1 cancelled before, -2 refunded.  A create with a
    wrong amount and a perform after the time-out are refused, the latter cancelling with
    reason 4.  A fold for each transaction, whose calls are few.
    """

    say = lambda c, m: F.coalesce(c["method"] == m, F.lit(False))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))

    def apply(s: Column, c: Column) -> Column:
        state, create, perform, cancel = s["state"], say(c, "create"), say(c, "perform"), say(c, "cancel")
        new = create & (state == 0) & same(c["amount"], F.lit(price))
        late = perform & (state == 1) & F.coalesce(c["at"] - s["create_time"] > timeout_ms, F.lit(False))
        done = perform & (state == 1) & ~late
        undone = cancel & state.isin(1, 2)
        other = create & ~new & ((state == 0) | ~same(c["amount"], s["amount"]))
        refused = other | late | (perform & (state <= 0)) | (cancel & (state == 0))
        return F.struct(
            F.when(new, c["user_id"]).otherwise(s["user_id"]).alias("user_id"),
            F.when(new, c["amount"]).otherwise(s["amount"]).alias("amount"),
            F.when(new, 1).when(late, -1).when(done, 2).when(undone, -state).otherwise(state).alias("state"),
            F.when(new, c["at"]).otherwise(s["create_time"]).alias("create_time"),
            F.when(done, c["at"]).otherwise(s["perform_time"]).alias("perform_time"),
            F.when(late | undone, c["at"]).otherwise(s["cancel_time"]).alias("cancel_time"),
            F.when(late, 4).when(undone, c["reason"]).otherwise(s["reason"]).alias("reason"),
            (s["refused"] + refused.cast("int")).alias("refused"),
        )

    kinds = dict(f.split() for f in LEDGER.split(", "))
    begin = F.struct(*[F.lit(None if n in ("user_id", "amount", "reason") else 0).cast(kinds[n]).alias(n) for n in kinds if n != "payme_id"])
    step = F.coalesce(*[F.when(F.col("method") == m, n) for m, n in CALL_ORDER.items()], F.lit(len(CALL_ORDER)))
    call = F.struct(F.col("at").isNull().alias("late"), F.col("at").cast("long").alias("at"), step.alias("step"), F.col("amount").cast("long").alias("amount"), F.col("reason").cast("int").alias("reason"), F.col("user_id").cast("string").alias("user_id"), "method")
    folded = calls.groupBy(F.col("payme_id").cast("string").alias("payme_id")).agg(F.aggregate(F.sort_array(F.collect_list(call)), begin, apply).alias("e"))
    return folded.select("payme_id", "e.*").select(*kinds)


def one_open_each(ledger: DataFrame) -> DataFrame:
    """Open transactions that must wait because their user has an earlier one."""
    order = Window.partitionBy("user_id").orderBy("create_time", "payme_id")
    return ledger.where("state = 1").withColumn("_n", F.row_number().over(order)).where("_n > 1").drop("_n")


def newest_code(codes: DataFrame) -> DataFrame:
    """The latest code of each phone that is not consumed: codes hold phone, code_id, created_at, consumed."""
    latest = Window.partitionBy("phone").orderBy(F.col("created_at").desc(), F.col("code_id").desc())
    return codes.where(~F.col("consumed")).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def streamed_answers(events: DataFrame) -> DataFrame:
    """request, answer, final from request, seq, kind (delta or done), text.

    The last ``done`` replaces what was streamed; without one, the deltas stand in order.  A
    request's deltas are one answer's, so their list is small.
    """
    done = F.col("kind") == "done"
    last = F.max_by(F.when(done, F.col("text")), F.when(done, F.col("seq")))
    deltas = F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text"))))
    rows = events.groupBy("request").agg(last.alias("last"), deltas.alias("deltas"), F.bool_or(done).alias("final"))
    streamed = F.array_join(F.col("deltas.text"), "")
    return rows.select("request", F.when(F.col("final"), F.col("last")).otherwise(streamed).alias("answer"), "final")
