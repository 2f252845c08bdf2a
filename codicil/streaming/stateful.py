"""Keyed state with timers and limits: payments, one-time codes, memories and cached tiers.

Rows may come in any order within the watermark.  Processors that need order keep a key's rows
until the watermark has passed them (``Waiting``), so the result is that of the batch form; an
event-time timer also fires for a key that gets no further row.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT
from ..operators import payments

WEEK_MS = 7 * 86_400_000


def millis(ts) -> int:
    return int(ts.value // 1_000_000)


def by_event_time(rows: DataFrame, processor: StatefulProcessor, lateness: str = "1 hour") -> DataFrame:
    """``processor`` over rows by ``key`` with timers on the event time ``ts``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="append", timeMode="EventTime")


class Waiting(StatefulProcessor):
    """Keeps a key's rows (columns ROW, with ``at`` in epoch ms) until the watermark has passed them, then handles them in order."""

    ROW = ""
    OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.names = [c.split()[0] for c in self.ROW.split(", ")]

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows))
        frame = frame.assign(at=[millis(t) for t in frame["ts"]])
        # A column with nulls comes as floats; state wants what its schema says.
        whole = [c.split()[1] in ("int", "long") for c in self.ROW.split(", ")]
        columns = [[None if pd.isna(v) else int(v) if w else v for v in frame[c]] for c, w in zip(self.names, whole)]
        self.waiting.appendList(list(zip(*columns)))
        known = set(self.handle.listTimers())
        for at in sorted(set(columns[self.names.index("at")]) - known):
            self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        # All that the watermark has passed, in order: the other timers of the batch find nothing left.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [dict(zip(self.names, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = [r for r in rows if r["at"] <= now], [r for r in rows if r["at"] > now]
        if due:
            if later:
                self.waiting.put([tuple(r[c] for c in self.names) for r in later])
            else:
                self.waiting.clear()
        out = self.handle_due(key[0], due, now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handle_due(self, key, rows: list[dict], now: int) -> list[tuple]:
        raise NotImplementedError

    def wake(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Payments(Waiting):
    """A user's payment book.  Rows: key (user), payme_id, method, amount, reason, ts; out: the entries that change."""

    ROW = "payme_id string, method string, amount long, reason int, at long"
    OUT = payments.BOOK + ", n long"

    def __init__(self, price: int = DEFAULT.price_tiyin, timeout_ms: int = DEFAULT.payment_timeout_ms):
        self.price, self.timeout = price, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.book = handle.getMapState("book", "payme_id string", "amount long, state int, created long, performed long, cancelled long, reason int, refused int, revoked boolean")
        self.count = handle.getValueState("changes", "n long")

    def handle_due(self, key, rows, now):
        book = {k[0]: dict(zip(payments.ENTRY, (k[0], *v))) for k, v in self.book.iterator()}
        n = self.count.get()[0] if self.count.exists() else 0
        out, changed = [], {}

        def note(entries):
            nonlocal n
            for e in entries:
                n += 1
                changed[e["payme_id"]] = e
                out.append((key, *(e[c] for c in payments.ENTRY), n))

        for call in payments.in_order(rows):
            note(payments.apply(book, call, self.price, self.timeout))
        note(payments.expire(book, now, self.timeout))
        for e in changed.values():
            self.book.updateValue((e["payme_id"],), tuple(e[c] for c in payments.ENTRY[1:]))
            if e["state"] == 1:
                self.wake(e["created"] + self.timeout + 1)
        if changed:
            self.count.update((n,))
        return out


class Codes(Waiting):
    """One-time codes of a phone: a cool-down before the next, a time to live, a number of attempts, the newest only.

    Rows: key (phone), kind (send or verify), code, ts; out: key, at, kind, result.  A code that
    nobody has used goes when its time is over: kind ``timer``, result ``expired``.
    """

    ROW = "kind string, code string, at long"
    OUT = "key string, at long, kind string, result string"

    def __init__(self, ttl_s: int = DEFAULT.otp_ttl_s, cooldown_s: int = DEFAULT.otp_cooldown_s, attempts: int = DEFAULT.otp_attempts):
        self.ttl, self.cooldown, self.attempts = ttl_s * 1000, cooldown_s * 1000, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.code = handle.getValueState("code", "code string, sent long, attempts int, live boolean")

    def handle_due(self, key, rows, now):
        code, sent, tries, live = self.code.get() if self.code.exists() else (None, None, 0, False)
        out = []
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"], r["code"] or "")):
            at = r["at"]
            if live and at > sent + self.ttl:
                live = False
                out.append((key, sent + self.ttl, "timer", "expired"))
            if r["kind"] == "send":
                if sent is not None and at - sent < self.cooldown:
                    result = "cooldown"
                else:
                    code, sent, tries, live, result = r["code"], at, 0, True, "sent"
                    self.wake(at + self.ttl + 1)
            elif not live:
                result = "none"
            elif tries >= self.attempts:
                result = "too_many"
            elif r["code"] == code:
                live, result = False, "ok"
            else:
                tries, result = tries + 1, "wrong"
            out.append((key, at, r["kind"], result))
        if live and now > sent + self.ttl:
            live = False
            out.append((key, sent + self.ttl, "timer", "expired"))
        if sent is not None and not live and now > sent + max(self.ttl, self.cooldown):
            self.code.clear()  # nothing of it counts any more
        elif sent is not None:
            self.code.update((code, sent, tries, live))
        return out


def standing(weight: float, created: int, half_life_weeks: float = DEFAULT.memory_half_life_weeks) -> float:
    """What orders memories at any time: all decay alike, so the order of decayed weights never changes."""
    return math.log2(weight) + created / (half_life_weeks * WEEK_MS)


class Memories(StatefulProcessor):
    """At most ``most`` memories of a user in state, the heaviest after decay; what has decayed below ``least`` goes by a timer.

    Rows: key (user), memory_id, weight, ts; out: key, memory_id, change (kept, evicted or
    pruned), at in epoch ms.  Order does not matter, as the order of decayed weights is fixed.
    """

    OUT = "key string, memory_id long, change string, at long"

    def __init__(self, most: int = DEFAULT.memory_cap, least: float = DEFAULT.memory_prune_weight, half_life_weeks: float = DEFAULT.memory_half_life_weeks):
        self.most, self.least, self.half_life = most, least, half_life_weeks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "memory_id long, weight double, created long")

    def _ends(self, weight: float, created: int) -> int:
        """When a memory weighs less than ``least``."""
        return created + math.ceil(self.half_life * WEEK_MS * max(0.0, math.log2(weight / self.least)))

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.held.put(rows)
            at = min(self._ends(w, c) for _, w, c in rows) + 1
            for other in set(self.handle.listTimers()) - {at}:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(at)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        now = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        frame = pd.concat(list(rows))
        new = [(int(m), float(w), millis(t)) for m, w, t in zip(frame["memory_id"], frame["weight"], frame["ts"]) if w > 0]
        ranked = sorted({*now, *new}, key=lambda r: (-standing(r[1], r[2], self.half_life), r[0]))
        kept, gone, had = ranked[: self.most], ranked[self.most :], set(now)
        self._keep(kept)
        out = [(key[0], r[0], "kept", r[2]) for r in kept if r not in had] + [(key[0], r[0], "evicted", r[2]) for r in gone]
        yield pd.DataFrame(out, columns=["key", "memory_id", "change", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        over = [r for r in rows if self._ends(r[1], r[2]) < now]
        self._keep([r for r in rows if r not in over])
        yield pd.DataFrame([(key[0], r[0], "pruned", now) for r in over], columns=["key", "memory_id", "change", "at"])

    def close(self) -> None:
        pass


class CachedTiers(StatefulProcessor):
    """The tier of an identity, looked up once a minute: state with a time to live.

    Rows: key, tier (as the table has it now), request; out: key, request, tier (as it is cached).
    """

    OUT = "key string, request long, tier string"

    def __init__(self, ttl_ms: int = 60_000):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tier = handle.getValueState("tier", "tier string", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values("request")
        if not self.tier.exists():
            self.tier.update((frame["tier"].iloc[0],))
        tier = self.tier.get()[0]
        yield pd.DataFrame({"key": key[0], "request": frame["request"], "tier": tier})

    def close(self) -> None:
        pass


def cached_tiers(requests: DataFrame, tiers: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """requests (key, request) with the tier of a table (key, tier) as of the last look-up, at most ``ttl_ms`` ago."""
    rows = requests.join(tiers, "key", "left").select("key", "request", F.coalesce("tier", F.lit("anonymous")).alias("tier"))
    processor = CachedTiers(ttl_ms)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="append", timeMode="ProcessingTime")
