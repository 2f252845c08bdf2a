"""The payment book of a user: what each call does to it, for a table of calls and for a stream.

States: 0 refused from the start, 1 created, 2 performed, -1 cancelled before, -2 refunded.  A
user has one open payment at a time; a create meanwhile is refused.  An open payment that is not
performed within the time-out is cancelled with reason 4 at that moment, by the clock of the
calls and whether or not one comes.  A refund of a performed payment revokes what it bought.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..config import DEFAULT

#: Calls of one time stand in this order.
CALL_ORDER = {"create": 0, "perform": 1, "cancel": 2}
#: Reason of a cancellation by time (fixed value).
TIMED_OUT = 4
ENTRY = ("payme_id", "amount", "state", "created", "performed", "cancelled", "reason", "refused", "revoked")
BOOK = "user_id string, payme_id string, amount long, state int, created long, performed long, cancelled long, reason int, refused int, revoked boolean"


def in_order(calls: list[dict]) -> list[dict]:
    return sorted(calls, key=lambda c: (c["at"], CALL_ORDER[c["method"]], c["payme_id"], c["amount"] or 0, c["reason"] or 0))


def expire(book: dict[str, dict], now: int, timeout: int = DEFAULT.payment_timeout_ms) -> list[dict]:
    """Cancel what is open for longer than the time-out before ``now``; returns the entries that changed."""
    late = [e for e in book.values() if e["state"] == 1 and now > e["created"] + timeout]
    for e in late:
        e.update(state=-1, cancelled=e["created"] + timeout, reason=TIMED_OUT)
    return late


def apply(book: dict[str, dict], call: dict, price: int = DEFAULT.price_tiyin, timeout: int = DEFAULT.payment_timeout_ms) -> list[dict]:
    """Apply a call (payme_id, method, amount, at, reason) to a user's book; returns the entries that changed.

    Repeated calls change nothing; what is not allowed is counted.
    """
    changed = expire(book, call["at"], timeout)
    e = book.get(call["payme_id"])
    if e is None:
        e = book[call["payme_id"]] = dict(zip(ENTRY, (call["payme_id"], None, 0, 0, 0, 0, None, 0, False)))
    method, refused = call["method"], False
    if method == "create":
        if e["state"] == 0:
            refused = call["amount"] != price or any(o["state"] == 1 for o in book.values())
            if not refused:
                e.update(state=1, created=call["at"], amount=call["amount"])
        else:
            refused = call["amount"] != e["amount"]
    elif method == "perform":
        if e["state"] == 1:
            e.update(state=2, performed=call["at"])
        else:
            refused = e["state"] <= 0
    elif e["state"] in (1, 2):
        e.update(revoked=e["state"] == 2, state=-e["state"], cancelled=call["at"], reason=call["reason"])
    else:
        refused = e["state"] == 0
    e["refused"] += refused
    return [x for x in changed if x is not e] + [e]


def books(calls: DataFrame, until: int | None = None, price: int = DEFAULT.price_tiyin, timeout: int = DEFAULT.payment_timeout_ms) -> DataFrame:
    """BOOK rows after a table of calls (user_id, payme_id, method, amount, at in epoch ms, reason); open payments are
    timed out as of ``until``.

    A fold for each user, whose calls are few.
    """

    def fold(key, rows):
        import pandas as pd

        book: dict[str, dict] = {}
        plain = rows.astype(object).where(rows.notna(), None)
        for call in in_order(plain.to_dict("records")):
            apply(book, call, price, timeout)
        if until is not None:
            expire(book, until, timeout)
        out = [(key[0], *(e[c] for c in ENTRY)) for e in book.values()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in BOOK.split(", ")]).astype({"amount": "Int64", "reason": "Int64"})

    return calls.where("user_id IS NOT NULL AND payme_id IS NOT NULL AND at IS NOT NULL").groupBy("user_id").applyInPandas(fold, BOOK)


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each payment of a stream of changes (BOOK and n, the number of the change in its user's book)."""
    columns = [c.split()[0] for c in BOOK.split(", ")]
    last = F.max_by(F.struct(*columns), "n").alias("row")
    return changes.groupBy("user_id", F.col("payme_id").alias("_p")).agg(last).select("row.*")
