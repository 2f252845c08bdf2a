"""Packing documents into fixed-length sequences by cutting-stock column generation.

The linear program has one row for each length class (a class covers ``unit`` lengths, so
its size depends on the sequence length only, not on the corpus) and one column for each
pattern of classes that fits a sequence.  An unbounded knapsack over the duals prices new
columns.  The solution is rounded down, what is left of the demand is packed greedily, and
the documents of each class, ranked by a seeded hash, take the slots of the patterns in
order.  The driver sees the length histogram only.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ._common import cut, running_sum, small_batches
from .tokens import documents, encoder


@dataclass(frozen=True)
class CuttingStockConfig:
    tokenizer: str = ""
    #: Whether the file's added tokens in a text are their own ids, not ordinary text.
    markers: bool = False
    length: int = 2048
    end_id: int = 1
    #: Lengths in a class; a sequence loses less than this for each of its pieces.
    unit: int = 4
    seed: int = 0
    #: Relative gap to the lower bound at which the program ends.
    gap: float = 1e-3


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items of total size <= capacity: (value, count of each item)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    for c in range(1, capacity + 1):
        fits = int(np.searchsorted(s, c, side="right"))
        best[c] = best[c - 1]
        if fits:
            got = best[c - s[:fits]] + v[:fits]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], last[c] = got[k], order[k]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def greedy(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], list[int]]:
    """Patterns filled with the largest sizes that still fit, each used as often as the demand allows, until it is met."""
    left, order = demand.astype(np.int64).copy(), np.argsort(-sizes, kind="stable")
    patterns, counts = [], []
    while left.any():
        pattern, free = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in order:
            if left[k] and sizes[k] <= free:
                pattern[k] = min(int(left[k]), free // int(sizes[k]))
                free -= int(pattern[k] * sizes[k])
        has = pattern > 0
        counts.append(int((left[has] // pattern[has]).min()))
        left -= counts[-1] * pattern
        patterns.append(pattern)
    return patterns, counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: counts of each size) and how often each is used, covering ``demand`` exactly.

    Revised simplex.  Greedy patterns are priced first; when none of them improves the program,
    ``knapsack`` prices new ones.  It ends when the program is within ``gap`` of a lower bound:
    the room that the demand fills, or the best bound that the duals of any step have given.
    Pricing looks between the present duals and those of the best bound, which keeps it from
    swinging, and at the present ones where that finds nothing.  Then rounding down, and greedy
    patterns for what is left.
    """
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
    pool = np.array(greedy(sizes, demand, capacity)[0]).T
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    bound, best = float(sizes @ demand) / capacity, sizes / capacity
    while x.sum() - bound > gap * x.sum():
        dual = inverse.sum(axis=0)
        worth = dual @ pool
        if worth.max() > 1 + 1e-7:
            column = pool[:, int(worth.argmax())]
        else:
            column = None
            for weight in (0.7, 0.0):
                asked = np.maximum(weight * best + (1 - weight) * dual, 0)
                value, found = knapsack(asked, sizes, capacity)
                # Duals divided by their dearest pattern's value are feasible.
                if asked @ demand / max(value, 1e-12) > bound:
                    bound, best = float(asked @ demand) / value, asked / value
                if dual @ found > 1 + 1e-7:
                    column = found
                    break
            if column is None:
                break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = max(ratio[leave], 0.0)
        x = x - step * direction
        x[leave] = step
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        basis[:, leave] = column
    used = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    left = demand.astype(np.int64) - basis @ used
    for k in np.flatnonzero(used):  # rounding may cover too much by an error of the floats
        while used[k] and (left < 0)[basis[:, k] > 0].any():
            used[k] -= 1
            left += basis[:, k]
    more, times = greedy(sizes, left, capacity)
    kept = np.flatnonzero(used)
    return np.array([*basis[:, kept].T, *more]), np.array([*used[kept], *times])


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, config: CuttingStockConfig) -> DataFrame:
    """Every document cut at multiples of ``length``, with a digest of each piece's ids; ids stay where they are made."""
    small_batches(docs.sparkSession)
    get, length, end_id = encoder(docs.sparkSession, config.tokenizer, config.markers), config.length, config.end_id

    def run(batches):
        import pyarrow as pa

        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            rows.clear()
            return out

        for doc_id, ids in documents(batches, get, end_id):
            for start in range(0, len(ids), length):
                piece = ids[start : start + length]
                rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if len(rows) >= 10_000:
                yield flush()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def packed_pieces(docs: DataFrame, config: CuttingStockConfig) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text, any more).

    A document is its token ids and ``end_id`` (null or empty text: ``end_id`` alone).  Pieces
    of a sequence follow each other without gaps from offset 0 and total at most ``length``.
    Repeated rows are packed as often as they occur; a null doc_id is carried as null; no rows,
    no result.
    """
    unit, capacity = config.unit, config.length // config.unit
    cut_up = cut(pieces(docs, config).withColumn("size", F.ceil(F.col("length") / unit).cast("int")))
    # At most ``capacity`` rows come here.
    histogram = sorted((r["size"], r["count"]) for r in cut_up.groupBy("size").count().collect())
    sizes, demand = (np.array([h[i] for h in histogram], dtype=np.int64) for i in (0, 1))
    patterns, counts = solve(sizes, demand, capacity, config.gap)
    base = np.cumsum([0, *counts])
    segments = {}
    for k, s in enumerate(sizes):
        has = np.flatnonzero(patterns[:, k])
        segments[int(s)] = (np.cumsum([0, *(patterns[has, k] * counts[has])]), base[has], patterns[has, k])

    ranked = cut_up.withColumn("one", F.lit(1)).withColumn("order", F.xxhash64(F.lit(config.seed), "doc_id", "start"))
    ranked = running_sum(ranked, "size", ["order", "doc_id", "start"], "one", "rank")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            sequence, slot = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                of = size == s
                starts, first, each = segments[int(s)]
                k = np.searchsorted(starts, rank[of], side="right") - 1
                sequence[of] = first[k] + (rank[of] - starts[k]) // each[k]
                slot[of] = (rank[of] - starts[k]) % each[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], batch.column("size"), pa.array(sequence), pa.array(slot)], names=[*columns, "size", "sequence_id", "slot"])

    placed = ranked.select(*columns, "size", "rank").mapInArrow(place, f"{PIECE}, size int, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
