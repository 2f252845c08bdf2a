"""Vector best-fit packing: tokens, documents and attention cost of a sequence are capacities of one bin.

A piece of length n asks for the vector (n, 1, n * n).  Pieces of equal length are alike and so
are bins that hold the same lengths, so the plan works on counts: the driver sees the histogram
of lengths (``length`` rows at most), goes through it from the longest on, and keeps groups of
alike bins, each with its residual vector.  A piece goes into the group that takes it under
every constraint and scores best, by the weighted norm of what would be left or by the weighted
dot product of demand and residual; a new bin is opened only where none takes it.  Both rules
are tried and the plan of fewest bins is used.  The number of groups depends on ``length``
only, never on the corpus.  Then the pieces of each length, ranked by a seeded hash, take the
places of the plan in order; a piece's offset follows from its place, so ranking is the only
shuffle.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ._common import cut, running_sum, small_batches
from .chunk_tokens import chunk_encoder


@dataclass(frozen=True)
class VectorPackingConfig:
    #: A ``tokenizers`` JSON file whose pre-tokenizer drops white space.
    tokenizer: str = ""
    length: int = 2048
    end_id: int = 0
    #: Pieces in a sequence, and sum of squared lengths, at most; None: what ``length`` implies.
    documents: int | None = None
    attention: int | None = None
    #: Rules that are tried: ``norm`` (least residual) and ``dot`` (best aligned).
    rules: tuple[str, ...] = ("norm", "dot")
    seed: int = 0

    @property
    def capacity(self) -> np.ndarray:
        documents = self.length if self.documents is None else self.documents
        attention = self.length**2 if self.attention is None else self.attention
        if min(self.length, documents, attention) < 1:
            raise ValueError("capacities must be positive")
        return np.array([self.length, documents, attention], dtype=np.int64)

    @property
    def piece(self) -> int:
        """Tokens of a piece at most: a piece must fit a sequence by itself."""
        return min(self.length, math.isqrt(int(self.capacity[2])))


def demand_of(size: int) -> np.ndarray:
    return np.array([size, 1, size * size], dtype=np.int64)


@dataclass
class Plan:
    """Groups of alike bins: what each bin holds (length -> count, longest first) and how many bins there are."""

    patterns: list[dict[int, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(self.counts)


def vector_best_fit(histogram: dict[int, int], capacity: np.ndarray, rule: str) -> Plan:
    """Best fit decreasing over {length: count}, as if piece by piece."""
    total = sum((demand_of(s) * n for s, n in histogram.items()), np.zeros(3, dtype=np.int64)).astype(float)
    # A constraint weighs as much as the whole demand asks of it.
    weight = total / capacity / max((total / capacity).sum(), 1e-300)
    patterns: list[dict[int, int]] = []
    counts = np.zeros(64, dtype=np.int64)
    left = np.zeros((64, 3), dtype=np.int64)
    place: dict[tuple, int] = {}

    def add(pattern: dict[int, int], residual: np.ndarray, n: int) -> None:
        nonlocal counts, left
        key = tuple(pattern.items())
        if key not in place:
            if len(patterns) == len(counts):
                counts, left = np.concatenate([counts, 0 * counts]), np.concatenate([left, 0 * left])
            place[key] = len(patterns)
            patterns.append(pattern)
            left[place[key]] = residual
        counts[place[key]] += n

    def put(k: int | None, size: int, n: int, each: int) -> None:
        """``each`` more pieces go into ``n`` bins of group k, or into new ones."""
        if n and each:
            before, residual = (patterns[k], left[k]) if k is not None else ({}, capacity)
            if k is not None:
                counts[k] -= n
            add({**before, size: before.get(size, 0) + each}, residual - each * demand_of(size), n)

    for size in sorted(histogram, reverse=True):
        need, todo = demand_of(size), int(histogram[size])
        if (need > capacity).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        while todo:
            some = np.flatnonzero((counts[: len(patterns)] > 0) & (left[: len(patterns)] >= need).all(axis=1))
            if not len(some):
                each = int((capacity // need).min())
                put(None, size, todo // each, each)
                put(None, size, 1, todo % each)
                break
            residual = left[some] / capacity
            ask = need / capacity
            if rule == "norm":
                k = int(some[np.argmin((weight * (residual - ask) ** 2).sum(axis=1))])
                # A bin that has taken a piece is nearer to full than all others, so it takes the next ones too.
                each = int((left[k] // need).min())
            else:
                k = int(some[np.argmax((weight * residual * ask).sum(axis=1))])
                each = 1
            n = min(int(counts[k]), todo // each)
            if n:
                put(k, size, n, each)
                todo -= n * each
            elif todo:
                put(k, size, 1, todo)
                todo = 0
    has = np.flatnonzero(counts[: len(patterns)])
    return Plan([patterns[k] for k in has], [int(counts[k]) for k in has])


def best_plan(histogram: dict[int, int], config: VectorPackingConfig) -> Plan:
    return min((vector_best_fit(histogram, config.capacity, rule) for rule in config.rules), key=lambda p: p.bins)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, config: VectorPackingConfig) -> DataFrame:
    """Documents in pieces, with a digest of each piece's ids; ids stay where they are made."""
    small_batches(docs.sparkSession)
    get, longest, end_id = chunk_encoder(docs.sparkSession, config.tokenizer), config.piece, config.end_id

    def run(batches):
        import pyarrow as pa

        encode = get()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for row, ids, ends in encode(batch.column(1)):
                raw, rows, at = memoryview(ids.tobytes()), [], 0
                for k, to in enumerate(ends.tolist()):
                    n = to - at + 1
                    for number, start in enumerate(range(0, n, longest)):
                        size = min(longest, n - start)
                        last = start + size == n
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + size - last)])
                        rows.append((numbers[row + k], number, start, size, zlib.crc32(end, crc) if last else crc))
                    at = to
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def vector_packed(docs: DataFrame, config: VectorPackingConfig) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text, any more).

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone.  Only
    documents of more than ``length`` tokens are cut (of more than the root of ``attention``,
    where that is less), so very long texts are many full pieces and a last one.  The pieces of a
    sequence follow each other without gaps from offset 0, longest first, and keep all
    capacities.  Repeated rows are packed as often as they occur and may change places with each
    other; a null doc_id is carried as null; further columns, whatever their names, are not
    read; no rows, no result.
    """
    cut_up = cut(pieces(docs, config))
    # One row for each length: at most ``length`` rows come to the driver.
    histogram = {int(r["length"]): r["count"] for r in cut_up.groupBy("length").count().collect()}
    plan = best_plan(histogram, config)
    first = np.cumsum([0, *plan.counts])
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for k, pattern in enumerate(plan.patterns):
        offset = 0
        for size, each in pattern.items():
            places.setdefault(size, []).append((plan.counts[k] * each, int(first[k]), each, offset))
            offset += size * each
    # For each length: pieces before each stretch of places, its first sequence, places in a sequence, offset of the first.
    spots = {s: (np.cumsum([0, *(x[0] for x in rows)]), *(np.array([x[i] for x in rows], dtype=np.int64) for i in (1, 2, 3))) for s, rows in places.items()}

    ranked = cut_up.withColumn("one", F.lit(1)).withColumn("order", F.xxhash64(F.lit(config.seed), "doc_id", "start"))
    ranked = running_sum(ranked, "length", ["order", "doc_id", "start", "ids_crc32"], "one", "rank")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                of = size == s
                starts, opening, each, at = spots[int(s)]
                k = np.searchsorted(starts, rank[of], side="right") - 1
                n = rank[of] - starts[k]
                sequence[of] = opening[k] + n // each[k]
                offset[of] = at[k] + n % each[k] * s
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, f"{PIECE}, sequence_id long, offset long")
