"""Packed token-id matrices by best-fit-decreasing within blocks of a partition."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ._common import small_batches
from .tokens import documents, encoder


@dataclass(frozen=True)
class TokenPackingConfig:
    #: A ``tokenizers`` JSON file of a byte-level BPE vocabulary.
    tokenizer: str = ""
    #: Whether the file's added tokens in a text are their own ids, not ordinary text.
    markers: bool = False
    #: Tokens in a row of the matrix.
    length: int = 2048
    #: Id that ends a document, and id that fills a row.
    end_id: int = 50256
    pad_id: int = 50256
    #: Tokens gathered before they are packed and written: the memory of a task.
    block_tokens: int = 1 << 21


class CapacityTree:
    """A segment tree over free capacities: the fullest open bin that still takes a size, in O(log length)."""

    def __init__(self, length: int):
        self.leaves = 1
        while self.leaves <= length:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += by
            at //= 2

    def put(self, free: int, bin_: int) -> None:
        if free > 0:
            self.bins[free].append(bin_)
            self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (free, bin) of least free >= size."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at % 2 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of at most ``length``, each a list of indexes into ``sizes`` (each 1..length)."""
    tree, out = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if (found := tree.take(sizes[i])) is None:
            found = (length, len(out))
            out.append([])
        out[found[1]].append(i)
        tree.put(found[0] - sizes[i], found[1])
    return out


PACKED = "sequence_id long, n_tokens int, input_ids array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def packed_tokens(docs: DataFrame, config: TokenPackingConfig) -> DataFrame:
    """Rows of ``length`` token ids, from docs (doc_id, text, any more columns).

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone.  A longer
    one is cut every ``length`` ids, without loss: piece k of doc_ids[k] begins at its id
    starts[k].  input_ids is padded to ``length``; cu_seqlens are the ends of the segments, from
    0; position_resets are the offsets at which positions start again from 0.  Each task packs
    its own blocks of ``block_tokens`` ids, so there is no shuffle and memory is bounded by a
    block plus one document; sequence_id holds the partition above its running number.  Repeated
    rows are packed as often as they occur; a null doc_id is carried as null.  No rows, no result.
    """
    small_batches(docs.sparkSession)
    get, length, end_id, pad_id, block = encoder(docs.sparkSession, config.tokenizer, config.markers), config.length, config.end_id, config.pad_id, config.block_tokens

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def lists(values, type_):
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], type_))

        def flush(pieces):
            nonlocal number
            bins = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for at in range(0, len(bins), 512):
                some = bins[at : at + 512]
                matrix = np.full((len(some), length), pad_id, dtype=np.int32)
                ends, docs_, starts = [], [], []
                for row, bin_ in zip(matrix, some):
                    cum = [0]
                    for i in bin_:
                        row[cum[-1] : cum[-1] + len(pieces[i][2])] = pieces[i][2]
                        cum.append(cum[-1] + len(pieces[i][2]))
                    ends.append(cum)
                    docs_.append([pieces[i][0] for i in bin_])
                    starts.append([pieces[i][1] for i in bin_])
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * length), pa.array(matrix.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(some))), pa.array([e[-1] for e in ends], pa.int32()), ids, lists(ends, pa.int32()), lists([e[:-1] for e in ends], pa.int32()), lists(docs_, pa.int64()), lists(starts, pa.int64())],
                    names=["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "starts"],
                )
                number += len(some)

        pieces, size = [], 0
        for doc_id, ids in documents(batches, get, end_id):
            for start in range(0, len(ids), length):
                pieces.append((doc_id, start, ids[start : start + length]))
                size += len(pieces[-1][2])
                if size >= block:
                    yield from flush(pieces)
                    pieces, size = [], 0
        if pieces:
            yield from flush(pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)


def unpacked_tokens(packed: DataFrame) -> DataFrame:
    """doc_id, start, ids of every piece again: the inverse of packing, for checks and readers."""
    k = F.posexplode(F.sequence(F.lit(0), F.size("doc_ids") - 1))
    rows = packed.select("*", k.alias("k", "_"))
    at, to = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return rows.select(F.get("doc_ids", F.col("k")).alias("doc_id"), F.get("starts", F.col("k")).alias("start"), F.slice("input_ids", at + 1, to - at).alias("ids"))
