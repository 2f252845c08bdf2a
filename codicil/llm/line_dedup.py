"""Removing repeated passages by overlapping windows of three lines.

Each document's windows of three consecutive lines are hashed; a window found more than once
over all documents keeps its first occurrence (by doc_id, then position), and the lines that
later occurrences cover are removed.  The earliest copy of a line is never removed: a line goes
only if the same line stands earlier, inside the first occurrence of its window.
SQL expressions, one aggregation and one join of the windows, one join back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ._common import SEPARATORS, cut, let


@dataclass(frozen=True)
class LineDedupConfig:
    #: Positions of removed windows that may be sent to every executor; beyond it, a shuffle join.
    broadcast_positions: int = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), pos, h1, h2 of every three-line window with a word."""

    def of(lines: Column) -> Column:
        def window(i: Column) -> Column:
            three = [F.get(lines, i), F.get(lines, i + 1), F.get(lines, i + 2)]
            solid = F.length(F.translate(F.concat(*three), SEPARATORS, "")) > 0
            return F.when(solid, F.struct(i.alias("pos"), F.xxhash64(*three).alias("h1"), F.hash(*three).alias("h2")))

        n = F.size(lines)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window))

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row"), let(_lines(F.col("text")), of).alias("w"))
    rows = rows.select("doc_id", "row", F.explode("w").alias("w")).where("w is not null")
    return rows.select("doc_id", "row", "w.pos", "w.h1", "w.h2")


def line_deduplicated(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """docs (doc_id, text, any more) with the text left, n_lines and n_removed.

    Lines end at a newline.  Texts of fewer than three lines and windows without a word are
    left alone; a null text stays null with 0 lines; a text may become empty.  Documents with
    a null doc_id come first in the order.  Rows equal in doc_id and text are one document: they
    are not held against each other, and lose the same lines.  Columns n_lines and n_removed of
    docs are replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = cut(windows(docs.select("doc_id", "text")))
    place = F.struct("doc_id", "pos", "row")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = cut(first.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first"))
    later = found.join(first, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(place > F.col("first"))
    gone = later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("positions"))
    gone = cut(gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "positions"))
    size = gone.agg(F.sum(F.size("positions") + 4)).first()[0] or 0
    gone = F.broadcast(gone) if size <= config.broadcast_positions else gone
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")

    def left(lines: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform("positions", lambda p: F.array(p, p + 1, p + 2))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(kept).alias("n"))

    rows = rows.withColumn("_n", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)))
    rows = rows.withColumn("_left", F.when(F.col("positions").isNotNull(), let(_lines(F.col("text")), left)))
    others = [c for c in docs.columns if c != "text"]
    text = F.when(F.col("positions").isNotNull(), F.col("_left.text")).otherwise(F.col("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("_n")).cast("long")
    return rows.select(*others, text.alias("text"), n.alias("n_lines"), F.coalesce(n - F.col("_left.n"), F.lit(0)).cast("long").alias("n_removed"))
