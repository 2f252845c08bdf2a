"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one
bit for each failed rule.  A policy is a named, versioned mask over those bits, so changing a
policy, comparing two, or asking what a rule alone costs never reads a text again.
Everything is SQL expressions over one row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ._common import SEPARATOR_RUN, SEPARATORS, let

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements; true sets ``bit``."""

    bit: int
    name: str
    failed: str


#: Bits keep their meaning for ever; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "capitals", "100 * n_capitals > 50 * word_chars"),
    Rule(7, "shouting", "10 * n_exclamations > 3 * n_words"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = (Policy("base-1", BASE), Policy("strict-1", 0b11111111))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: sort the windows' hashes, keep those
    equal to a neighbour, count the positions that they cover."""

    def of(n: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            spans = F.transform(found, lambda j: F.array(F.get(s, j)["i"], F.get(s, j)["i"] + 1, F.get(s, j)["i"] + 2))
            return F.size(F.array_distinct(F.flatten(spans)))

        return F.when(n >= 3, let(F.sort_array(windows), covered)).otherwise(F.lit(0))

    return let(F.size(words), of)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed`` (bits) of every row of docs (doc_id, text, any more).

    Words are runs of characters other than space and U+0009..U+000D.  A null text is like an
    empty one: all measurements 0, which fails ``few_words``.  Repeated rows are measured as
    often as they occur; a null doc_id is carried; an empty table gives an empty ledger.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    solid = lambda c: F.length(F.translate(c, SEPARATORS, ""))
    words = F.filter(F.split(text, SEPARATOR_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: solid(x) > 0)

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    by_word = let(words, counted)
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        by_word.alias("w"),
        by_line.alias("l"),
        solid(text).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        _removed(text, CAPITALS).cast("long").alias("n_capitals"),
        _removed(text, "!").cast("long").alias("n_exclamations"),
    )
    rows = rows.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_exclamations")
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def judged(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail only it, and that would be kept without it.

    Ledger rows fold by bit pattern first (at most 2**rules groups), so nothing but counts is shuffled.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    inside = [r for r in RULES if policy.mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in inside]))
    rows = patterns.select("failed", "n", each.alias("r")).select("failed", "n", "r.*")
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return rows.groupBy("rule").agg(
        n(F.col("failed").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        n(masked == F.col("bit"))("n_only"),
        n(masked.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
    )
