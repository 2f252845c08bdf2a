"""A contract in its numbered clauses, with their places, what they stand in, and what calls for a look."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.answers import red_flags

# What begins a clause, at the beginning of a line.
NUMBERED = r"\d+(?:\.\d+)*\s*[.)]"
TITLED = r"[IVXLC]+\s*\.|Статья|Modda|Article"
CUT = rf"\n(?=\s*(?:{NUMBERED}|{TITLED}))"
#: Characters of a clause at least for it to be looked at (fixed value).
LEAST = 40


def clauses(docs: DataFrame) -> DataFrame:
    """doc_id, ix, start, text, number, level, parent of each clause of docs (doc_id, text).

    The text is cut at the newlines before a number or a title; the clauses of a document,
    joined by newlines, are its text, and ``start`` counts the characters before one.  level is
    0 for titles and for what stands before the first number, else the parts of the number;
    parent is the ix of the nearest clause before whose number is the own one without its last
    part (for a number of one part: the nearest title), null if there is none.  Null texts have
    no clause, an empty one has one; repeated rows are cut each by itself.
    """
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    parts = numbered.select("row", "doc_id", F.posexplode(F.split("text", CUT)).alias("ix", "text"))
    before = Window.partitionBy("row").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    number = F.nullif(F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)\s*[.)]", 1), F.lit(""))
    titled = number.isNull() & F.col("text").rlike(rf"^\s*(?:{TITLED})")
    rows = parts.withColumn("start", start).withColumn("number", number).withColumn("titled", titled)
    rows = rows.withColumn("level", F.when(F.col("number").isNull(), 0).otherwise(F.size(F.split("number", "\\."))))
    # A clause is found under its number (titles under #) and looks for the number above it.
    under = F.when(F.col("titled"), "#").otherwise(F.col("number"))
    above = F.when(F.col("level") == 1, "#").when(F.col("level") > 1, F.regexp_replace("number", r"\.\d+$", ""))
    keys = F.array_compact(F.array(F.when(under.isNotNull(), F.struct(under.alias("key"), F.lit(1).alias("is"))), F.when(above.isNotNull(), F.struct(above.alias("key"), F.lit(0).alias("is")))))
    seen = rows.select("row", "ix", F.explode(keys).alias("k")).select("row", "ix", "k.key", "k.is")
    last = F.last(F.when(F.col("is") == 1, F.col("ix")), ignorenulls=True).over(Window.partitionBy("row", "key").orderBy("ix", "is").rowsBetween(Window.unboundedPreceding, -1))
    parents = seen.withColumn("parent", last).where("is = 0 AND parent IS NOT NULL").select("row", "ix", "parent")
    return rows.join(parents, ["row", "ix"], "left").select("doc_id", "ix", "start", "text", "number", "level", "parent")


def flagged(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, ix, number, start, code, excerpt of the flags of clauses of more than ``least`` characters."""
    plain = F.trim(F.regexp_replace("text", "\\s+", " "))
    return rows.where(F.length(plain) > least).select("doc_id", "ix", "number", "start", F.explode(red_flags(F.col("text"))).alias("f")).select("doc_id", "ix", "number", "start", "f.code", "f.excerpt")
