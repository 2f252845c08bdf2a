"""Which texts hold which needles, by an inverted index of the needles' rarest q-grams.

A needle that stands in a text has all its q-grams there, so texts and needles meet by equality
on one gram of the needle, the rarest among the texts, and what meets is verified.  No needle is
compared with a text that lacks its gram, and there is no nested loop.  A needle of fewer than q
characters is its own gram, so for those an equality is all there is.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import normalize
from ..functions.translit import cyrillic_to_latin
from ..session import small

#: Grams of needles that are sent to every executor at most.
SENT = 500_000


def grams(text: Column, q: int) -> Column:
    """Distinct runs of ``q`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def held(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", q: int = 3, counted: bool = True) -> DataFrame:
    """The columns of texts and needles for each pair in which the text holds the needle.

    Both sides' other columns must differ in name.  Null and empty needles are in no text;
    repeated rows pair as often as they occur.  With ``counted`` grams are ranked by the texts
    that hold them, else by the needles, which spares a pass over the texts.
    """
    names = [c for c in needles.columns if c != needle]
    size = F.least(F.length(needle), F.lit(q))
    distinct = needles.where(F.length(needle) > 0).select(F.col(needle).alias("_needle")).distinct()
    parts = F.when(F.length("_needle") < q, F.array("_needle")).otherwise(grams(F.col("_needle"), q))
    own = distinct.select("_needle", F.explode(parts).alias("_gram"))
    sizes = sorted(r[0] for r in needles.where(F.length(needle) > 0).select(size).distinct().collect())  # at most q numbers
    if not sizes:
        return texts.join(needles.where("false"), F.lit(True)).select(*texts.columns, *needles.columns)
    every = F.flatten(F.array(*[grams(F.col(text), n) for n in sizes]))
    if counted:
        wanted = small(own.select("_gram").distinct(), SENT)
        often = texts.select(F.explode(every).alias("_gram")).join(wanted, "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_often"))
        ranked = own.join(often, "_gram", "left")
    else:
        ranked = own.join(own.groupBy("_gram").agg(F.count("*").alias("_often")), "_gram")
    rarest = ranked.groupBy("_needle").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_gram")).alias("_r")).select("_needle", F.col("_r._gram").alias("_gram"))
    meeting = texts.withColumn("_gram", F.explode(every)).join(small(rarest, SENT), "_gram").where(F.contains(text, "_needle")).drop("_gram")
    if not names:
        return meeting.join(needles.withColumnRenamed(needle, "_n"), F.col("_needle") == F.col("_n")).select(*texts.columns, F.col("_needle").alias(needle))
    return meeting.join(needles.withColumnRenamed(needle, "_n"), F.col("_needle") == F.col("_n")).select(*texts.columns, F.col("_needle").alias(needle), *names)


def acts_by_name(names: DataFrame, acts: DataFrame, limit: int = 5) -> DataFrame:
    """name_id, act_id, pos: the acts in force whose short name or a title holds a name.

    names: name_id, name; acts: act_id, short_name, title_uz, title_ru, title_en, status.  The
    normal form of a name is looked for in the titles as they are stored, both in lower case; the
    Uzbek title may also hold the name's Latin spelling.  The shortest name or title that holds it comes first, then the
    smallest id.  A name without characters names no act.
    """
    plain = F.lower(normalize(F.col("name")))
    forms = F.array_distinct(F.array(F.struct(plain.alias("needle"), F.lit(False).alias("latin")), F.struct(F.lower(cyrillic_to_latin(normalize(F.col("name")))).alias("needle"), F.lit(True).alias("latin"))))
    needles = names.select("name_id", F.explode(forms).alias("f")).select("name_id", "f.needle", "f.latin")
    fields = F.array(*[F.struct(F.lit(c == "title_uz").alias("uzbek"), F.lower(F.col(c)).alias("text")) for c in ("short_name", "title_uz", "title_ru", "title_en")])
    titles = acts.where(F.col("status").isin("in_force", "amended")).select("act_id", F.explode(fields).alias("t")).select("act_id", "t.uzbek", "t.text").where("text IS NOT NULL")
    found = held(titles, needles).where("NOT latin OR uzbek")
    best = found.groupBy("name_id", "act_id").agg(F.min(F.length("text")).alias("length"))
    order = Window.partitionBy("name_id").orderBy("length", "act_id")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("name_id", "act_id", "pos")


def by_article(asked: DataFrame, acts: DataFrame, chunks: DataFrame, acts_most: int = 3, limit: int = 20) -> DataFrame:
    """name_id, chunk_id, act_id, pos: the chunks of an article of the acts that a name means.

    asked: name_id, name, article_number; chunks: chunk_id, act_id, article_number, ordinal.
    """
    meant = acts_by_name(asked.select("name_id", "name"), acts, acts_most)
    wanted = asked.select("name_id", "article_number").join(meant.withColumnRenamed("pos", "act_pos"), "name_id")
    found = wanted.join(chunks.select("chunk_id", "act_id", "article_number", "ordinal"), ["act_id", "article_number"])
    order = Window.partitionBy("name_id").orderBy("act_pos", "ordinal", "chunk_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("name_id", "chunk_id", "act_id", "pos")
