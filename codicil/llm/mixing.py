"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Each source may be seen ``epochs`` times at most.  Its share is its weight times a common
level; sources above their cap are clamped to it and the level rises for the rest until no
source is above.  A source's documents are taken as often as whole epochs fit its target, and
those that come first in a seeded order once more; a second, shorter walk of the order fills
the gap before a document too long for it, up to the nearest document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ._common import SEPARATOR_RUN, aside, attach, cut, running_sum


def ranked_weights(rank: Column) -> Column:
    """1, 2, 3, repeating, by the rank of the source among all by code point, null last."""
    return F.lit(1) + rank % 3


@dataclass(frozen=True)
class MixConfig:
    epochs: int = 3
    seed: int = 17
    #: Whether the last document of a source's seeded order may be taken in part (its first
    #: words), which meets the target to a word; else whole documents come nearest to it.
    partial: bool = False
    #: Weight of a source from its rank (from 0).
    weight: Callable[[Column], Column] = ranked_weights


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the source's key (never null), the size in words and the place in the seeded order."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    place = F.struct(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text"), size.alias("words"))
    return docs.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).withColumn("_size", size).withColumn("_place", place)


_PLACE = "struct<hash:bigint,id:bigint,text:bigint,words:bigint>"


def mix_plan(docs: DataFrame, config: MixConfig) -> DataFrame:
    """One row for each source: _key, source_size, target, _whole (epochs), and what is taken once more:
    the places up to _last (of each row there, _rest words at most), and of those up to _last2 the
    documents of at most _fit words.
    """
    sized = cut(_keyed(docs.select("doc_id", "text", "source"), config.seed).select("_key", "source", "_size", "_place"))
    sources = sized.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    sources = sources.withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    sources = running_sum(sources, "all", ["source"], "one", "rank")
    sources = cut(sources.select("_key", "source_size", config.weight(F.col("rank")).cast("double").alias("weight"), (F.col("source_size") * config.epochs).cast("double").alias("cap")))
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    # Each round reads four sums; clamped sources stay clamped as the level only rises.
    level, clamped = (total / weights if weights else 0.0), -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free, n = sources.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == clamped or not free:
            break
        level, clamped = (total - (capped or 0.0)) / free, n
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    plan = sources.select("_key", "source_size", target.alias("target"), whole.cast("int").alias("_whole"))
    plan = cut(plan.withColumn("_words", F.col("target") - F.col("_whole") * F.col("source_size")))
    place = F.struct("hash", "id", "text", F.col("_size").alias("words"))
    rows = sized.select("_key", "_size", F.col("_place.hash").alias("hash"), F.col("_place.id").alias("id"), F.col("_place.text").alias("text"))
    order = ["hash", "id", "text", "_size"]
    if config.partial:
        # Equal rows can't be told apart: they stand at one place and share what is taken there.
        rows = rows.where("_size > 0").groupBy("_key", *order).agg(F.count("*").alias("equal")).withColumn("_all", F.col("_size") * F.col("equal"))
        summed = attach(running_sum(rows, "_key", order, "_all", "before"), plan.select("_key", "_words"), ["_key"], "inner")
        words = F.round("_words").cast("long")
        rest = F.floor((words - F.col("before")) / F.col("equal")).cast("long")
        last = summed.where(F.col("before") < words).groupBy("_key").agg(F.max(F.struct(place.alias("at"), rest.alias("rest"))).alias("l"))
        none = [F.lit(None).cast("long").alias("_fit"), F.lit(None).cast(_PLACE).alias("_last2")]
        return cut(plan.join(last, "_key", "left").select("_key", "source_size", "target", "_whole", F.col("l.at").alias("_last"), F.col("l.rest").alias("_rest"), *none))
    summed = attach(running_sum(rows, "_key", order, "_size", "before"), plan.select("_key", "_words"), ["_key"], "inner")
    first = summed.where(F.col("before") + F.col("_size") <= F.col("_words")).groupBy("_key").agg(F.max(place).alias("_last"), F.max(F.col("before") + F.col("_size")).alias("_sum"))
    plan = plan.join(first, "_key", "left").withColumn("_fit", F.col("_words") - F.coalesce("_sum", F.lit(0)))
    plan = cut(plan.drop("_words", "_sum"))
    # A long document may leave a gap: shorter ones that come later in the order fill it.
    rest = attach(rows, plan.select("_key", "_last", "_fit"), ["_key"], "inner").where(~F.coalesce(place <= F.col("_last"), F.lit(False)) & (F.col("_size") <= F.col("_fit")))
    summed = attach(running_sum(rest.select("_key", *order), "_key", order, "_size", "before"), plan.select("_key", "_fit"), ["_key"], "inner")
    second = summed.where(2 * F.col("before") + F.col("_size") <= 2 * F.col("_fit")).groupBy("_key").agg(F.max(place).alias("_last2"))
    return cut(plan.join(second, "_key", "left").withColumn("_rest", F.lit(None).cast("long")))


def mixed(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """docs (doc_id, text, source, any more) with size, source_size, target, copies, words_more, taken.

    size counts words (runs of characters other than space and U+0009..U+000D; null text: 0);
    target is the source's share of all words; copies is how often the whole document is taken,
    words_more how many of its first words once more, and taken the words that makes.  A null source is a source.  Rows equal in doc_id and text stand at the same place of the
    seeded order and are taken alike: with ``partial`` they share the words taken there, so a
    source misses its target by less than one word for each of them; without it, all or none of
    them are taken once more.  A source of empty texts has target 0; long texts count whole.  Columns of
    docs with the names of the new ones are replaced.  An empty table gives an empty result.
    """
    plan = mix_plan(docs, config)
    rows = _keyed(docs.drop("size", "source_size", "target", "copies", "words_more", "taken"), config.seed)
    rows = attach(rows, plan, ["_key"], "left")
    fits = (F.col("_place") <= F.col("_last2")) & (F.col("_size") <= F.col("_fit"))
    more = (F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False)) | F.coalesce(fits, F.lit(False))).cast("int")
    part = F.when((more == 1) & (F.col("_place") == F.col("_last")) & (F.col("_rest") < F.col("_size")), F.col("_rest"))
    rows = rows.withColumn("words_more", F.coalesce(part, F.lit(0))).withColumn("copies", F.col("_whole") + F.when(part.isNull(), more).otherwise(0)).withColumn("size", F.col("_size"))
    rows = rows.withColumn("taken", F.col("size") * F.col("copies") + F.col("words_more"))
    return rows.drop("_key", "_size", "_place", "_whole", "_last", "_rest", "_fit", "_last2")


def repeated(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names.

    A part is the first words of the text, joined by blanks.
    """
    docs, named = aside(docs, ["doc_id", "text", "source"])
    rows = mixed(docs, config).where("taken > 0")
    copies = F.when(F.col("copies") > 0, F.array_repeat(F.lit(0).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>"))
    part = F.when(F.col("words_more") > 0, F.array("words_more")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_part", F.explode(F.concat(copies, part)))
    first = F.slice(F.filter(F.split("text", SEPARATOR_RUN), lambda w: w != ""), F.lit(1), F.col("_part").cast("int"))
    text = F.when(F.col("_part") > 0, F.array_join(first, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*named)
