"""Lines of scanned and printed pages, page furniture, and tables of laws."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

# Phrases of page furniture.
CHROME = ("hujjatga taklif yuborish", "audioni tinglash", "hujjat elementidan havola olish", "предложить изменение", "прослушать аудио", "получить ссылку на элемент")
PAGE_NOISE = "(?iU)^\\s*(?:\\d{1,4}|[-–—]\\s*\\d{1,4}\\s*[-–—]|(?:page|bet|стр\\.?)\\s*\\d{1,4})\\s*$"


def is_chrome(text: Column) -> Column:
    """Nothing but furniture: known phrases, bars and dashes."""
    left = F.lower(F.coalesce(text, F.lit("")))
    for phrase in CHROME:
        left = F.replace(left, F.lit(phrase), F.lit(""))
    return F.regexp_replace(left, "[\\s|/·—–-]+", "") == ""


def is_page_noise(text: Column) -> Column:
    """A page number alone."""
    return text.rlike(PAGE_NOISE)


def is_printed_heading(text: Column, size: Column, body_size: Column) -> Column:
    """Larger type than the body's by 15 % in a line under 200 characters, or capitals of 7 to 199 characters."""
    capitals = (F.upper(text) == text) & text.rlike("\\p{Lu}") & F.length(text).between(7, 199)
    return ((size > 1.15 * body_size) & (F.length(text) < 200)) | capitals


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, body_size: the most frequent type size of each document, the smallest of several."""
    n = lines.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg((-F.max(F.struct("n", (-F.col("size")).alias("s")))["s"]).alias("body_size"))


def article_groups(rows: DataFrame, key: str, order: str, number: str, body: str) -> DataFrame:
    """Consecutive rows of one article as one: key, nth, number, body in order."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(number) == F.lag(number).over(w), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda x: x[body]), "\n")
    return rows.groupBy(key, "nth").agg(F.first(number).alias(number), joined.alias(body))


def check_string(fields: Column, allowed: list[str]) -> Column:
    """key=value lines of the allowed keys of a map, sorted by key."""
    kept = F.map_filter(fields, lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(name, "\\\\", "/"), "/"), -1), "[^\\p{L}\\p{N}._-]+", "_")
