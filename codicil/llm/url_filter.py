"""URL verdicts: host and path rules first, then a logistic regression on hashed character n-grams.

Training reads a small labelled table: a bounded sample of rows with a label.  Each step of the
gradient is one aggregation over that sample, and the weights come back as one number for each
hash bucket.  Scoring is a SQL expression over the url, with the weights as a constant.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ._common import cut, let

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilterConfig:
    #: (verdict, "host/path") pairs; the longest rule that fits wins.
    rules: tuple[tuple[str, str], ...] = ()
    #: Lengths of the n-grams in characters, and hash buckets.
    grams: tuple[int, ...] = (3, 6)
    buckets: int = 4096
    #: Labelled rows used for training at most, those with the smallest seeded hashes.
    sample: int = 2000
    seed: int = 5
    steps: int = 30
    rate: float = 4.0
    l2: float = 1e-4


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, shape, 1), CAPITALS, SMALL), F.regexp_extract(url, shape, 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain of it, and a prefix of the path) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def buckets_of(host: Column, path: Column, config: UrlFilterConfig) -> Column:
    """The hash buckets of the n-grams of host and path, marked at their ends."""
    marked = F.concat(F.lit("<"), host, F.lit(">"), path, F.lit("$"))

    def grams(text: Column) -> Column:
        def of(n: int) -> Column:
            last = F.greatest(F.lit(1), F.length(text) - (n - 1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(config.seed), F.substring(text, i, F.lit(n))), F.lit(config.buckets)).cast("int"))

        return F.concat(*[of(n) for n in config.grams])

    return let(marked, grams)


def _constant(weights: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(repr(w) for w in weights)}', ',') as array<double>)")


def _score(bins: Column, weights: list[float], bias: float) -> Column:
    """The log-odds: the bias and the mean weight of the n-grams, on the scale of their square root."""
    w = _constant(weights)
    total = F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.get(w, b))
    return F.lit(bias) + total / F.sqrt(F.size(bins))


def trained(labelled: DataFrame, config: UrlFilterConfig) -> tuple[list[float], float]:
    """Weights and bias from rows (host, path, label 0/1); accelerated gradient steps over the bounded sample.

    Rows that repeat a host, path and label are one, so a hot address can't fill the sample.
    """
    chosen = labelled.where("host is not null and path is not null and label is not null").select("host", "path", "label").distinct().orderBy(F.xxhash64(F.lit(config.seed), "host", "path"), "host", "path", "label").limit(config.sample)
    sample = cut(chosen.select(buckets_of(F.col("host"), F.col("path"), config).alias("bins"), F.col("label").cast("double").alias("label")))
    n = sample.count()
    weights, bias = [0.0] * config.buckets, 0.0
    if not n:
        return weights, bias
    ahead, ahead_bias, t = weights, bias, 1.0
    for _ in range(config.steps):
        error = F.col("label") - 1 / (1 + F.exp(-_score(F.col("bins"), ahead, ahead_bias)))
        rows = sample.coalesce(1).select(error.alias("error"), (error / F.sqrt(F.size("bins"))).alias("part"), "bins")
        bins = F.concat(F.col("bins"), F.array(F.lit(-1)))
        each = rows.select(F.explode(bins).alias("bin"), "error", "part")
        slopes = each.groupBy("bin").agg(F.sum(F.when(F.col("bin") < 0, F.col("error")).otherwise(F.col("part"))).alias("slope"))
        found = {r["bin"]: r["slope"] / n for r in slopes.collect()}  # one row for each bucket at most
        after = [w + config.rate * (found.get(b, 0.0) - config.l2 * w) for b, w in enumerate(ahead)]
        after_bias = ahead_bias + config.rate * found[-1]
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        pull = (was - 1) / t
        ahead, ahead_bias = [a + pull * (a - w) for a, w in zip(after, weights)], after_bias + pull * (after_bias - bias)
        weights, bias = after, after_bias
    return weights, bias


def url_verdicts(pages: DataFrame, config: UrlFilterConfig, labelled: DataFrame | None = None) -> DataFrame:
    """pages (url, any more) with host, path, rule, score (log-odds of allow) and verdict.

    The verdict is the longest fitting rule's, else that of the regression.  Without a table
    ``labelled`` (url, label 0/1) the rows that rules decide are the labels.  A null url or one
    without ``://`` has empty host and path and is scored like any other.  Repeated rows get
    equal verdicts; with no label at all, the verdict is allow.  Columns of pages with the names
    of the new ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "score", "verdict")

    def split_up(rows: DataFrame) -> DataFrame:
        host, path = parts(F.col("url"))
        return rows.withColumn("host", host).withColumn("path", path)

    rows = split_up(pages)
    rule, said = rule_of(F.col("host"), F.col("path"), config.rules)
    if labelled is None:
        labels = rows.select("host", "path", (said == "allow").cast("int").alias("label"))
    else:
        labels = split_up(labelled.select("url", "label")).select("host", "path", "label")
    weights, bias = trained(labels, config)
    score = _score(buckets_of(F.col("host"), F.col("path"), config), weights, bias)
    rows = rows.withColumn("rule", rule).withColumn("score", score)
    return rows.withColumn("verdict", F.coalesce(said, F.when(F.col("score") >= 0, "allow").otherwise("block")))
