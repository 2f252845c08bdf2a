"""A quality classifier by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are word bigrams with the beginning and the end of each text, so the tables
grow with the trusted text; words are told apart by 32 bits of a hash.  In back-off form the log
probability of a text is a sum over its n-grams:

* each word adds log p1(word) + log back(word), where p1 is the Kneser-Ney unigram probability
  and back the weight that the word leaves to shorter contexts;
* each bigram that the trusted text has adds log p(word | before) - log back(before) - log p1(word).

So a document's perplexity is a join of its n-grams with one table (gram, weight), and a sum.
The table is hash-partitioned; documents send the keys of their n-grams, packed by shard, and a
task meets one shard of the table with the keys of that shard.  The commonest n-grams of the
trusted text and of the documents, a fixed number of each, go to every executor with their
weights, or with what an n-gram that the model lacks adds, and are added where the text is read,
so no hot word makes a hot shard; which n-grams of the documents those are is estimated from a
bounded part of them and changes no result.  A Bloom filter of fixed size leaves out most
n-grams that the model lacks: bigrams add nothing, words the weight of an unknown one.  The work
is done in ``rounds`` over parts of the table to keep the shuffle files small.

Part of the trusted documents is held out of the counts.  The thresholds are quantiles by
language: the upper one of the perplexities of held-out documents, as documents that a model has
seen look better than others of their kind; the lower one of all trusted documents'.  As a few
held-out documents say little about the tail of their language, its upper bound is at least its
median and what the same quantile of all languages' distances from their medians adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ._common import attach, bounded, cut, drop, id_filter, maybe_in, private, small_batches

#: Word numbers that no word has: the beginning and end of a text, and "no word before".
BEGIN, END, NONE = 0, 1, (1 << 32) - 1


@dataclass(frozen=True)
class PerplexityConfig:
    #: One in so many trusted documents, by a hash of doc_id, is held out for the thresholds.
    held_out: int = 4
    #: Quantiles of the trusted documents' perplexities, by language, outside which a document is rejected.
    low: float = 0.002
    high: float = 0.99
    #: Relative rank error of the quantiles is 1 / accuracy.
    accuracy: int = 10_000
    #: N-grams that are sent to every executor: the commonest of the trusted text, and of the documents.
    common: int = 400_000
    frequent: int = 200_000
    #: Bytes of the documents' text in which their commonest n-grams are counted.
    part_bytes: int = 1 << 25
    #: Parts of the table that are joined one after the other, and bytes of text for each shard of a part.
    rounds: int = 5
    shard_bytes: int = 1 << 26


def _numbers(data, starts, ends):
    """32-bit numbers of words; none is BEGIN, END or NONE."""
    from . import _text as X

    h = X.word_hashes(data, starts, ends, lower=False) >> np.uint64(32)
    return np.clip(h, 2, NONE - 1)


def _grams(column):
    """For chunks of a string column: (first row, words of each text, grams, their texts).

    A text's grams are its bigrams (before << 32 | word) with BEGIN and END around it, and its
    words, BEGIN and END alone (NONE << 32 | word).  A text without words has none.
    """
    from . import _text as X

    for row, data, offsets in X.chunks(column):
        starts, ends, first = X.words(data, offsets)
        n = np.diff(first)
        if not len(starts):
            yield row, n, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        size = np.where(n > 0, n + 2, 0)
        begins = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(n)), size)
        w = np.full(int(size.sum()), BEGIN, dtype=np.uint64)
        text = np.repeat(np.arange(len(n)), n)
        w[begins[text] + 1 + np.arange(len(starts)) - first[:-1][text]] = _numbers(data, starts, ends)
        some = n > 0
        w[(begins + size - 1)[some]] = END
        inside = owner[1:] == owner[:-1]
        two = (w[:-1] << np.uint64(32) | w[1:])[inside]
        one = np.uint64(NONE << 32) | w
        yield row, n, np.concatenate([two, one]), np.concatenate([owner[1:][inside], owner])


def _looked_up(known, grams):
    """The order of ``grams`` by size, and for each in that order its place in the sorted ``known`` and whether it is there.

    Sorted ones walk the table from its beginning to its end, which takes half the time of
    jumping about in it.
    """
    by = np.argsort(grams)
    at = np.minimum(np.searchsorted(known, grams[by]), max(0, len(known) - 1))
    return by, at, known[at] == grams[by] if len(known) else np.zeros(len(grams), dtype=bool)


def bigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n over all texts; each task sums its own before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

        for batch in batches:
            for _, n, grams, _ in _grams(batch.column(0)):
                two = grams[: int((n + 1)[n > 0].sum())]
                held.append(two)
                size += len(two)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_grams(docs: DataFrame, size: int, config: PerplexityConfig) -> DataFrame:
    """gram of at most ``frequent`` n-grams that are commonest in a part of docs (ref, text) of about ``part_bytes`` of ``size``."""
    part = docs.where(F.pmod(F.xxhash64("ref"), F.lit(-(-max(1, size) // config.part_bytes))) == 0)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, grams, _ in _grams(batch.column(0)):
                keys, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

    counted = part.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counted.where("n > 3").orderBy(F.col("n").desc(), "gram").limit(config.frequent).select("gram")


def _discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col(column) == k) for k in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """(gram, n, weight) of the interpolated model of bigram counts (gram, n), and the weight of an unknown word.

    Words count the different words before them; the unigram keeps a share for an unknown word.
    Counts that were cut are deleted as soon as they are used up.
    """
    before, word = F.shiftrightunsigned("gram", 32), F.col("gram").bitwiseAND(F.lit(NONE))

    def off(column, d):
        return F.when(F.col(column) == 1, d[0]).when(F.col(column) == 2, d[1]).otherwise(d[2])

    d2 = _discounts(counts, "n")
    words = cut(counts.groupBy(word.alias("w")).agg(F.count("*").alias("kinds"), F.sum("n").alias("times")))
    d1 = _discounts(words, "kinds")
    kinds, known, lost = words.agg(F.sum("kinds"), F.count("*"), F.sum(off("kinds", d1))).first()
    kinds, spare = kinds or 1, (lost or 1.0) / (kinds or 1) / ((known or 0) + 1)
    p1 = (F.col("kinds") - off("kinds", d1)) / kinds + F.lit(spare)
    contexts = cut(counts.groupBy(before.alias("c")).agg(F.sum("n").alias("total"), F.sum(off("n", d2)).alias("lost")))
    # One row for each word as a word, as a context, or both.
    both = words.join(contexts, F.col("w") == F.col("c"), "full")
    back = F.coalesce(F.log(F.col("lost") / F.col("total")), F.lit(0.0))
    single = both.select(
        F.coalesce("w", "c").bitwiseOR(F.lit(-(1 << 32))).alias("gram"),  # NONE << 32 as a long
        F.coalesce("times", "total").alias("n"),
        (F.coalesce(F.log(p1), F.lit(0.0)) + back).alias("weight"),
    )
    rows = counts.select("gram", F.col("n").cast("int").alias("n"), word.alias("word"))
    rows = cut(rows.join(words.select("w", p1.cast("float").alias("p1")), F.col("word") == F.col("w")).select("gram", "n", "p1"))
    drop(counts)
    part = (F.col("n") - off("n", d2)) / F.col("lost") / F.col("p1")
    pair = rows.join(contexts, before == F.col("c")).select("gram", F.col("n").cast("long").alias("n"), F.log1p(part).alias("weight"))
    table = cut(pair.select("gram", "n", F.col("weight").cast("float").alias("weight")).union(single.select("gram", "n", F.col("weight").cast("float"))))
    drop(rows, words, contexts)
    return table, float(np.log(spare))


def perplexities(docs: DataFrame, table: DataFrame, unknown: float, config: PerplexityConfig) -> DataFrame:
    """ref, n_words, log_perplexity for each (ref, text) of docs with a word.

    Rows that share a ref hold the same text.  log_perplexity is the mean over words and the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # By classes of counts, a few hundred; so many of the highest as hold ``common`` n-grams at most.
    size_class = F.floor(F.log2("n") * 8)
    classes = sorted(table.groupBy(size_class.alias("k")).count().collect(), reverse=True)
    held, least = 0, float("inf")
    for k, n in classes:
        if (held := held + n) > config.common:
            break
        least = k
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    hot = cut(frequent_grams(docs, size, config))
    # Two tables of a fixed number of rows each meet on the driver, as Arrow; neither join nor
    # collection may leave shuffle files for the rounds, so what comes from the table is cut first.
    given = attach(table, hot.select("gram", F.lit(True).alias("hot")), ["gram"], "left", config.frequent)
    top = cut(given.where((size_class >= F.lit(least)) | F.col("hot")).select("gram", F.col("weight").cast("double").alias("weight")))
    held, asked = top.toArrow(), hot.toArrow()
    drop(hot, top)
    grams = held.column("gram").to_numpy().view(np.uint64)
    lacking = np.setdiff1d(asked.column("gram").to_numpy().view(np.uint64), grams)
    weights = np.concatenate([held.column("weight").to_numpy(), np.where(lacking >> np.uint64(32) == np.uint64(NONE), unknown, 0.0)])
    grams = np.concatenate([grams, lacking])
    order = np.argsort(grams)
    common = spark.sparkContext.broadcast((grams[order], weights[order]))
    del held, asked, grams, weights, order
    seen = id_filter(table, "gram")
    shards, rounds = max(16, -(-size // config.shard_bytes)), config.rounds

    def keys(number: int):
        def run(batches):
            import pyarrow as pa

            from . import _text as X

            known, weights = common.value
            for batch in batches:
                refs = batch.column(0).to_numpy()
                for row, n, grams, owner in _grams(batch.column(1)):
                    # A round looks up its own part only.
                    shard = X.mix(grams)
                    mine = shard % np.uint64(rounds) == np.uint64(number)
                    grams, owner, shard = grams[mine], owner[mine], shard[mine]
                    by, at, hit = _looked_up(known, grams)
                    grams, owner, shard = grams[by], owner[by], shard[by]
                    base = np.zeros(len(n)) + np.bincount(owner[hit], weights[at[hit]], minlength=len(n))
                    grams, owner, shard = grams[~hit], owner[~hit], shard[~hit]
                    keep = maybe_in(seen, grams.view(np.int64))
                    single = ~keep & (grams >> np.uint64(32) == np.uint64(NONE))
                    base += unknown * np.bincount(owner[single], minlength=len(n))
                    grams, owner = grams[keep], owner[keep]
                    shard = (shard[keep] // np.uint64(rounds) % np.uint64(shards)).astype(np.int64)
                    by = np.lexsort((owner, shard))
                    grams, owner, shard = grams[by], owner[by], shard[by]
                    here = refs[row : row + len(n)]
                    bounds = np.searchsorted(shard, np.arange(shards + 1))
                    some = np.flatnonzero(bounds[1:] > bounds[:-1])
                    # Texts of the chunk whose keys a shard gets, and how many.
                    edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1]))) if len(owner) else np.zeros(0, np.int64)
                    each = np.diff(np.append(edge, len(owner)))
                    per = np.searchsorted(edge, bounds)
                    cuts = np.append(bounds[some], bounds[some[-1] + 1] if len(some) else 0).astype(np.int32)
                    texts = np.append(per[some], per[some[-1] + 1] if len(some) else 0).astype(np.int32)
                    rows = len(some)
                    sums = [pa.array(some), pa.ListArray.from_arrays(pa.array(texts), pa.array(here[owner[edge]])), pa.ListArray.from_arrays(pa.array(texts), pa.array(each.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams.view(np.int64)))]
                    blank = [pa.nulls(rows, pa.list_(t)) for t in (pa.int64(), pa.float64(), pa.int64())]
                    names = ["shard", "refs", "each", "grams", "base_refs", "base", "words"]
                    if rows:
                        yield pa.RecordBatch.from_arrays([*sums, *blank], names=names)
                    # The words of a text are counted in the first round.
                    has = n > 0 if number == 0 else base != 0
                    if has.any():
                        one = np.array([0, int(has.sum())], dtype=np.int32)
                        none = [pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.int32(), pa.int64())]
                        given = [pa.ListArray.from_arrays(pa.array(one), pa.array(v)) for v in (here[has], base[has], n[has].astype(np.int64) * (number == 0))]
                        yield pa.RecordBatch.from_arrays([pa.array([int(here[has][0] % shards)]), *none, *given], names=names)

        return docs.select("ref", F.col("text").cast("string").alias("text")).mapInArrow(run, "shard long, refs array<long>, each array<int>, grams array<long>, base_refs array<long>, base array<double>, words array<long>")

    def add(model, packed):
        import pyarrow as pa

        def flat(name):
            column = packed.column(name).combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False)

        refs, sums, n = flat("base_refs"), flat("base"), flat("words")
        if packed.num_rows:
            grams, weights = model.column("gram").to_numpy(), model.column("weight").to_numpy()
            order = np.argsort(grams)
            grams, weights = grams[order], weights[order]
            asked, each = flat("grams"), flat("each").astype(np.int64)
            at = np.minimum(np.searchsorted(grams, asked), max(0, len(grams) - 1))
            hit = grams[at] == asked if len(grams) else np.zeros(len(asked), dtype=bool)
            single = asked.view(np.uint64) >> np.uint64(32) == np.uint64(NONE)
            value = np.where(hit, weights[at] if len(grams) else 0.0, np.where(single, unknown, 0.0))
            total = np.add.reduceat(value, np.cumsum(each) - each) if len(each) else np.zeros(0)
            refs = np.concatenate([refs, flat("refs")])
            sums, n = np.concatenate([sums, total]), np.concatenate([n, np.zeros(len(total), np.int64)])
        ref, place = np.unique(refs, return_inverse=True)
        out = np.bincount(place, sums, minlength=len(ref)), np.bincount(place, n, minlength=len(ref)).astype(np.int64)
        return pa.table({"ref": pa.array(ref, pa.int64()), "s": pa.array(out[0], pa.float64()), "n": pa.array(out[1], pa.int64()), "rows": pa.array(np.bincount(place, n > 0, minlength=len(ref)).astype(np.int64))})

    def mixed_parts(batches):
        import pyarrow as pa

        from . import _text as X

        for batch in batches:
            h = X.mix(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((h % np.uint64(rounds)).astype(np.int64)), pa.array((h // np.uint64(rounds) % np.uint64(shards)).astype(np.int64))], names=["gram", "weight", "part", "shard"])

    dealt = table.select("gram", "weight").mapInArrow(mixed_parts, "gram long, weight float, part long, shard long")
    done, total = [], None
    for number in range(rounds):
        model = dealt.where(F.col("part") == number).drop("part")
        part = model.groupBy("shard").cogroup(keys(number).groupBy("shard")).applyInArrow(add, "ref long, s double, n long, rows long")
        done.append(cut(part.groupBy("ref").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))))
        total = done[-1] if total is None else total.union(done[-1])
    # Rows that share a ref brought the same sums, once each.
    found = total.groupBy("ref").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    found = cut(found.select("ref", (F.col("n") / F.col("rows")).cast("long").alias("n_words"), (-F.col("s") / (F.col("n") + F.col("rows"))).alias("log_perplexity")))
    drop(*done)
    # All that reads them is written.
    common.destroy()
    seen.destroy()
    return found


def _ref():
    """Tells rows apart by doc_id and text (64 bits of a hash)."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def quality_scores(docs: DataFrame, trusted: DataFrame, config: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """The columns of docs but text, with ref, n_words, log_perplexity, low, high and kept; see ``quality_judged``."""
    docs = docs.drop("n_words", "log_perplexity", "low", "high", "kept", "ref")
    trusted = cut(trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(config.held_out)) == 0))
    text = attach(docs.select("doc_id", "text"), trusted.where("not held").select("doc_id"), ["doc_id"], "left_semi")
    counts = cut(bigram_counts(text))
    table, unknown = kneser_ney(counts)
    scores = perplexities(docs.select(_ref().alias("ref"), "text"), table, unknown, config)
    drop(table)
    rows = docs.withColumn("ref", _ref()).drop("text").join(scores, "ref", "left")
    rows = cut(rows.withColumn("n_words", F.coalesce("n_words", F.lit(0))))
    drop(scores)
    judged = rows.select("doc_id", "lang", "log_perplexity").join(trusted, "doc_id")
    quantile = lambda q, which: F.percentile_approx(F.when(which, F.col("log_perplexity")), F.lit(q), F.lit(config.accuracy))
    bounds = [quantile(config.low, F.lit(True)).alias("low"), quantile(config.high, F.col("held")).alias("high"), quantile(0.5, F.col("held")).alias("middle")]
    by_lang = cut(judged.groupBy("lang").agg(*bounds).withColumnRenamed("lang", "_lang"))
    low, high, _ = judged.agg(*bounds).first()
    # One row for each language: sent to every executor, so that documents are not dealt by language.
    bounds = F.broadcast(by_lang) if bounded(by_lang, 100_000) else by_lang
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    above = judged.where("held").join(bounds, same).agg(F.percentile_approx(F.col("log_perplexity") - F.col("middle"), F.lit(config.high), F.lit(config.accuracy))).first()[0]
    drop(trusted)
    rows = rows.join(bounds.withColumn("high", F.greatest("high", F.col("middle") + F.lit(above).cast("double"))), same, "left").drop("_lang", "middle")
    rows = rows.withColumn("low", F.coalesce("low", F.lit(low).cast("double"), F.lit(float("-inf")))).withColumn("high", F.coalesce("high", F.lit(high).cast("double"), F.lit(float("inf"))))
    return rows.withColumn("kept", F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))


def quality_judged(docs: DataFrame, trusted: DataFrame, config: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """docs (doc_id, text, lang, any more) with n_words, log_perplexity, low, high and kept.

    ``trusted`` holds the doc_ids of trusted documents.  A document is kept if its mean
    log-perplexity lies within its language's quantiles of the trusted documents; a language
    (null is one) without trusted (for the upper bound: held-out) documents takes the quantiles
    of all.  Texts that are null, empty or blank have no perplexity and are rejected; long ones
    are read whole.  Without trusted text every other document is kept.  Repeated rows are
    judged alike, ties with a quantile are kept, and trusted rows count as often as they occur;
    columns of docs with the names of the new ones are replaced.  An empty table gives an empty
    result.
    """
    docs = docs.drop("n_words", "log_perplexity", "low", "high", "kept", "ref")
    scores = cut(quality_scores(docs.select("doc_id", "text", "lang"), trusted, config).select("ref", "n_words", "log_perplexity", "low", "high", "kept").dropDuplicates(["ref"]))
    return attach(docs.withColumn("ref", _ref()), scores, ["ref"], "left").drop("ref")


def quality_kept(docs: DataFrame, trusted: DataFrame, config: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """The rows of docs that ``quality_judged`` keeps; only the smaller of the two parts, as hashes, meets the texts."""
    scores = cut(quality_scores(docs.select("doc_id", "text", "lang"), trusted, config).select("ref", "kept").distinct())
    kept = scores.agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first()
    how, part = ("left_semi", scores.where("kept")) if kept[0] < kept[1] else ("left_anti", scores.where("not kept"))
    names = docs.columns
    key = private("ref", names)
    return attach(docs.withColumn(key, _ref()), part.select(F.col("ref").alias(key)), [key], how).select(*names)
