"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other.

1. One pass over the texts counts the words; counts meet in a plain aggregation.
2. Every word has the key of itself and of each string that deleting one code point leaves:
   prefix and suffix sums of a polynomial hash over 64-bit integers give all of them at once.
   Words that differ by a replacement share the key and the position of a deletion; a word and
   one that is longer by a code point share a key of which the shorter is the whole string.
3. Keys are dealt by their leading bits (radix) and sorted; a stream over the sorted keys leaves
   those that two words share.  Strings do not travel here.
4. What is left gets its strings, and only words whose strings without the code point are equal
   count as near, so collisions of hashes do no harm.
5. Each word's form is looked up among its near words, and roots follow forms by pointer doubling.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ._common import bounded, cut, drop, small_batches


@dataclass(frozen=True)
class SpellingConfig:
    #: Runs of these are words (a character class).
    letters: str = "A-Za-zÀ-ÿ"
    #: Code points and occurrences of a word at least.
    length: int = 7
    occurrences: int = 2
    #: A form occurs so many times as often as the word at least.
    ratio: int = 10
    #: A run loses a code point if this divides the checksum of its document and itself; 0: none does.
    typo: int = 31
    #: Distinct words that a task counts before it hands them on, and places that it hashes at once.
    words: int = 200_000
    places: int = 1 << 18


def word_counts(docs: DataFrame, config: SpellingConfig) -> DataFrame:
    """word, n of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    letters, length, typo, most = config.letters, config.length, config.typo, config.words

    def run(batches):
        import re

        import pyarrow as pa
        import pyarrow.compute as pc

        # A run of ``length`` or more is whole: matches are greedy and begin where runs begin.
        runs, crc32 = re.compile(f"[{letters}]{{{length},}}").findall, zlib.crc32
        counts: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)).to_pylist()):
                if not text:
                    continue
                of = crc32(f"{'' if number is None else number}:".encode())
                for w in runs(text):
                    if typo and not (h := crc32(w.encode(), of)) % typo:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < length:
                            continue
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= most:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


#: Base of the polynomial and what each code point counts (any odd base will do).
BASE = 0x9E3779B97F4A7C15


def deletion_keys(words: list[str], places: int):
    """(index of the word, position, first of its run, key) arrays: the keys of ``words`` themselves (position -1)
    and without the code point at each position.

    Deleting any of a run of equal code points leaves the same string; only the first of a run is
    marked.  Words of one length are hashed together, ``places`` positions at a time, about.
    """
    import numpy as np

    from ._text import mix

    u = np.uint64
    length = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(length, kind="stable")
    power = np.concatenate([[u(1)], np.cumprod(np.full(int(length.max(initial=1)), u(BASE)))])
    at = 0
    while at < len(order):
        size = int(length[order[at]])
        to = min(int(np.searchsorted(length[order], size, side="right")), at + max(1, places // max(1, size)))
        rows = order[at:to]
        codes = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), dtype="<u4").reshape(len(rows), size)
        value = mix(codes.astype(u) + u(1))
        weight = power[size - 1 :: -1] if size else power[:0]
        whole = value * weight
        before = np.zeros((len(rows), size), dtype=u)
        if size > 1:
            before[:, 1:] = np.cumsum(value[:, :-1] * weight[1:], axis=1, dtype=u)
        total = whole.sum(axis=1, dtype=u)
        keys = before + (total[:, None] - np.cumsum(whole, axis=1, dtype=u))
        opens = np.ones((len(rows), size), dtype=bool)
        opens[:, 1:] = codes[:, 1:] != codes[:, :-1]
        keys = mix(np.concatenate([total[:, None], keys], axis=1) + np.array([size, *[size - 1] * size], dtype=u)).view(np.int64)
        position = np.broadcast_to(np.arange(-1, size, dtype=np.int32), keys.shape)
        yield np.repeat(rows, size + 1), position.reshape(-1), np.concatenate([opens[:, :1] & False, opens], axis=1).reshape(-1), keys.reshape(-1)
        at = to


def _keys(words: DataFrame, config: SpellingConfig) -> DataFrame:
    """key, position, opens, id of every word (id, word)."""
    places = config.places

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for index, position, opens, key in deletion_keys(words, places):
                for lo in range(0, len(key), places):
                    k = slice(lo, lo + places)
                    yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(position[k]), pa.array(opens[k]), pa.array(ids[index[k]])], names=["key", "position", "opens", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, position int, opens boolean, id long")


def _shared(keys: DataFrame) -> DataFrame:
    """bucket, position, id: what may be near, from the keys sorted in radix partitions.

    A bucket is the position that words lose (replacements), or -1: a whole word and words that
    are longer by a code point.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The leading 16 bits of the key, scaled to the number of partitions.
    radix = F.shiftrightunsigned(F.shiftrightunsigned("key", 48) * n, 16).cast("int")
    dealt = keys.repartitionById(n, radix).sortWithinPartitions("key", "position", "id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[np.ndarray] | None = None
        names = ("key", "position", "opens", "id")

        def found(columns):
            key, position, opens, id_ = columns
            same = np.append(False, (key[1:] == key[:-1]) & (position[1:] == position[:-1])) & (position >= 0)
            pair = same | np.append(same[1:], False)
            first = np.append(True, key[1:] != key[:-1])
            run = np.cumsum(first) - 1
            whole = position[np.flatnonzero(first)][run] < 0
            opening = np.bincount(run, weights=opens, minlength=1)[run] > 0
            near = whole & opening & (opens | (position < 0))
            for keep, bucket in ((pair, position), (near, np.full(len(key), -1, dtype=np.int32))):
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(position[keep]), pa.array(id_[keep])], names=["bucket", "position", "id"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            # The last key may go on in the next batch.
            last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [c[last:] for c in columns]
            if last:
                yield from found([c[:last] for c in columns])
        if held is not None and len(held[0]):
            yield from found(held)

    return dealt.mapInArrow(run, "bucket int, position int, id long")


def _near(shared: DataFrame, words: DataFrame) -> DataFrame:
    """id, n_near, best (neg: minus its n, word) of the words that have near words.

    Windows hold words whose strings without one code point are equal, so at most one for each
    place and letter.
    """
    named = words.select(F.col("id").alias("i"), "word", "n")
    rows = shared.join(named, shared.id == named.i).drop("i")
    at = F.col("position")
    without = F.when(at < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word"))))
    rows = rows.select("bucket", "position", "id", F.struct((-F.col("n")).alias("neg"), "word").alias("me"), without.alias("rest"))
    group = Window.partitionBy("bucket", "rest")
    # Whole words stand apart from the longer ones of their bucket.
    alike = Window.partitionBy("bucket", "rest", F.col("position") < 0)
    ranked = alike.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = F.col("position") >= 0
    seen = rows.select(
        "id",
        "bucket",
        "position",
        "me",
        F.count_if(longer).over(group).alias("longer"),
        F.min(F.when(~longer, F.col("me"))).over(group).alias("whole"),
        F.min(F.when(longer, F.col("me"))).over(group).alias("top"),
        F.nth_value("me", 2).over(ranked).alias("second"),
    )
    replaced = F.col("bucket") >= 0
    near = F.when(replaced, F.col("longer") - 1).when(longer, F.when(F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("longer"))
    other = F.when(F.col("top") == F.col("me"), F.col("second")).otherwise(F.col("top"))
    best = F.when(replaced, other).when(longer, F.col("whole")).otherwise(F.col("top"))
    pairs = seen.select("id", near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return pairs.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) ends, by pointer doubling.

    Forms must not lead in circles; each round doubles the steps that are done, so a chain of
    19 (a form occurs ten times as often) takes five.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        then = cut(now.join(on, now.root == on.w, "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop(now)
        now = then
        if bounded(now.where("moved"), 0):
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text, any more).

    Words are maximal runs of ``letters`` of whole texts, however long, A-Z lower-cased, with
    the stated deletions of ``typo``; they have ``length`` code points and ``occurrences`` at
    least.  n_near counts the words that are one edit away; of them the form is the one of
    largest n, of equal ones the smallest in code-point order, if it occurs ``ratio`` times as
    often as the word.  Null and empty texts have no word; a null doc_id is an empty number in
    the checksum; repeated rows count as often as they occur; other columns, whatever their
    names, are not read; no rows, no result.
    """
    counted = word_counts(docs, config).where(F.col("n") >= config.occurrences)
    words = cut(counted.withColumn("id", F.monotonically_increasing_id()))
    shared = cut(_shared(_keys(words, config)))
    near = cut(_near(shared, words).withColumnRenamed("id", "i"))
    drop(shared)
    judged = words.join(near, words.id == near.i, "left")
    far = -F.col("best.neg") >= config.ratio * F.col("n")
    judged = cut(judged.select("word", F.when(far, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, -F.col("best.neg")).alias("form_n")))
    drop(words, near)
    ends = roots(judged.where("form is not null")).withColumnRenamed("word", "w")
    out = judged.join(ends, judged.word == ends.w, "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
