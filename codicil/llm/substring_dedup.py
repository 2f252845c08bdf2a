"""Repeated passages: MinHash banding of paragraphs and of paragraph windows inside long lines.

Two kinds of unit tile and slide over every text.

* Paragraphs: the lines of at least ``paragraph`` words, and blocks of neighbouring shorter lines
  (``units``), so that all text is in some.  Each has ``bands`` keys of its MinHash over 5-word
  shingles.
* Paragraph windows: every ``window`` consecutive places, whatever the lines are.  A window's
  MinHash under one hash function is its smallest four-word hash; neighbouring windows share
  it, so only the places where it changes are kept, and the key of a window is the run of
  ``run`` words that begins there.  Two texts that share a passage of run + window - 1 words
  therefore share a key, wherever the passage stands in either.

1. One pass over the texts gives the keys; a key that two different places share is kept.
2. A second pass brings the units that hold such a key, colliding paragraphs with their shingle
   sets.
3. Different paragraphs of a bucket are confirmed by exact Jaccard similarity of their sets and
   clustered by components (``minhash_dedup.linked``); equal ones are a cluster by themselves.
4. Every cluster keeps its first occurrence by (doc_id, start).  Matches of equal units at one
   distance that touch join, and a third pass brings the words around what they cover, so that
   each grows word by word until the words differ (words are compared by hashes).  Matches so
   deep inside others (a phrase said over and over) that this changes no removal stay as they are.  Two matches
   with changed words between them are one passage only if those words are few and apart and the
   exact Jaccard similarity of the whole says so (``grown``).
5. What a document repeats is merged into disjoint spans; those of at least ``least`` words are
   the removals.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ._common import attach, bounded, cut, drop, id_filter, maybe_in, small_batches
from .minhash_dedup import MinHashConfig, linked


@dataclass(frozen=True)
class PassageConfig:
    #: Words of a passage to remove at least.
    least: int = 50
    #: Words of a paragraph at least; shorter lines are joined.
    paragraph: int = 20
    #: Words of a window's key, and places in a window: any passage of run + window - 1 words
    #: that repeats is found.  A window has at most 62 places.
    run: int = 20
    window: int = 31
    width: int = 5
    percent: int = 80
    #: Paragraphs of similarity 0.8 share no bucket with a probability of 1.7e-6.
    bands: int = 13
    rows: int = 2


KEYS = "key long, place int"
#: ``group`` names equal units; bands and set are null for units that only equal ones meet.
PLACES = "doc_id long, start int, n_words int, group long, bands array<long>, set array<long>"
#: 32 bits of a hash (four bytes) of each word after a place (right) or before it, nearest first.
AROUND = "doc_id long, start int, right boolean, words binary"


def units(np, mix, h, a, b, first, least: int, width: int):
    """Firsts and lasts (words) of the paragraphs of texts whose lines are the words a..b.

    A stretch of short lines is cut before each line whose first two words have the smallest hash
    of all lines that begin less than ``least`` words away, so that equal lines are cut alike
    whatever stands before them, and changes of other words move no cut; no block has fewer than
    ``least`` words.  A stretch of fewer words is
    filled up to ``least`` from the long line after it, or else the one before it, which is a
    paragraph by itself too; so the two are hardly ever similar.  A whole text is taken however
    short it is, if it has a shingle.
    """
    owner = np.searchsorted(first, a, side="right") - 1
    long = b - a >= least
    firsts, lasts = [a[long]], [b[long]]
    if not long.all():
        opens = np.flatnonzero(~long & np.append(True, long[:-1] | (owner[1:] != owner[:-1])))
        closes = np.flatnonzero(~long & np.append(long[1:] | (owner[1:] != owner[:-1]), True))
        stretch = np.full(len(a), -1)
        for k, (x, y) in enumerate(zip(opens, closes)):
            stretch[x : y + 1] = k
        value = mix(mix(h[a]) + np.where(b - a > 1, h[np.minimum(a + 1, len(h) - 1)], np.uint64(0)))
        cut_here = ~long
        for d in range(1, least):
            near = (stretch[d:] == stretch[:-d]) & (stretch[d:] >= 0) & (a[d:] - a[:-d] < least)
            if not near.any():
                break
            smaller = value[d:] < value[:-d]
            cut_here[:-d] &= ~(near & smaller)
            cut_here[d:] &= ~(near & ~smaller)
        begin, end = a[opens], b[closes]
        inner = np.flatnonzero(cut_here)
        inner = inner[(a[inner] - begin[stretch[inner]] >= least) & (end[stretch[inner]] - a[inner] >= least)]
        size = end - begin
        alone = size >= least
        at = np.sort(np.concatenate([begin[alone], a[inner]]))
        firsts.append(at)
        lasts.append(np.sort(np.concatenate([end[alone], a[inner]])))
        x, y = opens[~alone], closes[~alone]
        after = (y + 1 < len(a)) & (owner[np.minimum(y + 1, len(a) - 1)] == owner[y])
        before = ~after & (x > 0) & (owner[x - 1] == owner[x])
        firsts.append(np.where(before, b[y] - least, a[x]))
        lasts.append(np.where(after, a[x] + least, b[y]))
    firsts, lasts = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(firsts, kind="stable")
    firsts, lasts = firsts[order], lasts[order]
    some = lasts - firsts >= width
    return firsts[some], lasts[some]


def runs(np, anchor, first, size: int, window: int):
    """The places where the smallest ``anchor`` of ``window`` neighbouring places changes.

    Places are the words at which a run of ``size`` words of one text begins; a text with fewer
    than ``window`` places is one window.  The first of equal anchors is taken.  Anchors are
    compared by their upper 32 bits; the lower ones name the place.
    """
    n = first[1:] - first[:-1] - size + 1
    value = (anchor & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(anchor), dtype=np.uint64)
    low, span = value, 1
    while 2 * span <= window:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < window:
        more = window - span
        low = np.minimum(low[:-more], low[more:])
    windows = np.where(n >= window, n - window + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    found = low[at]
    short = np.flatnonzero((n > 0) & (n < window))
    if len(short):
        ends = np.stack([first[short], first[short] + n[short]], axis=1).reshape(-1)
        found = np.concatenate([found, np.minimum.reduceat(np.append(value, np.uint64(2**64 - 1)), ends)[::2]])
    found = (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Smallest places of neighbouring windows never go back.
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    return np.sort(found) if len(short) else found


def spot(np, mix, doc_id, start):
    """A number for each place (document, word) of int64 arrays."""
    return mix(mix(doc_id.view(np.uint64)) * np.uint64(3) + start.astype(np.uint64)).view(np.int64)


def edge(at, right):
    """A number for the words after (right) or before a place."""
    return 2 * at + right


def _pass(docs: DataFrame, config: PassageConfig, keys=None, wanted=None) -> DataFrame:
    """The keys of all units (KEYS), or the units that hold one of the filter ``keys`` (PLACES),
    or the words AROUND the beginnings and ends of units, once each, that the filter ``wanted`` holds.

    ``place`` tells different holders of a key apart: of a band key by the paragraph's words, of
    the key of equal units by document and start.
    """
    small_batches(docs.sparkSession)
    size, window, least, width, bands, rows = config.run, config.window, config.paragraph, config.width, config.bands, config.rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import _text as X

        u = np.uint64
        factors = X.mix(np.arange(1, bands * rows + 1, dtype=u)) | u(1)

        def spread(n):
            """For groups of n members: the number of each member in its group."""
            return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

        def folded(h, firsts, lasts, seed):
            """A hash of the words first..last of each unit; units may overlap."""
            n = lasts - firsts
            at = spread(n)
            parts = X.mix(h[np.repeat(firsts, n) + at] + at.astype(u) * u(0x9E3779B97F4A7C15))
            return X.mix(np.add.reduceat(parts, np.cumsum(n) - n) + n.astype(u) + u(seed)).view(np.int64) if len(n) else h[:0].view(np.int64)

        def lists(values, n, kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values, kind))

        def around(ids, short, first, at, right):
            """The words before, or after, the word places ``at`` that ``wanted`` holds."""
            at = np.sort(at, kind="stable")
            at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
            owner = np.searchsorted(first, at, side="left" if right else "right") - 1
            keep = maybe_in(wanted, spot(np, X.mix, ids[owner], edge(at - first[owner], right)))
            at, owner = at[keep], owner[keep]
            if len(at):
                n = np.minimum(window, first[owner + 1] - at if right else at - first[owner])
                step = spread(n)
                near = short[np.repeat(at, n) + step if right else np.repeat(at, n) - 1 - step]
                offsets = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(near)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array((at - first[owner]).astype(np.int32)), pa.array(np.full(len(at), right)), packed], names=["doc_id", "start", "right", "words"])

        def places(ids, first, owner, firsts, lasts, whole, band, rolled):
            """Units with a shared key."""
            some = maybe_in(keys, whole)
            alike = maybe_in(keys, band.reshape(-1)).reshape(band.shape).any(axis=1) if band is not None else np.zeros(len(some), dtype=bool)
            keep = some | alike
            owner, firsts, lasts, whole, alike = (x[keep] for x in (owner, firsts, lasts, whole, alike))
            k = len(firsts)
            if not k:
                return
            per = sets = blank = pa.nulls(k, pa.list_(pa.int64()))
            if alike.any():
                n = np.where(alike, lasts - firsts - (width - 1), 0)
                at = np.repeat(firsts, n) + spread(n)
                null = pa.array(~alike)
                per = pa.compute.if_else(null, blank, lists(band[keep][alike].reshape(-1), np.where(alike, bands, 0), pa.int64()))
                sets = pa.compute.if_else(null, blank, lists(rolled[at].view(np.int64), n, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array((firsts - first[owner]).astype(np.int32)), pa.array((lasts - firsts).astype(np.int32)), pa.array(whole), per, sets], names=["doc_id", "start", "n_words", "group", "bands", "set"])

        def found(key, place):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place)], names=["key", "place"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for row, data, offsets in X.chunks(batch.column(1)):
                starts, ends, first = X.words(data, offsets)
                if not len(starts):
                    continue
                h = X.word_hashes(data, starts, ends)
                short = (h >> u(32)).astype(np.uint32).view(np.int32)
                ids = numbers[row : row + len(offsets) - 1]
                edges = np.unique(np.concatenate([first, np.searchsorted(starts, np.flatnonzero(data == 10))]))
                a, b = units(np, X.mix, h, edges[:-1], edges[1:], first, least, width)
                owner = np.searchsorted(first, a, side="right") - 1
                at = h[:0].view(np.int64)
                if len(h) >= size:
                    anchor = X.mix(X.mix(X.mix(h[:-3] * u(3) + h[1:-2]) * u(3) + h[2:-1]) * u(3) + h[3:])
                    at = runs(np, anchor, first, size, window)
                if wanted is not None:
                    yield from around(ids, short, first, np.concatenate([a, at]), False)
                    yield from around(ids, short, first, np.concatenate([b, at + size]), True)
                    continue
                if len(a):
                    rolled = h
                    for _ in range(width - 1):
                        rolled = X.mix(rolled[:-1] * u(5) + h[len(h) - len(rolled) + 1 :])
                    # Shingles that leave their paragraph are out of the minima.
                    pairs = np.stack([a, b - (width - 1)], axis=1).reshape(-1)
                    registers = np.empty((len(a), bands * rows), dtype=u)
                    values = np.full(len(rolled) + 1, 2**64 - 1, dtype=u)
                    for k, factor in enumerate(factors):
                        # The shingles are mixed already: a product with an odd number orders them anew.
                        np.multiply(rolled, factor, out=values[:-1])
                        registers[:, k] = np.minimum.reduceat(values, pairs)[::2]
                    band, whole = X.band_keys(registers, bands), folded(h, a, b, 1)
                    if keys is None:
                        yield found(band.reshape(-1), np.repeat((whole >> 32).astype(np.int32), bands))
                        yield found(whole, (spot(np, X.mix, ids[owner], a - first[owner]) >> 32).astype(np.int32))
                    else:
                        for lo in range(0, len(a), 16_384):
                            k = slice(lo, lo + 16_384)
                            yield from places(ids, first, owner[k], a[k], b[k], whole[k], band[k], rolled)
                if not len(at):
                    continue
                owner = np.searchsorted(first, at, side="right") - 1
                whole = folded(h, at, at + size, 2)
                if keys is None:
                    yield found(whole, (spot(np, X.mix, ids[owner], at - first[owner]) >> 32).astype(np.int32))
                    continue
                for lo in range(0, len(at), 16_384):
                    k = slice(lo, lo + 16_384)
                    yield from places(ids, first, owner[k], at[k], at[k] + size, whole[k], None, None)

    rows_in = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, AROUND if wanted is not None else KEYS if keys is None else PLACES)


def repeated_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """doc_id, start, n_words, component_id, first_doc_id, first_start, first_words: one row for each passage to remove.

    The rows of a document do not overlap.  Starts count words (runs of characters other than
    space and U+0009..U+000D), compared with A-Z lower-cased over whole texts, however long.
    first_doc_id and first_start name the earlier occurrence of the longest match that begins the
    passage, which covers first_words of its words; component_id is its cluster, the smallest
    hash of the cluster's units.  Among equal units the smallest (doc_id, start) stays.  Null and
    empty texts and texts of fewer than ``least`` words have no passage; rows that share a doc_id
    are one document, so equal ones are not held against each other; rows with a null doc_id take
    no part; further columns of docs are not read.  An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    counts = _pass(docs, config).groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    shared = cut(counts.where("low != high").select("key"))
    # The filter lets a few more units through; groups of one place and empty buckets drop out below.
    found = cut(_pass(docs, config, keys=id_filter(shared, "key")))
    alike = found.where("bands is not null")
    nodes = cut(alike.groupBy(F.col("group").alias("id")).agg(F.first("bands").alias("bands"), F.array_distinct(F.first("set")).alias("set")))
    places = cut(found.select(*_AT, "group", F.col("bands").isNotNull().alias("banded")))
    drop(shared, found)

    reps = nodes.select("id", F.size("set").cast("long").alias("n"), "bands")
    link = MinHashConfig(width=config.width, percent=config.percent, bands=config.bands, rows=config.rows)
    groups = linked(reps, lambda wanted: nodes.select("id", "set").join(wanted, "id", "left_semi"), link)
    similar = cut(_similar(places.where("banded"), groups.withColumnRenamed("i", "group")))
    drop(nodes)
    equal = cut(streaks(places, config))
    drop(places)
    spans = cut(grown(docs, equal, config).union(similar))
    drop(equal, similar)
    return disjoint(spans, config.least)


#: Words by which neighbouring matches may be shifted and still be one passage.
SLACK = 5
_SPAN = ("doc_id", "start", "end", "component_id", "first_doc_id", "first_start")
_AT = ("doc_id", "start", "n_words")


def _later(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a cluster after its first one (with it, as ``first``), and not overlapping it."""
    firsts = rows.groupBy(F.col(name).alias("_name")).agg(F.min(F.struct(*_AT)).alias("first"), F.max(F.struct(*_AT)).alias("last"))
    # A cut, so that both sides of the join are plain exchanges and a hot cluster can be split.
    firsts = cut(firsts.where("first != last").drop("last"))
    found = rows.join(firsts, F.col(name) == F.col("_name"))
    return found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.start") + F.col("first.n_words"))).drop("_name")


_DISTANCE = ["doc_id", "first_doc_id", "shift"]


def streaks(places: DataFrame, config: PassageConfig) -> DataFrame:
    """Later occurrences of equal units (_SPAN, shift), those that touch at one distance from their first ones joined.

    gap is the number of words to the next one at that distance, null if it is two windows or more:
    what both matches go on for is not in it yet, which is less than a window for each.
    inner says that growth changes nothing: the match is in no chain, the matches that overlap
    in its document reach further than it can grow, and a later one of them stays the later one.
    A window holds what two documents have in common at one distance, or the matches of one document.
    """
    found = _later(places, "group").select("doc_id", "start", (F.col("start") + F.col("n_words")).alias("end"), F.col("group").alias("component_id"), F.col("first.doc_id").alias("first_doc_id"), (F.col("start") - F.col("first.start")).alias("shift"))
    order = Window.partitionBy(*_DISTANCE).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = new.withColumn("streak", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = numbered.groupBy(*_DISTANCE, "streak").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("component_id").alias("component_id"))
    order = Window.partitionBy(*_DISTANCE).orderBy("start")
    gap = F.lead("start").over(order) - F.col("end")
    before = F.col("start") - F.lag("end").over(order)
    near = 2 * config.window
    one = one.withColumn("gap", F.when(gap < near, gap)).withColumn("alone", F.coalesce(gap >= near, F.lit(True)) & F.coalesce(before >= near, F.lit(True)))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    one = one.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy("doc_id", "piece")
    left, right = F.col("start") - config.window, F.col("end") + config.window
    inner = F.col("alone") & (left > F.min("start").over(piece)) & (right < F.max("end").over(piece)) & (F.col("start") + config.window < F.max("start").over(piece))
    return one.select("doc_id", "start", "end", "component_id", "first_doc_id", (F.col("start") - F.col("shift")).alias("first_start"), "shift", "gap", inner.alias("inner"))


def _lost_shingles(same: Column, gap: Column, width: int) -> Column:
    """Shingles that touch a word that differs, of ``gap`` words that are the same or not; null if ``width`` neighbouring words differ."""
    begin = F.struct(F.lit(0).alias("lost"), F.lit(width).alias("since"), F.lit(0).alias("row"), F.lit(0).alias("most"))

    def step(s, equal):
        row = F.when(equal, 0).otherwise(s["row"] + 1)
        lost = s["lost"] + F.when(equal, 0).otherwise(F.least(s["since"], F.lit(width)))
        return F.struct(lost.alias("lost"), F.when(equal, s["since"] + 1).otherwise(1).alias("since"), row.alias("row"), F.greatest(s["most"], row).alias("most"))

    seen = F.aggregate(same, begin, step)
    return F.when((F.size(same) == gap) & (seen["most"] < width), seen["lost"])


def _matched(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` with, for the words ``one`` and ``two``: same (bit k: whether word k is the same), n (words of the longer) and lead (words that are the same from the beginning on)."""
    if window > 62:
        raise ValueError("a window has at most 62 places")
    names = rows.columns[:-2]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(column, blank):
            """A row of words for each value, and the numbers of words."""
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
            n = np.diff(offsets)
            values = np.frombuffer(data, dtype=np.uint32)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint32)
            out = np.full((len(n), window + 1), blank, dtype=np.int64)
            out[np.arange(window + 1) < n[:, None]] = values
            return out, n

        for batch in batches:
            (one, n), (two, m) = table(batch.column(len(names)), -1), table(batch.column(len(names) + 1), -2)
            equal = one == two
            same = equal @ (1 << np.arange(window + 1, dtype=np.int64))
            more = [pa.array(same), pa.array(np.maximum(n, m)), pa.array(equal.argmin(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, "same", "n", "lead"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, f"{kinds}, same long, n int, lead int")


def grown(docs: DataFrame, spans: DataFrame, config: PassageConfig) -> DataFrame:
    """Spans (_SPAN) with the words around them that both texts have in common: each once grown to the left, once to the right, but for inner ones.

    A match that went on for a whole window would hold one more shared unit, so that far is
    enough.  Spans at one distance between which never ``width`` neighbouring words differ are a
    chain; where the exact Jaccard similarity of the two passages that a chain covers is
    ``percent`` or more (all their shingles but those that touch a changed word are common), the
    chain is one passage, changed words included.  Else its matches stand for themselves.
    """
    width = config.width
    last = F.col("first_start") + F.col("end") - F.col("start")
    sides = F.array(
        F.struct(F.lit(False).alias("right"), F.col("start").alias("at"), F.col("first_start").alias("first_at")),
        F.struct(F.lit(True).alias("right"), F.col("end").alias("at"), last.alias("first_at")),
    )
    open_ = spans.where("not inner")
    edges = open_.select(*_SPAN, "shift", "gap", F.explode(sides).alias("s")).select(*_SPAN, "shift", "gap", "s.*")
    asked = edges.select("doc_id", "at", "right").union(edges.select("first_doc_id", "first_at", "right").distinct())

    def spots(batches):
        import numpy as np
        import pyarrow as pa

        from . import _text as X

        for batch in batches:
            doc_id, at, right = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(spot(np, X.mix, doc_id, edge(at.astype(np.int64), right)))], names=["spot"])

    spotted = cut(asked.mapInArrow(spots, "spot long"))
    sent = id_filter(spotted, "spot")
    words = _pass(docs, config, wanted=sent)
    # Each task brings a place of a document once; only rows that share a doc_id bring it again.
    if not bounded(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().where("count > 1"), 0):
        words = words.dropDuplicates(["doc_id", "start", "right"])
    words = cut(words)
    own = words.select(F.col("doc_id").alias("d"), F.col("start").alias("p"), F.col("right").alias("r1"), F.col("words").alias("one"))
    theirs = words.select(F.col("doc_id").alias("e"), F.col("start").alias("q"), F.col("right").alias("r2"), F.col("words").alias("two"))
    both = edges.join(own, (F.col("doc_id") == F.col("d")) & (F.col("at") == F.col("p")) & (F.col("right") == F.col("r1")))
    both = both.join(theirs, (F.col("first_doc_id") == F.col("e")) & (F.col("first_at") == F.col("q")) & (F.col("right") == F.col("r2")))
    out = cut(_matched(both.select(*_SPAN, "shift", "gap", "right", "one", "two"), config.window))
    drop(spotted, words)
    right = F.col("right")
    side = lambda which, column: F.max(F.when(which, F.col(column)))
    ends = out.groupBy(*_SPAN, "shift", "gap").agg(side(~right, "same").alias("before"), side(~right, "n").alias("n_before"), side(~right, "lead").alias("left"), side(right, "same").alias("after"), side(right, "n").alias("n_after"), side(right, "lead").alias("more"))
    order = Window.partitionBy(*_DISTANCE).orderBy("start")
    ends = ends.withColumn("next", F.lead("before").over(order)).withColumn("n_next", F.lead("n_before").over(order))
    # The words between two matches: those after the first one, then those before the second.
    gap, near = F.col("gap"), F.least("gap", "n_after")
    bit = lambda of, k: F.call_function("shiftright", F.col(of), k).bitwiseAND(F.lit(1)) == 1
    between = F.transform(F.sequence(F.lit(0), gap - 1), lambda k: F.when(k < near, bit("after", k)).otherwise(bit("next", gap - 1 - k)))
    known = gap.isNotNull() & F.col("next").isNotNull() & (F.col("n_next") >= gap - near)
    lost = F.when(known, _lost_shingles(between, gap, width))
    ends = ends.select(*_SPAN, "shift", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("more", F.lit(0)).alias("more"), lost.alias("lost"))
    chained = ends.withColumn("new", F.when(F.lag("lost").over(order).isNull(), 1).otherwise(0))
    chained = chained.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start, end, changed = F.col("start") - F.col("left"), F.col("end") + F.col("more"), F.coalesce("lost", F.lit(0))
    span = F.struct(start.alias("start"), end.alias("end"), "component_id")
    chains = chained.groupBy(*_DISTANCE, "chain").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.min("component_id").alias("component_id"), F.sum(changed).alias("lost"), F.collect_list(span).alias("spans"))
    common = F.col("end") - F.col("start") - (width - 1) - F.col("lost")
    whole = 100 * common >= config.percent * (common + 2 * F.col("lost"))
    parts = F.when(whole, F.array(F.struct("start", "end", "component_id"))).otherwise(F.col("spans"))
    found = chains.select("doc_id", "first_doc_id", "shift", F.explode(parts).alias("s")).select("doc_id", "s.start", "s.end", "s.component_id", "first_doc_id", (F.col("s.start") - F.col("shift")).alias("first_start"))
    return found.union(spans.where("inner").select(*_SPAN))


def _similar(places: DataFrame, groups: DataFrame) -> DataFrame:
    """Later paragraphs of clusters of similar ones."""
    found = _later(places.join(groups, "group"), "component")
    return found.select("doc_id", "start", (F.col("start") + F.col("n_words")).alias("end"), F.col("component").alias("component_id"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def disjoint(spans: DataFrame, least: int) -> DataFrame:
    """Spans (_SPAN) of each document that overlap become one; those of fewer than ``least`` words go.

    So do spans that touch, here and (but for ``SLACK`` words) in the document of their first
    occurrence.  A window holds the spans of one document.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end", "first_doc_id", "first_start", "component_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shift = F.col("start") - F.col("first_start")
    goes_on = (F.col("start") == reach) & (F.col("first_doc_id") == F.lag("first_doc_id").over(order)) & (F.abs(shift - F.lag(shift).over(order)) <= SLACK)
    new = spans.withColumn("new", F.when((F.col("start") < reach) | goes_on, 0).otherwise(1))
    numbered = new.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opening = F.min(F.struct("start", (-F.col("end")).alias("back"), "first_doc_id", "first_start", "component_id"))
    merged = numbered.groupBy("doc_id", "span").agg(opening.alias("at"), F.max("end").alias("end")).where(F.col("end") - F.col("at.start") >= least)
    n_words, reached = F.col("end") - F.col("at.start"), -F.col("at.back") - F.col("at.start")
    return merged.select("doc_id", "at.start", n_words.cast("int").alias("n_words"), "at.component_id", "at.first_doc_id", "at.first_start", reached.cast("int").alias("first_words"))


def without_passages(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) with the words of the spans (doc_id, start, n_words) cut out of the texts.

    What stands between the words that stay, blanks and newlines, is kept before each word; a
    text without a span stays as it is.
    """
    spans = cut(removed.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("_spans")))
    rows = attach(docs.withColumn("_id", F.col("doc_id").cast("long")), spans, ["_id"], "left").drop("_id")
    at, last = docs.columns.index("text"), len(docs.columns)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import regex

        word = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(last).to_pylist()):
                if not spans or not texts[i]:
                    continue
                bounds = [m.span() for m in word.finditer(texts[i])]
                out, done = [], 0
                for s in spans:
                    out.append(texts[i][done : bounds[s["start"]][0]])
                    done = bounds[s["start"] + s["n_words"] - 1][1]
                texts[i] = "".join([*out, texts[i][done:]])
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return rows.mapInArrow(run, docs.schema)
