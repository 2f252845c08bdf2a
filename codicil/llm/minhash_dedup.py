"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and components.

1. One pass over the texts gives each row its number of distinct shingles, a 128-bit key of
   the shingle set and the band keys of its SuperMinHash signature.
2. Rows with equal sets fold into one representative (the smallest id), so a group of exact
   copies costs one row from here on.
3. Representatives meet in band buckets.  Each bucket compares its members with one centre,
   the member whose other buckets are fullest; pairs are confirmed on full sets.
4. Buckets whose other members then still lie in different components are compared in full between
   those components, block against block, each pair in the first bucket that it shares.
   So no link that banding can see is lost, and no bucket lists its pairs.
5. Components of the confirmed links go back to all rows.  Over the whole table they come from
   alternating large and small stars (``graph``); union-find works inside a block.

With 32 bands of 5 values, a pair of similarity 0.8 shares no bucket with a probability
of 3e-6, and one of 0.9 with 1e-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ._common import bounded, cut, drop, id_filter, maybe_in, small_batches
from .graph import components


@dataclass(frozen=True)
class MinHashConfig:
    #: Words in a shingle.
    width: int = 5
    #: Link if 100 * |A and B| >= percent * |A or B|.
    percent: int = 80
    bands: int = 32
    rows: int = 5
    seed: int = 0
    #: Rows of one side of a block of step 4, and entries of their sets, about.
    block: int = 512
    block_entries: int = 1 << 21


SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def sketch(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """doc_id, n_shingles, set_key, bands of every row; no shuffle."""
    small_batches(docs.sparkSession)
    width, bands, rows, seed = config.width, config.bands, config.rows, config.seed

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import _text as X

        def flush(ids, sets):
            keys = X.band_keys(X.super_minhash(sets, bands * rows, seed), bands)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), flat], names=["doc_id", "n_shingles", "set_key", "bands"])

        for batch in batches:
            sets, size, first = [], 0, 0
            for s in X.shingle_sets(batch.column(1), width):
                sets.append(s)
                size += len(s) + 64
                if size > 1 << 18:
                    yield flush(batch.column(0).slice(first, len(sets)), sets)
                    first, sets, size = first + len(sets), [], 0
            if sets:
                yield flush(batch.column(0).slice(first, len(sets)), sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def shingles(docs: DataFrame, config: MinHashConfig, wanted) -> DataFrame:
    """id and sorted distinct shingle hashes of the rows that an id filter lets through, which are the wanted and a few more."""
    small_batches(docs.sparkSession)
    width = config.width

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import _text as X

        def flush(ids, sets):
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], names=["id", "set"])

        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(pa.array(maybe_in(wanted, ids.fill_null(0).to_numpy())))
            sets, size, first = [], 0, 0
            for s in X.shingle_sets(batch.column(1), width):
                sets.append(s)
                size += len(s)
                if size > 1 << 18:
                    yield flush(batch.column(0).slice(first, len(sets)), sets)
                    first, sets, size = first + len(sets), [], 0
            if sets:
                yield flush(batch.column(0).slice(first, len(sets)), sets)

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, set array<long>")


def _across(members: DataFrame, sets: DataFrame, config: MinHashConfig) -> DataFrame:
    """Confirmed links between members of a bucket that lie in different components.

    Members: key, id, n, bands, component, main (whether in the component of the bucket's
    centre), of unresolved buckets only.  Members of the main component need not meet each
    other, so blocks of about ``config.block`` other members meet every block of the bucket;
    a group is two blocks, whatever the bucket's size.  A pair counts in the first bucket that
    it shares, and a group returns a forest of its components.
    """
    percent, block = config.percent, config.block
    def blocks(side):
        rows, entries = F.count_if(side), F.sum(F.when(side, F.col("n")))
        return F.ceil(F.greatest(rows / block, F.coalesce(entries, F.lit(0)) / config.block_entries)).cast("int")

    parts = members.groupBy("key").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains"))
    parts = cut(parts.withColumnRenamed("key", "k"))
    dealt = members.join(parts, members.key == parts.k).drop("k")
    hashed = F.xxhash64("id")
    own = F.when(F.col("main"), F.col("others") + F.pmod(hashed, "mains")).otherwise(F.pmod(hashed, F.when(F.col("others") > 0, F.col("others")))).cast("int")
    dealt = dealt.withColumn("part", own)
    meets = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    pairs = F.transform(F.sequence(F.lit(0), meets - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    dealt = dealt.where(meets > 0).select("key", "id", "n", "component", "bands", "part", F.explode(pairs).alias("p"))
    dealt = dealt.select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "id", "n", "component", "bands", "part")
    # Most buckets are small: a task's group holds many, of about as many rows and entries as one pair of full blocks.
    rows, entries = dealt.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, rows // (4 * block), entries // (2 * config.block_entries))
    dealt = dealt.join(sets, "id").withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))

    def run(table):
        import numpy as np
        import pyarrow as pa

        ids, comp, part, key, i, j = (table.column(c).to_numpy() for c in ("id", "component", "part", "key", "i", "j"))
        lists = table.column("bands").combine_chunks()
        width = len(lists.values) // max(1, len(ids))
        bands = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
        lists = table.column("set").combine_chunks()
        flat, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(n) - n
        order = np.lexsort((j, i, key))
        new = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])))
        roots: dict[int, int] = {}

        def find(c):
            while c in roots:
                c = roots[c]
            return c

        def in_common(left, right):
            """How many entries each set of ``left`` shares with each of ``right``."""
            both = np.concatenate([left, right])
            size = n[both]
            at = np.repeat(starts[both] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            owner = np.repeat(np.arange(len(both)), size)
            _, column, times = np.unique(flat[at], return_inverse=True, return_counts=True)
            some = times[column] > 1
            owner, column = owner[some], np.unique(column[some], return_inverse=True)[1]
            out = np.zeros((len(left), len(right)), dtype=np.float32)
            by = np.argsort(column, kind="stable")
            owner, column = owner[by], column[by]
            step = 4096
            for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
                x, y = np.searchsorted(column, (lo, lo + step))
                has = np.zeros((len(both), step), dtype=np.float32)
                has[owner[x:y], column[x:y] - lo] = 1
                out += has[: len(left)] @ has[len(left) :].T
            return out.astype(np.int64)

        found = []
        for lo, hi in zip(new, np.append(new[1:], len(order))):
            rows = order[lo:hi]
            left, right = rows[part[rows] == i[rows[0]]], rows[part[rows] == j[rows[0]]]
            near = (comp[left][:, None] != comp[right]) & (100 * np.minimum(n[left][:, None], n[right]) >= percent * np.maximum(n[left][:, None], n[right]))
            if i[rows[0]] == j[rows[0]]:
                near &= ids[left][:, None] < ids[right]
            if not near.any():
                continue
            left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
            both = in_common(left, right)
            near &= 100 * both >= percent * (n[left][:, None] + n[right] - both)
            for x, y in zip(*np.nonzero(near)):
                x, y = left[x], right[y]
                shared = np.flatnonzero(bands[x] == bands[y])
                if not len(shared) or bands[x][shared[0]] != key[rows[0]]:
                    continue
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b:
                    roots[max(a, b)] = min(a, b)
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("group").applyInArrow(run, "a long, b long")


def linked(reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], config: MinHashConfig) -> DataFrame:
    """(i, component) of the ids that verified links reach.

    reps: id, n (set size), bands, one row for each id; ``sets_of`` gives (id, set) for a table
    of ids, and may give more.
    """
    percent = config.percent
    entries = reps.select("id", "n", F.explode("bands").alias("key"))
    counts = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    counts = cut(counts.withColumnRenamed("key", "k"))
    shared = cut(entries.join(counts, entries.key == counts.k).select("key", "id", "n", "c"))
    central = cut(shared.groupBy("id").agg(F.sum("c").alias("weight")).withColumnRenamed("id", "i"))
    weighed = shared.join(central, shared.id == central.i).select("key", "id", "n", "weight")
    top = F.max(F.struct("weight", F.bitwise_not("id").alias("neg"), "n")).alias("top")
    centres = cut(weighed.groupBy("key").agg(top).select(F.col("key").alias("k"), F.bitwise_not("top.neg").alias("centre"), F.col("top.n").alias("m")))
    tried = shared.join(centres, shared.key == centres.k).where(f"id != centre and 100 * least(n, m) >= {percent} * greatest(n, m)")
    tried = cut(tried.select("id", "centre", "n", "m").distinct())
    drop(counts)

    # Only sets of pairs that sizes leave open travel; buckets left in several components read more below.
    asked = cut(tried.select("id").union(tried.select("centre")).distinct())
    sets = cut(sets_of(asked))
    one = tried.join(sets, "id").withColumnRenamed("set", "one")
    two = one.join(sets.withColumnRenamed("id", "centre").withColumnRenamed("set", "two"), "centre")
    both = F.size(F.array_intersect("one", "two"))
    # Sizes of the sets themselves: rows that share an id may bring several.
    links = two.select("id", "centre", F.size("one").alias("n"), F.size("two").alias("m"), both.alias("both")).where(f"100 * both >= {percent} * (n + m - both)").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    links = cut(links)
    drop(tried, asked, sets, central)
    groups = components(links).withColumnRenamed("id", "i")

    placed = shared.join(groups, shared.id == groups.i, "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    # The centre has met all members of its bucket, so only the others can have a link that is not seen yet.
    heads = centres.join(groups, centres.centre == groups.i, "left").select("k", "centre", F.coalesce("component", "centre").alias("head"))
    others = placed.join(heads, placed.key == heads.k).where("id != centre").select("key", "id", "n", "component", "head")
    split = others.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    split = cut(split.select(F.col("key").alias("k")))
    if not bounded(split, 0):
        some = others.join(split, others.key == split.k).withColumn("main", F.col("component") == F.col("head"))
        known = reps.select(F.col("id").alias("i"), "bands")
        some = cut(some.join(known, some.id == known.i).select("key", "id", "n", "component", "main", "bands"))
        asked = cut(some.select("id").distinct())
        sets = cut(sets_of(asked))
        links = cut(links.union(_across(some, sets, config)))
        drop(some, asked, sets)
        groups = components(links).withColumnRenamed("id", "i")
    drop(shared, centres, split, links)
    return groups


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, any more).

    Words are runs of characters other than space and U+0009..U+000D, A-Z lower-cased; a set
    holds the distinct ``width``-word shingles of the whole text, however long, or the whole
    sequence of a shorter text.  A row without words (null and empty texts) is linked with
    nothing.  component_id is the smallest doc_id that links reach, kept whether it is the
    row's own, so ties between equal texts go to the smallest doc_id.  Rows that share a doc_id
    are one document and are kept or not together.  A row with a null doc_id joins nothing and
    is kept, its component_id null.  Other columns of docs, whatever their names, are not read.
    An empty table gives an empty result.
    """
    rows = cut(sketch(docs, config))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    first = cut(full.groupBy("set_key").agg(F.min("doc_id").alias("id")).withColumnRenamed("set_key", "k"))
    reps = rows.join(first, (rows.set_key == first.k) & (rows.doc_id == first.id)).select("id", F.col("n_shingles").alias("n"), "bands")
    reps = cut(reps)
    plain = cut(rows.select("doc_id", "n_shingles", "set_key"))
    drop(rows)

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingles(docs.where("doc_id is not null"), config, id_filter(ids, "id"))

    groups = linked(reps, sets_of, config)
    named = cut(first.join(groups, first.id == groups.i, "left").select("k", F.coalesce("component", "id").alias("component")))
    drop(reps, first)
    out = plain.join(named, plain.set_key == named.k, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
