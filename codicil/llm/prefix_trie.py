"""The prefix trie of conversations: every distinct sequence of first turns, with what sharing it saves.

1. Turns become numbers: a dictionary of the distinct (role, text), by digest, gives each a code.
2. Radix partitioning from the first turn on (most significant digit first): all conversations
   stand in the root's bucket; each round deals a bucket's conversations by the code of their
   next turn.  A bucket of one conversation is a tail, whose nodes are its own remaining turns;
   one that fits a task is local; only larger ones go into the next round, as nodes of the upper
   trie, so a group of any size is counted by partial aggregation and never gathered.
3. Local buckets, whole subtries, are finished in tasks by multikey quicksort (``finish``): the
   recursion into equal codes emits the nodes.
4. Sums of subtries go up along the paths of the upper trie.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ._common import attach, bounded, cut, drop, running_sum


@dataclass(frozen=True)
class TrieConfig:
    #: Conversations and remaining turns of a local bucket at most, and turns in a task's group, about.
    members: int = 4096
    turns: int = 1 << 17
    group: int = 1 << 18
    #: Bytes of conversation ids that travel as one row of a large node's digest.
    chunk: int = 1 << 16


def coded_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, code, n_bytes of conversations (conv_id, turn, role, text).

    Positions count from 0 by turn, null first; equal turns stand in the order of the digest of
    role and text.  Null roles and texts are empty.  Rows with a null conv_id belong to no
    conversation.  Codes are the same for equal (role, text).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length keeps ("a", "b") and ("ab", "") apart.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("dated"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).alias("one"))
    placed = cut(running_sum(rows, "conv_id", ["dated", "turn", "digest"], "one", "position").drop("dated", "turn", "one"))
    codes = cut(placed.select("digest").distinct().withColumn("code", F.monotonically_increasing_id()))
    out = cut(attach(placed, codes, ["digest"], "inner").select("conv_id", "position", "code", "n_bytes"))
    drop(placed, codes)
    return out


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations (coded turns) whose first turns come from another one: each conv_id c begins with the first
    h turns of c - c % every, h = crc32(decimal c) % most, and goes on with its own after its first h
    (% has the sign of c).

    Returns conv_id, position, code, n_bytes, and a row of null position for each conversation
    that has no turn left.
    """
    convs = cut(turns.select("conv_id").distinct())
    c = F.col("conv_id")
    plan = convs.select("conv_id", (c - c % every).alias("base"), (F.crc32(c.cast("string")) % most).alias("h"))
    heads = cut(turns.where(F.col("position") < most - 1))
    sizes = heads.groupBy(F.col("conv_id").alias("b")).count()
    plan = plan.join(sizes, plan.base == sizes.b, "left").select("conv_id", "base", "h", F.least("h", F.coalesce("count", F.lit(0))).alias("first"))
    plan = cut(plan)
    lent = heads.withColumnRenamed("conv_id", "b")
    lent = plan.join(lent, (plan.base == lent.b) & (lent.position < plan.h)).select("conv_id", "position", "code", "n_bytes")
    own = turns.join(plan.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & (F.col("position") >= F.col("h")))
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("first")).alias("position"), "code", "n_bytes")
    some = cut(lent.union(own))
    without = convs.join(some.select("conv_id").distinct(), "conv_id", "left_anti")
    null = F.lit(None).cast("long")
    out = cut(some.union(without.select("conv_id", null, null, null)))
    drop(convs, heads, plan, some)
    return out


def finish(convs: list[int], codes: list[list[int]], sizes: list[list[int]], depth: int):
    """Nodes of a bucket of two or more conversations whose codes from ``depth`` on are given, all with the same first one.

    Yields (conv_id, depth, index of the parent node or -1, n_convs, n_children, n_leaves, saved,
    member ids that end here), the bucket's own node first.  ``convs`` ascend.  Multikey
    quicksort: a stack entry holds conversations alike up to a position; they are split three
    ways by the code there, and those equal to the pivot's are a node and go on at the next.
    """
    nodes: list[list] = []
    stack = [(list(range(len(convs))), 0, -1)]
    while stack:
        rows, at, parent = stack.pop()
        while len(rows) > 1:
            pivot = codes[rows[len(rows) // 2]][at]
            less = [r for r in rows if codes[r][at] < pivot]
            more = [r for r in rows if codes[r][at] > pivot]
            if less:
                stack.append((less, at, parent))
            if more:
                stack.append((more, at, parent))
            rows = [r for r in rows if codes[r][at] == pivot] if less or more else rows
            ends = [convs[r] for r in rows if len(codes[r]) == at + 1]
            nodes.append([convs[rows[0]], depth + at + 1, parent, len(rows), 0, 0, (len(rows) - 1) * sizes[rows[0]][at], ends])
            parent, at = len(nodes) - 1, at + 1
            if ends:
                rows = [r for r in rows if len(codes[r]) > at]
        for r in rows:  # one conversation is left: its remaining turns are a chain
            for k in range(at, len(codes[r])):
                nodes.append([convs[r], depth + k + 1, parent, 1, 0, 0, 0, [convs[r]] if k + 1 == len(codes[r]) else []])
                parent = len(nodes) - 1
    for node in reversed(nodes):  # children stand behind their parents
        if not node[4]:
            node[5] = 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def hash_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [f.split()[0] for f in NODE.split(", ")]


def _local(turns: DataFrame, buckets: DataFrame, config: TrieConfig) -> DataFrame:
    """The nodes (NODE) of local buckets (conv_id, bucket, depth, parent); depth: of the bucket's parent."""
    mine = buckets.withColumnRenamed("conv_id", "c")
    rows = turns.join(mine, (F.col("conv_id") == F.col("c")) & (F.col("position") >= F.col("depth"))).drop("c")
    rows = cut(rows)
    groups = max(1, rows.count() // config.group)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("bucket", "depth"), F.lit(groups)))

    def run(table):
        import numpy as np
        import pyarrow as pa

        bucket, depth, conv, position, code, size, parent = (table.column(c).to_numpy() for c in ("bucket", "depth", "conv_id", "position", "code", "n_bytes", "parent"))
        order = np.lexsort((position, conv, bucket, depth))
        bucket, depth, conv, code, size, parent = (x[order] for x in (bucket, depth, conv, code, size, parent))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (depth[1:] != depth[:-1]))
        begins = np.flatnonzero(new | np.append(True, conv[1:] != conv[:-1]))
        ends = np.append(begins[1:], len(order))
        edges = np.append(np.flatnonzero(new[begins]), len(begins))
        code, size, out = code.tolist(), size.tolist(), []
        for lo, hi in zip(edges[:-1], edges[1:]):
            at, to = begins[lo:hi].tolist(), ends[lo:hi].tolist()
            first = at[0]
            nodes = finish(conv[begins[lo:hi]].tolist(), [code[a:b] for a, b in zip(at, to)], [size[a:b] for a, b in zip(at, to)], int(depth[first]))
            above = int(parent[first])
            out += [(n[0], n[1], nodes[n[2]][0] if n[2] >= 0 else above, *n[3:7], hash_of(n[7])) for n in nodes]
        return pa.table([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], names=_NODE)

    return rows.groupBy("group").applyInArrow(run, NODE)


def _digests(ends: DataFrame, config: TrieConfig) -> DataFrame:
    """node_depth, node, sha of the ids (conv_id) that end at large nodes (depth, bucket).

    A range exchange deals even one node's ids over all tasks, which join their runs into chunks
    of text; the chunks of a node are then hashed in order as a stream, so no task holds more
    than a chunk.
    """
    most = config.chunk
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches):
        import pyarrow as pa

        node, low, ids, size = None, None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([low]), pa.array([",".join(ids)])], names=["depth", "bucket", "low", "ids"])

        for batch in batches:
            for depth, bucket, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "bucket", "conv_id"))):
                if ids and (node != (depth, bucket) or size >= most):
                    yield flush()
                    ids, size = [], 0
                if not ids:
                    node, low = (depth, bucket), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield flush()

    def hashes(batches):
        import pyarrow as pa

        node, state = None, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["depth", "bucket", "sha"])

        for batch in batches:
            for depth, bucket, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "bucket", "ids"))):
                if node != (depth, bucket):
                    if node is not None:
                        yield flush()
                    node, state = (depth, bucket), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield flush()

    by = ["depth", "bucket", "conv_id"]
    parts = cut(ends.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(chunks, "depth long, bucket long, low long, ids string"))
    parts = parts.repartition(n, "depth", "bucket").sortWithinPartitions("depth", "bucket", "low").select("depth", "bucket", "ids")
    return parts.mapInArrow(hashes, "depth long, bucket long, sha string")


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def prefix_trie(turns: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, position (from 0, without gaps), code, n_bytes, as ``coded_turns`` gives them;
    a row of null position stands for a conversation without turns.  A node is a distinct
    sequence of first turns; conv_id is its smallest member, so (conv_id, depth) names it.
    Sums run over the node's subtrie.  The digest is that of the ids of the members that end at
    the node, in order.  Equal conversations share all their nodes.  No rows, no result, not
    even a root.
    """
    node: Column = F.col("position")
    sizes = cut(turns.groupBy("conv_id").agg(F.count("position").alias("size")))
    root = sizes.agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).first()
    if not root["n"]:
        return turns.sparkSession.createDataFrame([], NODE)
    spark = turns.sparkSession
    upper = [spark.createDataFrame([(0, root["first"], None, root["n"], 0, [root["first"]])], "depth long, bucket long, parent long, n long, n_bytes long, path array<long>")]
    active = sizes.select("conv_id", "size", F.lit(root["first"]).cast("long").alias("bucket"))
    ends, tails, locals_, cuts, depth = [], [], [], [], 0
    while True:
        at = F.lit(depth).cast("long").alias("depth")
        ends.append(active.where(F.col("size") == depth).select(at, "bucket", "conv_id"))
        here = turns.where(node == depth).select(F.col("conv_id").alias("c"), "code", "n_bytes")
        going = active.where(F.col("size") > depth).join(here, F.col("conv_id") == F.col("c")).drop("c")
        going = cut(going)
        children = going.groupBy("bucket", "code").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum(F.col("size") - depth).alias("rest"), F.max("n_bytes").alias("n_bytes"))
        kind = F.when(F.col("n") == 1, 0).when((F.col("n") <= config.members) & (F.col("rest") <= config.turns), 1).otherwise(2)
        children = cut(children.withColumn("kind", kind))
        dealt = cut(attach(going, children.select("bucket", "code", "first", "kind"), ["bucket", "code"], "inner").select("conv_id", "size", "bucket", "first", "kind"))
        drop(going)
        cuts += [children, dealt]
        tails.append(dealt.where("kind = 0").select("conv_id", "size", at, F.col("bucket").alias("parent")))
        locals_.append(dealt.where("kind = 1").select("conv_id", F.col("first").alias("bucket"), at, F.col("bucket").alias("parent")))
        large = children.where("kind = 2")
        if bounded(large, 0):
            break
        above = upper[-1].select(F.col("bucket").alias("b"), "path")
        grown = large.join(above, F.col("bucket") == F.col("b")).select(F.lit(depth + 1).cast("long").alias("depth"), F.col("first").alias("bucket"), F.col("bucket").alias("parent"), "n", "n_bytes", F.array_append("path", F.col("first")).alias("path"))
        upper.append(cut(grown))
        active = dealt.where("kind = 2").select("conv_id", "size", F.col("first").alias("bucket"))
        depth += 1

    inner = cut(_local(turns, _together(locals_), config))
    tail = _together(tails).withColumnRenamed("conv_id", "c")
    chain = turns.join(tail, (F.col("conv_id") == F.col("c")) & (node >= F.col("depth")))
    last, one, none = node + 1 == F.col("size"), F.lit(1).cast("long"), F.lit(0).cast("long")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256))
    single = chain.select("conv_id", (node + 1).alias("depth"), F.when(node == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), digest.alias("ends_sha256"))

    # What hangs directly below each node of the upper trie, then sums along the paths.
    nodes = cut(_together(upper))
    tops = _together([x.select("depth", "bucket", "parent").distinct() for x in locals_])
    tops = inner.join(tops.withColumnRenamed("depth", "d"), (F.col("conv_id") == F.col("bucket")) & (inner.depth == F.col("d") + 1))
    below = [
        _together(tails).groupBy("depth", "parent").agg(F.count("*").alias("children"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved")),
        tops.groupBy(F.col("d").alias("depth"), "parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")),
        nodes.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), "parent").agg(F.count("*").alias("children"), none.alias("leaves"), none.alias("saved")),
    ]
    below = _together(below).groupBy(F.col("depth").alias("d"), F.col("parent").alias("p")).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    known = nodes.join(below, (F.col("depth") == F.col("d")) & (F.col("bucket") == F.col("p")), "left").drop("d", "p")
    children = F.coalesce("children", none)
    known = cut(known.select("depth", "bucket", "parent", "n", "path", children.alias("children"), F.when(children == 0, one).otherwise(F.coalesce("leaves", none)).alias("leaves"), (F.coalesce("saved", none) + (F.col("n") - 1) * F.col("n_bytes")).alias("saved")))
    sums = known.select("leaves", "saved", F.posexplode("path").alias("d", "p")).groupBy("d", "p").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    shas = _digests(_together(ends), config).withColumnsRenamed({"depth": "e", "bucket": "q"})
    full = known.join(sums, (F.col("depth") == F.col("d")) & (F.col("bucket") == F.col("p"))).join(shas, (F.col("depth") == F.col("e")) & (F.col("bucket") == F.col("q")), "left")
    full = full.select(F.col("bucket").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    out = cut(_together([full, inner.select(_NODE), single]))
    drop(*cuts, sizes, inner, nodes, known, *upper[1:])
    return out
