import hashlib
import math
import random
import zlib

import pytest

from codicil.llm.prefix_trie import TrieConfig, coded_turns, finish, prefix_trie, rebuilt

SF = "/root/testdata/sf0.001"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    if not convs:
        return set()
    nodes = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for s, members in nodes.items():
        below = [x for x in nodes if x[: len(s)] == s]
        children = [x for x in below if len(x) == len(s) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(s))))
        out.add((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


SCHEMA = "conv_id long, turn long, role string, text string"
CONFIGS = [TrieConfig(), TrieConfig(members=3, turns=40, group=20, chunk=6)]


@pytest.mark.parametrize("config", CONFIGS)
def test_equals_brute_force_over_the_table(spark, config):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = prefix_trie(rebuilt(coded_turns(df)), config)
    assert {t for _, t in got.dtypes if t != "bigint"} == {"string"}
    assert found(got) == brute(sequences([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


@pytest.mark.parametrize("config", CONFIGS)
def test_odd_rows(spark, config):
    r = random.Random(5)
    rows = []
    for c in range(40):  # a hot conversation, hot first turns, prefixes of each other, repeated rows and turns
        n = r.choice([1, 2, 3, 3, 3, 6, 9])
        texts = ["hot", "again", "end"] if c % 3 == 0 else [r.choice(["hot", "hot", "é" * r.randint(0, 3)]) for _ in range(n)]
        rows += [(c, k, "user", t) for k, t in enumerate(texts)]
    rows += [(60, None, None, None), (60, 1, "user", "hot"), (60, 1, "user", "hot"), (61, 2, "x", "b"), (61, 2, "x", "a"), (61, 2, None, "xa"), (None, 0, "user", "nobody"), (-3, 0, "user", "below"), (73, 0, "user", "no base"), (10**12, 0, "user", "x" * 5000)]
    rows += [(c, k, "user", "turn" if k < n else f"{k}") for c, n in ((99, 3), (95, 4)) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie(rebuilt(coded_turns(df.selectExpr("*", "1 AS depth", "2 AS code", "3 AS position", "4 AS bucket"))), config)) == brute(sequences(rows))
    plain = sequences([])
    for conv, turn, role, text in rows:
        if conv is not None:
            plain.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    plain = {c: [t[3] for t in sorted(x)] for c, x in plain.items()}
    assert found(prefix_trie(coded_turns(df), config)) == brute(plain)


def test_no_rows_and_no_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(coded_turns(none))).count() == 0
    few = spark.createDataFrame([(c, 0, "user", "t") for c in (1, 2, 3, 4, 6, 7, 8, 9)], SCHEMA)
    want = brute(sequences([(c, 0, "user", "t") for c in (1, 2, 3, 4, 6, 7, 8, 9)]))
    assert any(d == 0 and n and ends != hashlib.sha256(b"").hexdigest() for _, d, _, n, _, _, _, ends in want)
    assert found(prefix_trie(rebuilt(coded_turns(few)))) == want


def test_a_bucket_is_finished_by_three_way_splits():
    codes = [[7, 1, 2], [7, 1, 3], [7], [7, 0], [7, 1, 2], [7, 5, 5, 5]]
    nodes = finish([10, 11, 12, 13, 14, 15], codes, [[2] * len(c) for c in codes], 4)
    assert nodes[0] == [10, 5, -1, 6, 3, 4, 2 * 5 + 2 * 2 + 2, [12]]
    assert sorted((n[0], n[1], n[3]) for n in nodes) == [(10, 5, 6), (10, 6, 3), (10, 7, 2), (11, 7, 1), (13, 6, 1), (15, 6, 1), (15, 7, 1), (15, 8, 1)]
