import random

import numpy as np
import pytest

from codicil.llm import _text as X
from codicil.llm.graph import components
from codicil.llm.minhash_dedup import MinHashConfig, near_duplicates

from .helpers import documents, edited, prose, words


def brute(texts, ids, width, percent=80):
    sets = {}
    for i, t in zip(ids, texts):
        w = words(t, lower=True)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    base, other = prose(1, 150), prose(2, 90)
    texts = [base, base.upper(), other, edited(base, 3, 1), edited(base, 9, 2), edited(base, 14, 3), edited(base, 20, 4), edited(other, 4, 5)]
    texts += [None, "", "one", "one", "ONE", "one two", "one  two\n", " \t ", prose(9, 5000)]
    texts += [edited(base, random.Random(k).randint(1, 25), 100 + k) for k in range(60)]
    ids = list(range(10, 10 + len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, texts, ids), MinHashConfig(width=width, block=8)).collect()}
    want = brute(texts, ids, width)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_driver_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([r.text for r in rows], [r.doc_id for r in rows], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, MinHashConfig(width=2)).collect()}
    assert got == want


def test_repeated_ids_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c", "a b c", "d e f", "a b c"], [1, 1, None, 3])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(docs, MinHashConfig(width=2)).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    assert near_duplicates(documents(spark, ["x"]).where("false")).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = prose(1, 120), prose(2, 60), prose(3, 90)
    docs = documents(spark, [a, b, edited(a, 4, 1), edited(b, 2, 2), c], [1, 1, 2, 3, 4])
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, MinHashConfig(width=2)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_super_minhash_is_unbiased_and_tighter_than_independent_draws():
    a = np.arange(1, 41, dtype=np.uint64)
    b = a.copy()
    b[:4] += np.uint64(1000)
    same = [(lambda s: (s[0] == s[1]).mean())(X.super_minhash([X.mix(a), X.mix(b)], 64, seed)) for seed in range(300)]
    j = 36 / 44
    assert abs(np.mean(same) - j) < 0.015
    assert np.var(same) < j * (1 - j) / 64


def test_super_minhash_does_not_depend_on_company():
    sets = [X.mix(np.arange(k, k + n, dtype=np.uint64)) for k, n in ((1, 3), (50, 400), (7, 1), (0, 0))]
    together = X.super_minhash(sets, 40)
    for s, row in zip(sets, together):
        assert (X.super_minhash([s], 40)[0] == row).all()


def test_words_and_hashes_follow_the_bytes():
    import pyarrow as pa

    texts = ["Aa bB\tcc\x0bdd", None, "", "é É x" * 50, "w" * 1000 + " " + "W" * 1000, "\n\n"]
    for (_, data, offsets), t in zip(X.chunks(pa.array(["|".join(x or "" for x in texts)])), [texts]):
        starts, ends, _ = X.words(data, offsets)
        assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == words("|".join(x or "" for x in t))
    sizes = [len(s) for s in X.shingle_sets(pa.array(texts), 2)]
    assert sizes == [len({tuple(words(t, True)[k : k + 2]) for k in range(max(0, len(words(t, True)) - 1))}) or (1 if words(t) else 0) for t in texts]
    same = list(X.shingle_sets(pa.array(["w" * 1000, "W" * 1000]), 2))
    assert (same[0] == same[1]).all()


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    random.Random(3).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(9)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
