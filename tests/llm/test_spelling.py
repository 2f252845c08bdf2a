import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codicil.llm.spelling import SpellingConfig, deletion_keys, roots, spelling_variants

from .helpers import documents

SF = "/root/testdata/sf0.001"


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows):
    n = counts(rows)
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by.get(len(w) + d, ()) if one_edit(w, v)] for w in n}
    forms = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best
    out = set()
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n[w], len(near[w]), n[forms[w]] if w in forms else None))
    return out


def found(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_equals_brute_force_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = spelling_variants(docs)
    rows = got.collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows} == want and len(rows) == len(want)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_edges(spark):
    r = random.Random(3)
    words = ["governor", "governer", "govenor", "gouvernör", "gouverneur", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "baaaaaaa", "Éclairage", "éclairage", "x" * 3000, "x" * 2999, "x" * 2999 + "y", "abcdefg", "abcdefgh", "abcdefghi", "a×÷bcdef"]
    texts = [" ".join(r.choices(words, weights=[400, 30, 3, 9, 8, 7, 6, 5, 5, 9, 60, 1, 1, 1, 900, 80, 7, 4], k=120)) for _ in range(60)]
    texts += [None, "", " \n", "short words only", "1" * 50, "tie-tie", texts[0]]
    docs = documents(spark, texts, [*range(len(texts) - 1), 0])
    rows = [(i, t) for i, t in zip([*range(len(texts) - 1), 0], texts)]
    want = brute(rows)
    assert {w[1] for w in want} > {None} and any(w[2] != w[1] is not None for w in want)
    assert found(spelling_variants(docs.withColumnsRenamed({"rank": "word", "lang": "n", "source": "id"}))) == want
    assert found(spelling_variants(docs, SpellingConfig(words=50, places=64))) == want
    some = spark.createDataFrame([(None, "wonderful wonderful"), (None, None), (4, "wonderfull " * 3)], "doc_id long, text string")
    assert found(spelling_variants(some)) == brute([(None, "wonderful wonderful"), (4, "wonderfull " * 3)])
    assert spelling_variants(docs.where("false")).count() == 0


def test_ties_take_the_smallest_word(spark):
    config = SpellingConfig(typo=0)
    docs = spark.createDataFrame([(1, "planets " * 40 + "planetz " * 40 + "planeté " * 40 + "planett planett")], "doc_id long, text string")
    assert ("planett", "planets", "planets", 2, 3, 40) in found(spelling_variants(docs, config))


def test_chains_lead_to_the_last_form(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)] + [("a", "b")], "word string, form string")
    assert {tuple(r) for r in roots(forms).collect()} == {(f"w{k}", "w19") for k in range(19)} | {("a", "b")}
    assert roots(forms.where("false")).count() == 0


@pytest.mark.parametrize("places", [16, 1 << 18])
def test_keys_are_those_of_the_strings(places):
    words = ["", "a", "abc", "aab", "aaab", "bbbb", "ab", "aa", "xyzÿxyz"]
    key = {}
    for index, position, opens, keys in deletion_keys(words, places):
        for i, p, o, k in zip(index, position, opens, keys):
            w = words[i]
            rest = w if p < 0 else w[:p] + w[p + 1 :]
            assert key.setdefault(rest, k) == k
            assert p < 0 or o == (p == 0 or w[p] != w[p - 1])
    assert len(set(key.values())) == len(key)
    assert np.int64(key["ab"]) == key["ab"]
