import math
import os
import random
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from codicil.llm.exact_topk import TopKConfig, exact_topk, term_at_a_time
from codicil.llm.quality_classifier import PerplexityConfig, bigram_counts, kneser_ney, perplexities, quality_judged, quality_kept

from .helpers import documents, prose, words


def brute_model(texts):
    """A plain interpolated modified Kneser-Ney bigram model over words: p(word | before), and all words."""
    counts = Counter(pair for t in texts if words(t) for pair in pairs(t))

    def discounts(values):
        n = [sum(c == k for c in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for x, k in zip(raw, (1, 2, 3))]

    kinds, total, lost = Counter(w for _, w in counts), Counter(), Counter()
    d2, d1 = discounts(counts.values()), discounts(kinds.values())
    for (b, _), c in counts.items():
        total[b] += c
        lost[b] += d2[min(c, 3) - 1]
    spare = sum(d1[min(c, 3) - 1] for c in kinds.values()) / len(counts) / (len(kinds) + 1)

    def one(w):
        return spare + ((kinds[w] - d1[min(kinds[w], 3) - 1]) / len(counts) if w in kinds else 0.0)

    def p(b, w):
        if b not in total:
            return one(w)
        c = counts.get((b, w), 0)
        return ((c - d2[min(c, 3) - 1]) if c else 0.0) / total[b] + lost[b] / total[b] * one(w)

    return p, set(kinds), set(total)


def pairs(text):
    w = ["<s>", *words(text), "</s>"]
    return list(zip(w, w[1:]))


def log_perplexity(p, text):
    return -sum(math.log(p(b, w)) for b, w in pairs(text)) / len(pairs(text))


TEXTS = [prose(k % 5, 60 + k) + ".\nEnd, 12 Été!" for k in range(8)] + ["", None, "the the the the cat"]


@pytest.mark.parametrize("config", [PerplexityConfig(), PerplexityConfig(common=10, rounds=3, shard_bytes=100), PerplexityConfig(common=0, rounds=1)])
def test_perplexity_equals_a_plain_model(spark, config):
    table, unknown = kneser_ney(bigram_counts(documents(spark, TEXTS)))
    p, _, _ = brute_model(TEXTS)
    asked = ["new text, not seen", TEXTS[0], "ЖЖЖ", "a", None, "", TEXTS[3] + " more End, 12", "the cat the the " * 50, TEXTS[0]]
    docs = documents(spark, asked).withColumn("ref", F.xxhash64("doc_id"))
    got = {r.doc_id: r for r in docs.join(perplexities(docs, table, unknown, config), "ref", "left").collect()}
    for i, t in enumerate(asked):
        assert got[i].n_words == (len(words(t)) or None)
        assert got[i].log_perplexity is None if not t else abs(got[i].log_perplexity - log_perplexity(p, t)) < 1e-4


def test_probabilities_sum_to_one():
    p, known, contexts = brute_model(TEXTS)
    for b in [*contexts, "unknown"]:
        assert abs(sum(p(b, w) for w in known) + p(b, "another word") - 1) < 1e-9


def test_verdicts_equal_plain_thresholds(spark):
    texts = [prose(k % 30, 40 + k % 7) for k in range(80)] + [prose(900, 30), "x " * 40, None, "", " \n"]
    ids = [*range(84), 3]
    langs = ["en", "fr", None]
    docs = documents(spark, texts, ids, langs)
    trusted = spark.createDataFrame([(k,) for k in range(70)], "doc_id long")
    config = PerplexityConfig(low=0.1, high=0.8)
    held = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(config.held_out)) == 0).collect()}
    rows = list(zip(ids, texts, (langs * 30)[:85]))
    p, _, _ = brute_model([t for i, t, _ in rows if i < 70 and i not in held])
    scored = [(i, lang, log_perplexity(p, t) if words(t) else None) for i, t, lang in rows]

    def quantile(values, q):
        values = sorted(v for v in values if v is not None)
        return values[max(0, math.ceil(q * len(values)) - 1)]

    middle = {k: quantile([x for j, g, x in scored if j in held and g == k], 0.5) for k in langs}
    above = quantile([x - middle[g] for j, g, x in scored if j in held and x is not None], config.high)
    want = []
    for i, lang, s in scored:
        low = quantile([x for j, k, x in scored if j < 70 and k == lang], config.low)
        high = quantile([x for j, k, x in scored if j in held and k == lang], config.high)
        high = max(high, middle[lang] + above)
        want.append((i, s is not None and low - 1e-6 <= s <= high + 1e-6))
    got = [(r.doc_id, r.kept) for r in quality_judged(docs, trusted, config).collect()]
    assert sorted(got) == sorted(want)
    kept = [r.doc_id for r in quality_kept(docs, trusted, config).collect()]
    assert sorted(kept) == sorted(i for i, k in want if k)


def test_clean_documents_stay_and_junk_goes(spark):
    from codicil.llm.queries import op2_quality_classifier

    d = "/root/testdata/sf0.01"
    rows = op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").cache()
    good, bad = rows.where("quality = 1 and toxic = 0"), rows.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.35 * bad.count()


def test_held_out_documents(spark):
    """Trained on two thirds of the trusted documents, the model keeps the rest."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0")
    rows = quality_judged(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 3 <> 0"))
    rest = rows.join(labels.where("doc_id % 3 = 0"), "doc_id", "left_semi").cache()
    assert rest.where("kept").count() >= 0.9 * rest.count()


def test_languages_nulls_and_no_trusted_text(spark):
    known = prose(1, 40).split()
    texts = [" ".join(random.Random(k).choices(known, k=50)) for k in range(48)] + [None, "", "§§§ §§§ ¤¤¤"]
    docs = documents(spark, texts, langs=["en", "fr", None]).withColumnRenamed("rank", "low")
    trusted = spark.createDataFrame([(k,) for k in range(48)] + [(None,)], "doc_id long")
    rows = {r.doc_id: r for r in quality_judged(docs, trusted, PerplexityConfig(low=0.0, high=1.0)).collect()}
    assert all(rows[k].kept for k in range(48)) and not rows[48].kept and not rows[49].kept and not rows[50].kept
    assert len({rows[k].high for k in range(3)}) >= 2
    none = {r.doc_id: r.kept for r in quality_judged(docs, trusted.where("false")).collect()}
    assert none[0] and none[50] and not none[48]
    assert quality_judged(docs.where("false"), trusted).count() == 0


def brute_topk(rows, k, every):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in kept if i == q for c, w in kept if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return out


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(90)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (420, [float("inf")] + [0.0] * 7), (440, [0.0] * 8), (460, []), (480, [1.0, -1.0]), (None, [1.0] * 8)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    for config in (TopKConfig(k=20, every=20), TopKConfig(k=5, every=7, candidates=10, queries=3, tile=2)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk(docs, config).collect())
        assert got == brute_topk(rows, config.k, config.every)
    assert exact_topk(docs.where("false")).count() == 0
    assert [(r.vec_id, r.rank) for r in exact_topk(docs.where("vec_id IN (20, 21)")).collect()] == [(21, 1)]
    again = [*rows[:40], *rows[:25], (20, rows[30][1]), (20, rows[31][1]), (3, rows[8][1])]
    twice = spark.createDataFrame([(i, v, "x") for i, v in again], "vec_id long, embedding array<float>, query_id string")
    assert sorted(map(tuple, exact_topk(twice).collect())) == brute_topk(again, 20, 20)


def test_sparse_terms_scatter():
    rng = np.random.default_rng(2)
    m = rng.integers(-5, 6, size=(200, 30)) * (rng.random((200, 30)) < 0.1)
    q = rng.integers(-5, 6, size=(9, 30)) * (rng.random((9, 30)) < 0.2)
    got = list(zip(*term_at_a_time(np.arange(1000, 1009), q, np.arange(200), m, 4, 4)))
    for i in range(9):
        scores = m @ q[i]
        want = sorted(range(200), key=lambda c: (-scores[c], c))[:4]
        assert sorted(c for a, c, _ in got if a == 1000 + i) == sorted(want)


def test_a_hot_word_that_the_model_lacks_travels_with_the_text(spark):
    """One unseen word is half of all words: its keys go to no shard, and the scores are those of the plain model."""
    from codicil.llm import quality_classifier as Q

    texts = [prose(k, 60) for k in range(40)]
    hot = [" ".join(w for x in prose(100 + k, 60).split() for w in (x, "unseenword")) for k in range(40)]
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts + hot)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(40)], "doc_id long")
    frequent = Q.frequent_grams(rows.select(F.col("doc_id").alias("ref"), "text"), 1 << 20, Q.PerplexityConfig())
    assert frequent.count() > 0
    few = Q.PerplexityConfig(frequent=0, common=1)
    a, b = ({r.doc_id: round(r.log_perplexity, 6) for r in Q.quality_scores(rows, trusted, c).collect()} for c in (Q.PerplexityConfig(), few))
    assert a == b and len(a) == 80


def test_common_grams_leave_no_shuffle_files_and_no_python_rows(spark, monkeypatch):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        paths = disk.getAllFiles().mkString("\n").split("\n")
        return {p: os.path.getsize(p) for p in paths if "shuffle_" in p and os.path.exists(p)}

    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("n-grams became rows of Python objects"))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(300)]
    docs = documents(spark, texts).select(F.col("doc_id").alias("ref"), "text")
    table, unknown = kneser_ney(bigram_counts(docs))
    before = kept()
    perplexities(docs, table, unknown, PerplexityConfig(common=1000, frequent=2000))
    new = [size for path, size in kept().items() if path not in before]
    assert sum(new) < table.count()  # a shuffle of the table takes several bytes for each of its rows


def test_broadcasts_go_with_the_work(spark):
    docs = documents(spark, TEXTS).select(F.col("doc_id").alias("ref"), "text")
    table, unknown = kneser_ney(bigram_counts(docs))
    at = spark.sparkContext._temp_dir
    before = set(os.listdir(at))
    perplexities(docs, table, unknown, PerplexityConfig())
    assert set(os.listdir(at)) <= before


def test_grams_are_looked_up_in_order_and_hashes_are_those_of_the_bytes():
    import hashlib

    import pyarrow as pa

    from codicil.llm import _text as X
    from codicil.llm import quality_classifier as Q

    r = np.random.default_rng(6)
    known, grams = np.unique(r.integers(0, 90, 40).astype(np.uint64)), r.integers(0, 100, 500).astype(np.uint64)
    by, at, hit = Q._looked_up(known, grams)
    assert sorted(by) == list(range(500)) and (np.diff(at) >= 0).all()
    assert hit.tolist() == np.isin(grams[by], known).tolist() and (known[at[hit]] == grams[by][hit]).all()
    assert not Q._looked_up(known[:0], grams)[2].any()

    def plain(word):
        if len(word) > X.LONG_WORD:
            return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        one = lambda x: int(X.mix(np.array([x % 2**64], dtype=np.uint64))[0])
        h = one(len(word) + 0x9E3779B97F4A7C15)
        for k in range(0, len(word), 8):
            h = one(h * 3 % 2**64 ^ int.from_bytes(word[k : k + 8], "little"))
        return h

    texts = [" ".join("xyZ"[k % 3] * n for k, n in enumerate((1, 7, 8, 9, 16, 17, 255, 256, 257, 300, 3))), "", "last Été"]
    ((_, data, offsets),) = X.chunks(pa.array(texts))
    starts, ends, _ = X.words(data, offsets)
    assert X.word_hashes(data, starts, ends, lower=False).tolist() == [plain(w.encode()) for t in texts for w in t.split()]
