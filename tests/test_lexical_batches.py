"""Phrases and titles are matched where the chunks are read, with the rows of the postings' joins."""

import pytest

from codicil.operators import lexical

TEXTS = ["alpha beta gamma delta", "Alpha betaine, alpha beta alpha beta", "beta alpha", "gamma alpha beta gamma", "delta x alpha", None, "", "alpha alpha alpha beta gam", "betaalpha beta gamma deltas"]


def inputs(spark):
    rows = [(i, f"law {t.split()[-1] if t else ''}", t and t.split(",")[0], t, 1 << (i % 2)) for i, t in enumerate(TEXTS * 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, law_name string, heading string, text string, bit long").repartition(3)
    terms = spark.createDataFrame([(1, "alpha"), (2, "ga"), (2, "gamma"), (3, "zeta"), (5, "b")], "query_id long, term string")
    said = [(1, 0, ["alpha", "be"]), (1, 1, ["beta", "gam", "d"]), (2, 0, ["alpha", "beta", "g"]), (2, 1, ["alpha", "b"]), (3, 0, ["delta"]), (4, 0, ["alpha", "alpha", "al"]), (4, 1, ["beta", "gamma"]), (4, 2, ["nothing", "gamma"])]
    phrases = spark.createDataFrame(said, "query_id long, ix int, words array<string>")
    masks = spark.createDataFrame([(1, 1), (2, -1), (3, 2), (4, 2), (5, 1)], "query_id long, mask long")
    return chunks, terms, phrases, masks


@pytest.mark.parametrize("pairs", [1 << 21, 7])
@pytest.mark.parametrize("filtered", [False, True])
@pytest.mark.parametrize("k", [2, 40])
def test_batches_give_the_rows_of_joins(spark, monkeypatch, pairs, filtered, k):
    chunks, terms, phrases, masks = inputs(spark)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    made = lambda: [
        sorted(map(tuple, f(chunks, terms, phrases=phrases, k=k, masks=masks if filtered else None).collect()), key=repr) for f in (lexical.sparse_branch, lexical.title_branch)
    ]
    batches = made()
    monkeypatch.setattr(lexical, "_few", lambda rows: False)
    assert batches == made() and all(batches)


def test_no_posting_is_shuffled_for_a_few_questions(spark):
    chunks, terms, phrases, _ = inputs(spark)
    for f in (lexical.sparse_branch, lexical.title_branch):
        plan = f(chunks, terms, phrases=phrases)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan
