"""As-of joins, clauses of contracts, nearest mentions, inverted lists."""

import random
import re

import pyspark.sql.functions as F
import pytest

from codicil.operators import ann, asof, citations, clauses, dense

VERSIONS = "k string, part int, since long, until long, v string"
REQUESTS = "req int, k string, part int, at long"


def brute(requests, versions, strict, ends):
    out = []
    for r, k, p, at in requests:
        fits = [v for v in versions if None not in (k, p, at, v[0], v[1], v[2]) and v[:2] == (k, p) and (v[2] < at if strict else v[2] <= at)]
        best = max(fits, key=lambda v: (v[2], v[4] or "", -1 if v[3] is None else v[3]), default=None)
        if best is not None and ends and best[3] is not None and best[3] <= at:
            best = None
        out.append((r, best[4] if best else None))
    return sorted(out)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_as_of_join_equals_brute_force(spark, parts):
    r = random.Random(9)
    versions = [(r.choice("aab"), r.randint(0, 1), t, r.choice([None, t + r.randint(1, 40)]), f"v{i}") for i in range(40) for t in [r.randint(0, 300)]]
    versions += [("hot", 0, t, None, f"h{t}") for t in range(0, 400, 50)] + [(None, 0, 1, None, "null"), ("c", 1, None, None, "open"), ("only", 0, 5, None, "o")]
    requests = [(i, r.choice(["a", "b", "hot", "hot", "hot", "none"]), r.choice([0, 0, 1]), r.randint(-10, 420)) for i in range(200)]
    requests += [(900, None, 0, 5), (901, "a", None, 5), (902, "a", 0, None), (903, "hot", 0, 50), (904, "hot", 0, 50), (905, "only", 0, 5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        q, v = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(versions, VERSIONS)
        for strict in (False, True):
            for until in (None, "until"):
                got = asof.as_of_join(q, v, ["k", "part"], "at", "since", until, "v", strict)
                assert got.columns == ["req", "k", "part", "at", "since", "until", "v"]
                assert sorted((x.req, x.v) for x in got.collect()) == brute(requests, versions, strict, until)
        assert asof.as_of_join(q.where("false"), v, ["k", "part"], "at", "since").count() == 0
        assert {x.v for x in asof.as_of_join(q, v.where("false"), ["k", "part"], "at", "since").collect()} == {None}
        with pytest.raises(ValueError):
            asof.as_of_join(q.withColumnRenamed("req", "v"), v, ["k", "part"], "at", "since")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


CONTRACT = """SHARTNOMA
kirish

1. Subject of the contract and all that belongs to it
1.1. The party waives all rights that the law gives to it.
more of it
1.2) Something else of no weight at all in this place
1.2.1. Deep down
II. Second title stands here and goes on for a while longer
2. It shall automatically renew every year without notice
2.1. short
Article 7 of the thing
3) end
4.1. orphan of a number"""


def test_clauses_rebuild_the_text_and_nest(spark):
    texts = [(1, CONTRACT), (2, None), (3, ""), (4, "no number\nat all"), (1, "1. a\n1.1. b\n1. c\n1.1. d"), (5, "\n\n1. x"), (6, "line\n" * 3000 + "9. end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ix", F.lit("x"))
    rows = clauses.clauses(docs).collect()
    pattern = re.compile(r"\n(?=\s*(?:\d+(?:\.\d+)*\s*[.)]|[IVXLC]+\s*\.|Статья|Modda|Article))")
    want = sorted((i, k, p) for i, t in texts if t is not None for k, p in enumerate(pattern.split(t)))
    assert sorted((r.doc_id, r.ix, r.text) for r in rows) == want
    for i, t in texts:
        for r in rows:
            if r.doc_id == i and i != 1 and t:
                assert t[r.start : r.start + len(r.text)] == r.text
    own = {r.ix: r for r in rows if r.doc_id == 1 and CONTRACT[r.start : r.start + len(r.text)] == r.text}
    assert "\n".join(own[k].text for k in sorted(own)) == CONTRACT
    nested = {r.number or r.text[:7]: (r.level, own[r.parent].number or own[r.parent].text[:3] if r.parent is not None else None) for r in own.values()}
    assert nested == {"SHARTNO": (0, None), "": (0, None), "1": (1, None), "1.1": (2, "1"), "1.2": (2, "1"), "1.2.1": (3, "1.2"), "II. Sec": (0, None), "2": (1, "II."), "2.1": (2, "2"), "Article": (0, None), "3": (1, "Art"), "4.1": (2, None)}
    again = sorted((r.ix, r.parent) for r in rows if r.doc_id == 1 and r.text in ("1. a", "1.1. b", "1. c", "1.1. d"))
    assert again == [(0, None), (1, 0), (2, None), (3, 2)]
    flags = {(r.number, r.code) for r in clauses.flagged(clauses.clauses(docs.where("doc_id = 1"))).collect()}
    assert flags == {("1.1", "waiver_of_statutory_rights"), ("2", "auto_renewal_no_notice")}


def test_nearest_mentions_equal_a_plain_search(spark):
    r = random.Random(11)
    words = ["The tax code", "land code", "labour CODE", "criminal code", "says", "and", "so on;", "[S1]", "[S2]", "[S3]", "[S12]", "x" * 40, "civil code"]
    laws = {"S1": "Land code", "S2": "Tax code of", "S3": None, "S12": "Labour code"}
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(80)] + ["", None, "[S1]", "tax code" + "y" * 82 + "[S1]", "tax code" + "y" * 83 + "[S1]", "[S1]" * 40]
    df = spark.createDataFrame([(i, t, laws) for i, t in enumerate(texts)], "i int, answer string, laws map<string,string>")
    got = {x.i: [(m.tag, m.claimed, m.actual) for m in x.misattributed] for x in citations.attributions(df).collect()}
    want = {i: [(m["tag"], m["claimed"], m["actual"]) for m in citations.attributed(t or "", laws)] for i, t in enumerate(texts)}
    assert got == want and any(want.values())


def test_inverted_lists_recall_and_pruning(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    vectors = vectors.unionByName(spark.createDataFrame([(10**6, None)], vectors.schema))
    ann.build(vectors, str(tmp_path), lists=16)
    assert spark.read.parquet(f"{tmp_path}/lists").count() == vectors.count() - 1
    queries = vectors.where("chunk_id % 7 = 0 AND embedding IS NOT NULL").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r.query_id, r.chunk_id): r.score for r in dense.knn(queries, vectors, 10).collect()}
    some = {(r.query_id, r.chunk_id): r.score for r in ann.search(spark, str(tmp_path), queries, 10, probes=12).collect()}
    assert len(exact.keys() & some.keys()) >= 0.95 * len(exact) and all(exact[x] == pytest.approx(some[x]) for x in exact.keys() & some.keys())
    every = {(r.query_id, r.chunk_id) for r in ann.search(spark, str(tmp_path), queries, 10, probes=16, block=20).collect()}
    assert every == set(exact)
    one = ann.search(spark, str(tmp_path), queries.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+", plan) and one.count() == 5
