import os

import duckdb
import pyspark.sql.functions as F
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codicil.llm import queries as Q

from .helpers import words
from .test_near_dup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_stages_hand_on_documents(stages):
    for rows in stages[1:-1]:
        assert list(rows.columns) == list(stages[0].columns)


def test_each_stage_on_its_own_input(stages):
    docs, judged, lines, near, mix, packed = stages
    texts = dict(zip(docs.doc_id, docs.text))
    assert all(texts[i] == t for i, t in zip(judged.doc_id, judged.text)) and len(judged) > 0.6 * len(docs)
    before = dict(zip(judged.doc_id, judged.text))
    for i, t, n in zip(lines.doc_id, lines.text, lines.n_chars):
        assert set(t.split("\n")) <= set(before[i].split("\n")) and words(t)
        assert t == before[i] or n == len(t)
    groups = brute(list(lines.text), list(lines.doc_id), 5)
    assert sorted(near.doc_id) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert set(zip(mix.doc_id, mix.text)) <= set(zip(near.doc_id, near.text))
    assert mix.groupby("doc_id").size().max() <= 3
    assert packed.groupby("doc_id").length.sum().gt(0).all() and set(packed.doc_id) == set(mix.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, stages[-1][key].values))


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("x"))
    some = docs.where("doc_id < 30")
    odd = spark.createDataFrame([(900, None, "en", "s", 0, "x"), (901, "", None, None, None, "x"), (902, " \n\t", "en", "s", 3, "x"), (None, "null id " * 30, "en", None, 240, "x")], docs.schema)
    for name, rows in (("some", docs.union(some).union(odd)), ("none", docs.where("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").toPandas()
    assert len(got) and not {900, 901, 902} & set(got.doc_id.dropna())
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    copies = docs.where("doc_id < 30").union(some).union(odd)
    near = corpus_pipeline.near_dedup(spark, copies, SF).toPandas()
    assert not near.duplicated().any() and {900, 901, 902} <= set(near.doc_id.dropna()) and near.doc_id.isna().sum() == 1


def test_every_query_is_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"op{n}_" for n in range(1, 14) if any(x.startswith(f"op{n}_") for x in names)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(r[c] for c in columns) for r in df), key=repr)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r)) for r in want.fetchall())


def test_further_columns_are_handed_on(spark):
    names = ["size", "source_size", "target", "taken", "copies", "words_more", "n_lines", "n_removed", "low", "high", "ref", "_ref", "kept", "n_words", "log_perplexity", "rank", "positions", "_key", "_n", "_own0", "component_id", "id", "_part", "h1"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i} "), "doc_id"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        rows = got.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{i} {r.doc_id}" for r in rows for i, c in enumerate(names)), name
