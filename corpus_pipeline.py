"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Quality classifier, line dedup, near dedup, mixing and packing.  Every stage but the last
returns the columns of ``documents``; the last returns the packed pieces.  Null and empty texts
go in the first stage, which has no perplexity for them; rows that repeat a doc_id pass or go
together in ``near_dedup``; further columns of documents are handed on as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from codicil.llm._common import SEPARATORS, aside, attach, cut, drop, scratch, shared_folder
from codicil.llm.cutting_stock import CuttingStockConfig, packed_pieces
from codicil.llm.line_dedup import line_deduplicated
from codicil.llm.minhash_dedup import MinHashConfig, near_duplicates
from codicil.llm.mixing import MixConfig, repeated
from codicil.llm.quality_classifier import PerplexityConfig, quality_kept
from codicil.llm.queries import tokenizer_path, trusted_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantiles of their language's trusted documents.

    Null, empty and blank texts are rejected; equal rows are judged alike.
    """
    return quality_kept(docs, trusted_documents(spark, sf_dir), PerplexityConfig())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of which no word is left go.

    Equal rows of one doc_id are one document and keep the same lines; a text from which nothing
    is removed stays as it is, null included.  Texts are read whole, however long; of equal
    windows the one of smallest doc_id and place stays.
    """
    docs, named = aside(docs, ["doc_id", "text", "n_chars"])
    rows = line_deduplicated(docs)
    left = F.length(F.translate("text", SEPARATORS, "")) > 0
    rows = rows.where((F.col("n_removed") == 0) | left)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return rows.withColumn("n_chars", chars).select(named)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies (five-word shingles, 0.8).

    Rows that share a doc_id are one document; of rows equal in every column one stays.  Null
    doc_ids and texts without words are copies of nothing and stay.
    """
    found = near_duplicates(docs, MinHashConfig())
    gone = cut(found.where("not kept").select("doc_id").distinct())
    again = cut(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rows = attach(docs, gone, ["doc_id"], "left_anti")
    if again.isEmpty():
        drop(again)
        return rows.select(docs.columns)
    alone = attach(rows, again, ["doc_id"], "left_anti").select(docs.columns)
    return alone.union(attach(rows, again, ["doc_id"], "left_semi").select(docs.columns).distinct())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, equal rows are taken alike.

    Very long texts count whole and are taken whole; ties of the seeded order fall to the smaller doc_id.
    """
    return repeated(docs, MixConfig())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null text is its end id.

    Very long texts are cut, without loss; which of two equal rows a piece comes from is not told.
    """
    return packed_pieces(docs, CuttingStockConfig(tokenizer=tokenizer_path(), markers=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the near-duplicate groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns goes through Parquet in the shared folder.

    What a stage cut, and the rows it read, are deleted once its own rows are written.
    """
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            found = stage(spark, docs, sf_dir)
            docs = cut(found, f"{at}-{name}")
        if last is not None:
            drop(last)
        last = docs
    return docs
