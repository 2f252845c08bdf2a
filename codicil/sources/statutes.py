"""The store of acts: nodes, chunks, versions and references, written slice by slice.

A slice is an act in a language.  Ids are hashes of what names a row, so parents and children
agree without a map of ids and a rerun writes the same rows.  An ingestion compares each slice's
content hash with the stored one and goes on with what differs; the table of acts, which holds
the hashes, is written last, so an ingestion that dies is done again.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from ..operators import ingest
from ..scratch import stored
from .buckets import BucketedTable

SLICE = ["act_id", "language"]
TABLES = {
    "nodes": "act_id string, language string, node_id string, parent_id string, node_type string, number string, article_number string, heading string, body string, path string, ordinal int",
    "chunks": "act_id string, language string, chunk_id string, node_id string, article_number string, heading string, path string, text string, tokens int, ordinal int",
    "versions": "act_id string, language string, article_number string, body string, body_hash string, valid_from date, valid_to date, change_note string",
    "edges": "act_id string, language string, edge_id string, source_article string, target_act_id string, target_article string, target_raw string, confidence double",
    "acts": "act_id string, language string, name string, effective date, content_hash string",
}


def identity(*parts: Column) -> Column:
    """A stable id of the values that name a row; null is told from empty."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


class StatuteStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.tables = {n: BucketedTable(spark, f"{path}/{n}", schema, SLICE, buckets) for n, schema in TABLES.items()}

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read()

    def ingest(self, acts: DataFrame, blocks: DataFrame, force: bool = False) -> dict[str, list[int]]:
        """Write the slices that changed and return the buckets that each table rewrote.

        acts: act_id, language, name, effective (date); blocks: act_id, language, block_ix, text.
        With ``force`` all given slices are written, and the given acts' slices in other
        languages go, but for their versions.
        """
        content = blocks.groupBy(*SLICE).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("block_ix", "text")))), 256).alias("content_hash"))
        given = acts.join(content, SLICE).select(*SLICE, "name", "effective", "content_hash")
        known = self.read("acts").select(*SLICE, F.col("content_hash").alias("_known"))
        changed = given if force else given.join(known, SLICE, "left").where(~F.col("_known").eqNullSafe(F.col("content_hash"))).drop("_known")
        changed = stored(changed, "changed")
        if changed.isEmpty():
            return {n: [] for n in TABLES}
        slices = changed.select(*SLICE)
        mine = blocks.join(slices, SLICE, "left_semi")
        gone = self.read("acts").select(*SLICE).join(changed.select("act_id").distinct(), "act_id", "left_semi") if force else slices
        gone = gone.union(slices).distinct()

        nodes = stored(self._nodes(mine), "nodes")
        chunks = self._chunks(nodes)
        articles = nodes.where("node_type = 'modda' AND body <> ''")
        done = {
            "nodes": self.tables["nodes"].replace(nodes, SLICE, gone),
            "chunks": self.tables["chunks"].replace(chunks, SLICE, gone),
            "versions": self.tables["versions"].merge(articles.join(changed.select(*SLICE, "effective"), SLICE), self._versions),
            "edges": self.tables["edges"].replace(self._edges(articles, acts), SLICE, gone),
        }
        return done | {"acts": self.tables["acts"].replace(changed, SLICE, gone)}

    @staticmethod
    def _nodes(blocks: DataFrame) -> DataFrame:
        slices = blocks.withColumn("doc_id", F.xxhash64(*SLICE))
        built = ingest.build_nodes(slices)
        named = slices.select("doc_id", *SLICE).distinct()
        # The fold numbers a document's units; ids come from the unit's path and its number among equal paths.
        at = F.split_part("node_id", F.lit(":"), F.lit(-1)).cast("int")
        nth = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy(at))
        own = built.join(named, "doc_id").withColumn("nth", nth)
        own = own.withColumn("id", identity(F.col("act_id"), F.col("language"), F.col("path"), F.col("nth")))
        parents = own.select("doc_id", F.col("node_id").alias("parent_id"), F.col("id").alias("parent"))
        rows = own.join(parents, ["doc_id", "parent_id"], "left")
        return rows.select(*SLICE, F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "node_type", "number", "article_number", "heading", F.coalesce("body", F.lit("")).alias("body"), "path", "ordinal", at.alias("_at")).select(*[c.split()[0] for c in TABLES["nodes"].split(", ")], "_at")

    @staticmethod
    def _chunks(nodes: DataFrame) -> DataFrame:
        rows = nodes.select(F.xxhash64(*SLICE).alias("doc_id"), F.concat_ws(":", F.lit("n"), F.col("_at")).alias("node_id"), "parent_id", "node_type", "number", "heading", "body", "article_number", "path", "ordinal")
        made = ingest.chunk_nodes(rows)
        at = F.split_part("node_id", F.lit(":"), F.lit(-1)).cast("int")
        named = nodes.select(F.xxhash64(*SLICE).alias("doc_id"), *SLICE, F.col("_at").alias("at"), F.col("node_id").alias("node"))
        found = made.withColumn("at", at).join(named, ["doc_id", "at"])
        return found.select(*SLICE, identity(F.col("act_id"), F.col("language"), F.col("chunk_ix")).alias("chunk_id"), F.col("node").alias("node_id"), "article_number", "heading", "path", "text", F.col("token_count").alias("tokens"), F.col("chunk_ix").cast("int").alias("ordinal"))

    @staticmethod
    def _versions(current: DataFrame, articles: DataFrame) -> DataFrame:
        """Stored versions with the open ones of changed articles closed, and the new ones."""
        key = [*SLICE, "article_number"]
        # Of articles that share a number the last one counts.
        fresh = articles.groupBy(*key).agg(F.max_by(F.struct("body", "effective"), F.col("_at")).alias("a")).select(*key, F.col("a.body").alias("_body"), F.sha2("a.body", 256).alias("_hash"), F.col("a.effective").alias("_effective"))
        is_open = F.col("valid_to").isNull()
        found = current.join(fresh, [current[c].eqNullSafe(fresh[c]) for c in key], "left").select(*[current[c] for c in current.columns], "_hash", "_effective")
        closes = is_open & F.col("_hash").isNotNull() & (F.col("_hash") != F.col("body_hash"))
        old = found.withColumn("valid_to", F.when(closes, F.col("_effective")).otherwise(F.col("valid_to"))).drop("_hash", "_effective")
        open_now = current.where(is_open).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("body_hash").alias("_open"))
        new = fresh.join(open_now, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").where(~F.col("_open").eqNullSafe(F.col("_hash")))
        note = F.when(F.col("_open").isNotNull(), "amended").otherwise("initial")
        new = new.select(*key, F.col("_body").alias("body"), F.col("_hash").alias("body_hash"), F.col("_effective").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), note.alias("change_note"))
        return old.unionByName(new)

    @staticmethod
    def _edges(articles: DataFrame, acts: DataFrame) -> DataFrame:
        slice_id = F.concat_ws("\u0001", *SLICE)
        named = acts.groupBy("act_id").agg(F.min("name").alias("name"))
        found = ingest.reference_edges(articles.select(slice_id.alias("act_id"), "article_number", "body"), named)
        act, language = F.split_part("source_act_id", F.lit("\u0001"), F.lit(1)), F.split_part("source_act_id", F.lit("\u0001"), F.lit(2))
        own = F.when(F.col("target_act_id") == F.col("source_act_id"), act).otherwise(F.col("target_act_id"))
        rows = found.select(act.alias("act_id"), language.alias("language"), "source_article", own.alias("target_act_id"), "target_article", "target_raw", "confidence").distinct()
        return rows.withColumn("edge_id", identity(*[F.col(c) for c in ("act_id", "language", "source_article", "target_act_id", "target_article", "target_raw")]))
