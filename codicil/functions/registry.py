"""The functions that SQL can call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.evaluation import diff_ratio, unified_diff
from ..sources.files import html_blocks
from .legal import parse_references
from .text import nfc_normalize, nfkc_casefold


@udtf(returnType="block_ix int, text string, role string, level int")
class HtmlBlocks:
    """html_blocks(html): the blocks of a page as rows."""

    def eval(self, html: str):
        for i, b in enumerate(html_blocks(html)):
            yield i, b["text"], b["role"], b["level"]


@udtf(returnType="chunk_ix int, text string")
class ChunkText:
    """chunk_text(text, target, most): a body cut into chunks."""

    def eval(self, text: str, target: int, most: int):
        from ..operators.ingest import split_body

        yield from enumerate(split_body(text or "", 0, target, most))


def register(spark: SparkSession) -> None:
    """nfc_normalize, nfkc_casefold, parse_references, diff_ratio, unified_diff, html_blocks, chunk_text."""
    for name, f in (("nfc_normalize", nfc_normalize), ("nfkc_casefold", nfkc_casefold), ("parse_references", parse_references), ("diff_ratio", diff_ratio), ("unified_diff", unified_diff)):
        spark.udf.register(name, f)
    spark.udtf.register("html_blocks", HtmlBlocks)
    spark.udtf.register("chunk_text", ChunkText)
