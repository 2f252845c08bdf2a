"""Every query of the package, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import _register, retrieval
from .plans import ingestion, more, relational, rest, stores, streams, texts, upkeep  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_register.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ret21_hybrid_retrieval(spark, sf_dir)
