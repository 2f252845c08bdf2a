"""Connectors as Python data sources: a directory of fetched documents, read like a remote one.

A connector discovers identifiers and fetches each with its fetch policy.  No network is
needed: ``path`` holds ``index.jsonl`` (identifier, host, file, and status answers to replay),
so the policy, retries included, runs the same way as against a server.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class FetchPolicy:
    """Retries on 429 and 5xx honour Retry-After, else wait min(cap, base * 2^n) seconds."""

    retries: int = 4
    base_s: float = 1.5
    cap_s: float = 60.0
    interval_s: float = 20.0

    def waits(self, answers: list[dict]) -> tuple[int, float, int]:
        """(status, seconds waited, attempts) of a sequence of answers (status, retry_after)."""
        waited = 0.0
        for n, answer in enumerate(answers[: self.retries + 1]):
            status = answer.get("status", 200)
            if status != 429 and status < 500:
                return status, waited, n + 1
            if n < self.retries:
                waited += float(answer.get("retry_after") or min(self.cap_s, self.base_s * 2**n))
        return status, waited, min(len(answers), self.retries + 1)


SCHEMA = "identifier string, host string, content binary, status int, waited_s double, attempts int"


class DirectorySource(DataSource):
    """Format ``codicil_directory``: option path; one partition for each host, as a limiter needs."""

    @classmethod
    def name(cls) -> str:
        return "codicil_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Host(InputPartition):
    def __init__(self, host: str, entries: list[dict]):
        self.host, self.entries = host, entries


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.policy = options["path"], FetchPolicy()

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[dict]] = {}
        with open(os.path.join(self.path, "index.jsonl"), encoding="utf-8") as f:
            for line in f:
                entry = json.loads(line)
                hosts.setdefault(entry["host"], []).append(entry)
        return [_Host(h, e) for h, e in sorted(hosts.items())]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for entry in partition.entries:
            status, waited, attempts = self.policy.waits(entry.get("answers") or [{"status": 200}])
            content = None
            if status == 200:
                with open(os.path.join(self.path, entry["file"]), "rb") as f:
                    content = f.read()
            yield entry["identifier"], partition.host, content, status, waited, attempts


CONNECTORS: dict[str, type[DataSource]] = {"directory": DirectorySource}


def read_connector(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """The documents of a registered connector."""
    if name not in CONNECTORS:
        raise ValueError(f"unknown connector: {name}; known are {sorted(CONNECTORS)}")
    source = CONNECTORS[name]
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def health(pages: DataFrame, least: int = 1000) -> DataFrame:
    """identifier, title_found, body_found, healthy: whether a source still has the shape its parser counts on.

    pages: identifier, title, body_length.
    """
    title, body = F.col("title").isNotNull() & (F.col("title") != ""), F.col("body_length") > least
    return pages.select("identifier", title.alias("title_found"), body.alias("body_found"), (title & body).alias("healthy"))


def without_paywall(pages: DataFrame, marks: list[str], least: int = 300) -> DataFrame:
    """Pages (text) with enough text and none of the marks of a paywall."""
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(F.lower("text"), F.lit(m.lower()))
    return pages.where(~marked & (F.length("text") > least))
