"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the Parquet tables of one folder: ``tables.documents``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def register(function: Callable[[Tables], DataFrame]):
        if function.__name__ in ENTRIES:
            raise ValueError(f"query {function.__name__} is registered twice")
        ENTRIES[function.__name__] = Entry(function, sql)
        return function

    return register
