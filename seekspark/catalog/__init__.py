"""All registered queries. Importing this package fills the registry."""

from seekspark.catalog.registry import ENTRIES, Tables
from seekspark.catalog import (  # noqa: F401
    evaluation, graphs, jobs, retrieval, runs, sources, storage, texts,
)

__all__ = ["ENTRIES", "Tables"]
