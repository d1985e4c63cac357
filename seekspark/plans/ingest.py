"""Incremental ingestion: classify, chunk what changed, rewrite the touched buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions.ids import canonical_json_hash
from seekspark.functions.text import clean_text
from seekspark.operators import chunking
from seekspark.scale import computed_once, cut_lineage, small_side
from seekspark.sources.files import Parser, load_documents
from seekspark.storage.snapshots import SnapshotStore

CLEANER = "conservative-text-cleaner/2"
VERSION_COLUMNS = ("content_hash", "parser_name", "parser_version", "processing_hash")


DOCUMENTS = (
    "document_id string, source_uri string, title string, source_type string, "
    "content_hash string, parser_name string, parser_version string, processing_hash string"
)
CHUNKS = (
    "chunk_id string, document_id string, ordinal int, section_path array<string>, page_start int, "
    "page_end int, char_start int, char_end int, text string, contextualized_text string, "
    "token_count int, content_hash string, quality_class string"
)


@dataclass
class IngestResult:
    """``stale`` is the invalidation closure: what the replaced documents made out of date."""

    documents: DataFrame
    chunks: DataFrame
    actions: DataFrame
    replaced: DataFrame
    failures: DataFrame
    stale: DataFrame
    version: int


def is_current() -> Column:
    """Stored and incoming versions agree in content, parser and configuration."""
    same = F.lit(True)
    for name in VERSION_COLUMNS:
        same = same & F.col(f"stored.{name}").eqNullSafe(F.col(f"incoming.{name}"))
    return same


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``document_id, action``: skip, insert or update for every incoming document."""
    joined = incoming.alias("incoming").join(
        stored.alias("stored"), F.col("incoming.document_id") == F.col("stored.document_id"), "left"
    )
    action = (
        F.when(F.col("stored.document_id").isNull(), "insert")
        .when(is_current(), "skip")
        .otherwise("update")
    )
    return joined.select("incoming.document_id", action.alias("action"))


def cleaned(documents: DataFrame) -> DataFrame:
    """Documents with cleaned, non-empty segments, one row each.

    Segments are cleaned as rows, because the composed form needs an Arrow function,
    and packed again per document.
    """
    rows = documents.select("document_id", F.posexplode("segments").alias("at", "s"))
    tidy = computed_once(rows, text=clean_text(F.col("s.text"))).where(F.length("text") > 0)
    packed = tidy.groupBy("document_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("at", "text", F.col("s.section_path").alias("section_path"),
                         F.col("s.page_start").alias("page_start"), F.col("s.page_end").alias("page_end"))
            )
        ).alias("segments")
    )
    return packed.select(
        "document_id",
        F.transform(
            "segments",
            lambda s: F.struct(
                s["text"].alias("text"), s["section_path"].alias("section_path"),
                s["page_start"].alias("page_start"), s["page_end"].alias("page_end"),
            ),
        ).alias("segments"),
    )


def store_schemas() -> dict[str, str]:
    return {"documents": DOCUMENTS, "chunks": CHUNKS}


@dataclass
class Plan:
    """What one batch of files changes, before anything is written."""

    actions: DataFrame
    changed: DataFrame
    documents: DataFrame
    chunks: DataFrame
    failures: DataFrame

    @property
    def replaced(self) -> DataFrame:
        return self.actions.where("action = 'update'").select("document_id")


def plan_ingest(
    store: SnapshotStore, files: DataFrame, parsers: dict[str, Parser] | None = None,
    max_tokens: int = chunking.MAX_TOKENS, overlap_tokens: int = chunking.OVERLAP_TOKENS,
) -> Plan:
    """Compare ``files`` with the store; only new and changed ones are parsed and chunked.

    Versions are compared by hashes of the bytes, against the buckets of the incoming
    documents alone.
    """
    config = chunking.chunker_config("whitespace", max_tokens, overlap_tokens)
    processing = canonical_json_hash({"cleaner": CLEANER, "chunker": config})
    loaded, failures = load_documents(files, parsers)
    heads = cut_lineage(
        loaded.select("document_id", "path", *VERSION_COLUMNS[:3]).withColumn("processing_hash", F.lit(processing))
    )
    known = store.table("documents", buckets=store.touched(heads)).select("document_id", *VERSION_COLUMNS)
    actions = cut_lineage(classify(heads, known))
    changed = actions.where("action <> 'skip'").select("document_id")
    paths = heads.join(changed, "document_id", "left_semi").select("path")
    parsed, _ = load_documents(files.join(small_side(paths), "path", "left_semi"), parsers)
    work = cut_lineage(parsed.withColumn("processing_hash", F.lit(processing)))
    return Plan(
        actions, changed, work, chunking.chunk_documents(cleaned(work), max_tokens, overlap_tokens), failures
    )


def commit_ingest(store: SnapshotStore, plan: Plan, notes: dict | None = None) -> int:
    """Publish the next version of documents and chunks; returns its number."""
    return store.replace(plan.changed, {"documents": plan.documents, "chunks": plan.chunks}, notes)
