"""Index building: embedding texts, one table of three kinds, versioned storage."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions.ids import canonical_json_hash, stable_id, stable_id_value
from seekspark.functions.vectors import Embedder, embed_column
from seekspark.operators.graph import dangling_endpoints
from seekspark.operators.digests import digest_tree
from seekspark.operators.blockmax import LexicalIndex, build_index, open_index
from seekspark.storage.files import SharedFiles

KINDS = ("chunk", "entity", "relation")
TEXT_SCHEMA_VERSION = "1"


def chunk_text(title: Column, section_path: Column, contextualized: Column) -> Column:
    label = F.array_join(section_path, " > ")
    section = F.when(F.length(label) > 0, label).otherwise(F.lit("(untitled section)"))
    return F.concat(
        F.lit("Document: "), title, F.lit("\nSection: "), section, F.lit("\n\n"), contextualized
    )


def entity_text(name: Column, kind: Column, aliases: Column, description: Column) -> Column:
    listed = F.when(F.size(aliases) > 0, F.array_join(aliases, ", ")).otherwise(F.lit("(none)"))
    return F.concat(
        F.lit("Entity: "), name, F.lit("\nType: "), kind, F.lit("\nAliases: "), listed,
        F.lit("\nDescription: "), description,
    )


def relation_text(source: Column, predicate: Column, target: Column, description: Column) -> Column:
    return F.concat(
        F.lit("Relation: "), source, F.lit(" --"), predicate, F.lit("--> "), target,
        F.lit("\nDescription: "), description,
    )


@dataclass
class Index:
    """The tables one profile consists of.

    chunks: object_id, document_id, document_title, section_path, page_start, page_end,
    text, embedding_text, embedding. entities: object_id, name, embedding_text, embedding.
    relations: object_id, source_entity_id, target_entity_id, predicate, embedding_text,
    embedding. links: kind, object_id, chunk_id, the sources of entities and relations as
    rows. lexical: the stored inverted index, or None to count the chunks for each batch.
    """

    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    links: DataFrame
    embedder: Embedder
    lexical: LexicalIndex | None = None
    profile_id: str = ""
    metadata: dict = field(default_factory=dict)


def index_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Normal chunks with their document title."""
    titles = documents.select("document_id", F.col("title").alias("document_title"))
    return chunks.where(F.col("quality_class") == "normal").join(titles, "document_id").select(
        F.col("chunk_id").alias("object_id"), "document_id", "document_title", "section_path",
        "page_start", "page_end", F.col("contextualized_text").alias("text"),
        chunk_text(F.col("document_title"), F.col("section_path"), F.col("contextualized_text")).alias("embedding_text"),
    )


def index_entities(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    listed = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    joined = entities.join(listed, "entity_id", "left")
    names = F.coalesce("aliases", F.array().cast("array<string>"))
    return joined.select(
        F.col("entity_id").alias("object_id"), F.col("canonical_name").alias("name"), "entity_type",
        entity_text(F.col("canonical_name"), F.col("entity_type"), names, F.col("description")).alias("embedding_text"),
    )


def index_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with both end names; inner joins after dangling ends were ruled out."""
    source = entities.select(F.col("entity_id").alias("source_entity_id"), F.col("canonical_name").alias("s"))
    target = entities.select(F.col("entity_id").alias("target_entity_id"), F.col("canonical_name").alias("t"))
    return relations.join(source, "source_entity_id").join(target, "target_entity_id").select(
        F.col("relation_id").alias("object_id"), "source_entity_id", "target_entity_id", "predicate",
        relation_text(F.col("s"), F.col("predicate"), F.col("t"), F.col("description")).alias("embedding_text"),
    )


def index_items(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """All kinds in one table: ``object_id, kind, embedding_text``."""
    parts = zip(KINDS, (chunks, entities, relations))
    tables = [df.select("object_id", F.lit(kind).alias("kind"), "embedding_text") for kind, df in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def kind_counts(items: DataFrame) -> DataFrame:
    """Rows per kind over the whole domain, zero included."""
    domain = items.sparkSession.sql(
        "SELECT kind FROM VALUES ('chunk'), ('entity'), ('relation') AS d(kind)"
    )
    counted = items.groupBy("kind").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counted, "kind", "left").fillna(0, ["n"])


def content_fingerprint(rows: DataFrame, key: str, content_hash: str, depth: int = 3) -> DataFrame:
    """One hash over a whole table: the root of its digest tree, null for an empty one.

    A single sorted string, as one would build it for a small corpus, cannot exist for
    a large one; the tree keeps every group small and the value deterministic.
    """
    tree = digest_tree(rows, key, content_hash, depth)
    return tree.agg(F.max(F.when(F.col("level") == 0, F.col("digest"))).alias("fingerprint"))


def semantic_config(embedder: Embedder) -> dict:
    return {
        "provider": embedder.provider,
        "model": embedder.model,
        "dimensions": embedder.dimensions,
        "text_schema_version": TEXT_SCHEMA_VERSION,
    }


def resolve_profile(profiles: DataFrame, reference: str | None = None) -> DataFrame:
    """The ready profile for an id, else a configuration hash, else the active one."""
    ready = profiles.where(F.col("status") == "ready")
    newest = [F.col("is_active").desc(), F.col("updated_at").desc(), F.col("profile_id")]
    if reference is None:
        return ready.where("is_active").orderBy(*newest).limit(1)
    by_id = profiles.where(F.col("profile_id") == reference)
    if by_id.limit(1).count():
        return by_id.where(F.col("status") == "ready")
    return ready.where(F.col("config_hash") == reference).orderBy(*newest).limit(1)


def profiles_touched(vectors: DataFrame, links: DataFrame, doomed_chunks: DataFrame) -> DataFrame:
    """Profiles with a vector of, or derived from, a chunk about to change."""
    doomed = doomed_chunks.select("chunk_id").distinct()
    own = vectors.join(doomed.withColumnRenamed("chunk_id", "object_id"), "object_id", "left_semi")
    derived = links.join(doomed, "chunk_id", "left_semi")
    return own.select("profile_id").unionByName(derived.select("profile_id")).distinct()


class IndexStore:
    """Versioned index folders below a shared root, and one pointer to the active one."""

    TABLES = ("chunks", "entities", "relations", "links")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def active(self) -> str | None:
        return self.files.read(f"{self.root}/ACTIVE")

    def manifest(self, profile_id: str) -> dict | None:
        text = self.files.read(f"{self.root}/{profile_id}/MANIFEST")
        return json.loads(text) if text else None

    def load(self, embedder: Embedder, profile_id: str | None = None) -> Index:
        wanted = profile_id or self.active()
        manifest = self.manifest(wanted) if wanted else None
        if manifest is None or manifest["status"] != "ready":
            raise ValueError("no ready embedding index")
        if manifest["config"] != semantic_config(embedder):
            raise ValueError("embedder differs from the stored index; rebuild it")
        folder = f"{self.root}/{wanted}/{manifest['version']}"
        tables = {name: self.spark.read.parquet(f"{folder}/{name}") for name in self.TABLES if name != "links"}
        # Without a graph there is no partition to take the columns from.
        tables["links"] = self.spark.read.schema("object_id string, chunk_id string, kind string").parquet(f"{folder}/links")
        lexical = open_index(self.spark, f"{folder}/lexical")
        return Index(embedder=embedder, profile_id=wanted, metadata=manifest, lexical=lexical, **tables)

    def invalidate(self, profile_id: str, reason: str) -> None:
        manifest = self.manifest(profile_id)
        manifest.update(status="failed", error=reason)
        self.files.write(f"{self.root}/{profile_id}/MANIFEST", json.dumps(manifest))
        if self.active() == profile_id:
            self.files.write(f"{self.root}/ACTIVE", "")

    def build(
        self, chunks: DataFrame, entities: DataFrame, relations: DataFrame, links: DataFrame,
        embedder: Embedder, fingerprint: str, run_id: str | None = None, force: bool = False,
    ) -> Index:
        """Embed and store the three kinds, then flip the pointer.

        A ready profile of the same configuration, corpus and row counts is reused.
        """
        config = semantic_config(embedder)
        parts = [canonical_json_hash(config), fingerprint, *([run_id] if run_id else [])]
        profile_id = stable_id_value("idx", *parts)
        ends = relations.withColumnRenamed("object_id", "relation_id")
        if not dangling_endpoints(entities.select(F.col("object_id").alias("entity_id")), ends).isEmpty():
            raise ValueError("a relation references an entity outside the snapshot")
        expected = {"chunks": chunks.count(), "entities": entities.count(), "relations": relations.count()}
        known = self.manifest(profile_id)
        if known and known["status"] == "ready" and known["rows"] == expected and not force:
            return self.load(embedder, profile_id)
        version = uuid.uuid4().hex[:12]
        folder = f"{self.root}/{profile_id}/{version}"
        for name, df in (("chunks", chunks), ("entities", entities), ("relations", relations)):
            embedded = df.withColumn("embedding", embed_column(embedder, F.col("embedding_text")))
            embedded.withColumn(
                "vector_id", stable_id("vec", F.lit(profile_id), F.lit(name[:-1] if name != "entities" else "entity"), F.col("object_id"))
            ).write.parquet(f"{folder}/{name}")
        links.write.partitionBy("kind").parquet(f"{folder}/links")
        # Chunks of one document are neighbours, so its terms share few blocks.
        build_index(chunks, f"{folder}/lexical", "embedding_text", ("document_id", "object_id"))
        manifest = {"status": "ready", "version": version, "config": config, "rows": expected, "fingerprint": fingerprint}
        self.files.write(f"{self.root}/{profile_id}/MANIFEST", json.dumps(manifest))
        self.files.write(f"{self.root}/ACTIVE", profile_id)
        return self.load(embedder, profile_id)
