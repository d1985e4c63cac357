"""The Python surface: DataFrames in, DataFrames out, tables under one shared root."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekspark.functions.text import deterministic_keywords
from seekspark.functions.vectors import Embedder, HashEmbedder
from seekspark.operators import extraction, metrics, resolution
from seekspark.operators.graph import graph_summary
from seekspark.plans import agent, answers, evaluation, indexing, ingest
from seekspark.plans.options import RetrievalOptions
from seekspark.plans.retrieval import Reranker, Retrieval, retrieve
from seekspark.plans.traces import TraceStore
from seekspark.scale import cut_lineage
from seekspark.sources.files import Parser, discover
from seekspark.sources.testsets import read_testset
from seekspark.storage.closure import DependencyStore, edges, invalidation_closure
from seekspark.storage.snapshots import SnapshotStore
from seekspark.storage.stages import RunStore, StageRun, stage_listing
from seekspark.streaming.files import watch_files

# Gives completion rows for chunk rows, for instance by calling a language model.
Completer = Callable[[DataFrame], DataFrame]

@dataclass
class Graph:
    """Entities, relations and aliases, and the chunks behind them as link rows."""

    entities: DataFrame
    relations: DataFrame
    aliases: DataFrame
    links: DataFrame
    quality: DataFrame
    run_id: str = ""


def graph_stages(run: StageRun, completions: DataFrame | None) -> dict[str, DataFrame]:
    """The stored tables of a graph build; each stage reads what the one before it stored."""
    tables: dict[str, DataFrame] = {}

    def stage(name: str, build: Callable[[], dict[str, DataFrame]]) -> None:
        tables.update(run.stage(name, build))

    def read() -> dict[str, DataFrame]:
        if completions is None:
            raise ValueError(f"run {run.run_id} isn't complete")
        judged = extraction.classify_completions(completions)
        return {
            "usable": judged.where("failure is null").withColumn("run_id", F.lit(run.run_id)),
            "failed": judged.where("failure is not null").select("extraction_id", "chunk_id", "failure"),
        }

    def resolve() -> dict[str, DataFrame]:
        found = resolution.resolve_entities(extraction.accepted_mentions(tables["entity_checks"]))
        return dict(zip(("entities", "assignment", "aliases"), found))

    def merge() -> dict[str, DataFrame]:
        linked = extraction.accepted_mentions(tables["relation_checks"])
        ends = linked.select("source_mention_id", "target_mention_id", "predicate", "description", "chunk_id")
        keys = ["source_entity_id", "target_entity_id", "predicate"]
        relations = cut_lineage(resolution.merge_relations(ends, tables["assignment"]))
        located = resolution.locate_endpoints(ends, tables["assignment"])
        relation_links = located.join(relations.select("relation_id", *keys), keys).select(
            F.lit("relation").alias("kind"), F.col("relation_id").alias("object_id"), "chunk_id"
        )
        mentions = extraction.accepted_mentions(tables["entity_checks"])
        entity_links = mentions.join(tables["assignment"], "mention_id").select(
            F.lit("entity").alias("kind"), F.col("entity_id").alias("object_id"), "chunk_id"
        )
        return {"relations": relations, "links": entity_links.unionByName(relation_links).distinct()}

    stage("read", read)
    stage("entity_checks", lambda: {"entity_checks": extraction.validate_entities(tables["usable"])})
    stage("relation_checks", lambda: {
        "relation_checks": extraction.validate_relations(tables["usable"], tables["entity_checks"])
    })
    stage("resolve", resolve)
    stage("merge", merge)
    stage("quality", lambda: {
        "quality": extraction.extraction_quality(tables["entity_checks"], tables["relation_checks"])
    })
    return tables


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, embedder: Embedder | None = None,
        parsers: dict[str, Parser] | None = None, reranker: Reranker | None = None,
    ) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or HashEmbedder()
        self.parsers, self.reranker = parsers or {}, reranker
        self.corpus = SnapshotStore(spark, f"{self.root}/corpus", ingest.store_schemas(), "document_id")
        self.graphs = RunStore(spark, f"{self.root}/graphs")
        self.dependencies = DependencyStore(spark, f"{self.root}/dependencies")
        self.indexes = indexing.IndexStore(spark, f"{self.root}/indexes")
        self.traces = TraceStore(spark, f"{self.root}/traces")

    # --- corpus -----------------------------------------------------------------
    def documents(self, version: int | None = None) -> DataFrame:
        return self.corpus.table("documents", version).drop("bucket")

    def chunks(self, version: int | None = None) -> DataFrame:
        return self.corpus.table("chunks", version).drop("bucket")

    def ingest(self, folder: str, max_tokens: int = 512, overlap_tokens: int = 64) -> ingest.IngestResult:
        """Read a folder and publish the next corpus version; unchanged files are skipped."""
        found = discover(self.spark, folder, [".txt", ".md", ".markdown", *self.parsers])
        return self.ingest_files(found, max_tokens, overlap_tokens)

    def ingest_files(
        self, files: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64, notes: dict | None = None
    ) -> ingest.IngestResult:
        """Upsert file rows. What depends on a replaced document is marked stale before the
        new version appears, so no reader finds a ready index over a changed corpus."""
        plan = ingest.plan_ingest(self.corpus, files, self.parsers, max_tokens, overlap_tokens)
        stale = self.invalidate_documents(plan.replaced, "source document changed")
        version = ingest.commit_ingest(self.corpus, plan, notes)
        return ingest.IngestResult(
            self.documents(), self.chunks(), plan.actions, plan.replaced, plan.failures, stale, version
        )

    def remove_documents(self, ids: DataFrame) -> DataFrame:
        """Delete documents by ``document_id``; returns what became stale."""
        stale = self.invalidate_documents(ids, "source document removed")
        self.corpus.replace(ids, {})
        return stale

    def watch(self, folder: str, checkpoint: str, name: str = "files") -> StreamingQuery:
        """Upsert files as they arrive; what can't be read goes to the dead-letter table.

        A batch that is replayed after a crash changes nothing: the store notes the last
        batch of each stream in the same commit, and failures overwrite their own folder.
        """

        def upsert(batch: DataFrame, epoch: int) -> None:
            if self.corpus.manifest()["notes"].get(f"stream:{name}", -1) >= epoch:
                return
            result = self.ingest_files(batch, notes={f"stream:{name}": epoch})
            result.failures.write.mode("overwrite").parquet(f"{self.root}/dead_letter/stream={name}/epoch={epoch}")

        return (
            watch_files(self.spark, folder).writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def dead_letters(self) -> DataFrame:
        """``path, error, stream, epoch`` of files that no batch could read."""
        schema = "path string, error string, stream string, epoch long"
        folder = f"{self.root}/dead_letter"
        if not self.graphs.files.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    # --- what depends on what -----------------------------------------------------
    def invalidate_documents(self, ids: DataFrame, reason: str) -> DataFrame:
        """Closure over documents, their chunks, and the runs and profiles built from those.

        Runs and profiles in it stop being offered to readers; both are counted in tens,
        as they are builds, so their ids go through the driver.
        """
        changed = ids.select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"))
        held = self.corpus.table("chunks", buckets=self.corpus.touched(ids))
        own = edges(held, "document", "document_id", "chunk", "chunk_id")
        stale = invalidation_closure(own.unionByName(self.dependencies.edges()), changed)
        for row in stale.where(F.col("kind").isin("run", "profile")).select("kind", "id").collect():
            if row["kind"] == "run":
                self.graphs.invalidate(row["id"], reason)
            else:
                self.indexes.invalidate(row["id"], reason)
        return stale

    # --- graph ------------------------------------------------------------------
    def build_graph(self, completions: DataFrame | Completer, run_id: str | None = None) -> Graph:
        """Graph from ``extraction_id, chunk_id, chunk_text, content, finish_reason`` rows.

        ``completions`` may be a function that gives these rows for chunks; it is then asked
        for the normal chunks in parts. With the ``run_id`` of a build that stopped, finished
        stages and parts are read back and the rest goes on. The run is published at the end.
        """
        run_id = run_id or uuid.uuid4().hex[:12]
        run = self.graphs.run(run_id)
        if callable(completions):
            chunks = self.chunks().where("quality_class = 'normal'")
            completions = run.items("completions", chunks, "chunk_id", completions)
        tables = graph_stages(run, completions)
        used = edges(tables["usable"], "chunk", "chunk_id", "run", "run_id")
        objects = tables["links"].select(
            F.lit("chunk").alias("upstream_kind"), F.col("chunk_id").alias("upstream_id"), "kind", F.col("object_id").alias("id")
        )
        self.dependencies.record(f"run-{run_id}", used.distinct().unionByName(objects))
        summary = graph_summary(tables["entities"], tables["relations"]).first().asDict()
        self.graphs.publish(run_id, summary)
        return self.graph(run_id)

    def graph(self, run_id: str | None = None) -> Graph:
        """A stored graph: of a run, or the published one."""
        wanted = run_id or self.graphs.active()
        state = self.graphs.state(wanted) if wanted else None
        if state is None or state["status"] != "ready":
            raise ValueError("no ready graph run")
        t = graph_stages(self.graphs.run(wanted), None)
        return Graph(t["entities"], t["relations"], t["aliases"], t["links"], t["quality"], wanted)

    def graph_stages(self) -> DataFrame:
        """``run_id, stage, table, rows`` of all finished stages."""
        return stage_listing(self.spark, f"{self.graphs.root}/runs")

    # --- index and questions ------------------------------------------------------
    def build_index(self, graph: Graph | None = None, force: bool = False) -> indexing.Index:
        chunks = indexing.index_chunks(self.chunks(), self.documents())
        if graph is None:
            entities = self.spark.createDataFrame([], "object_id string, name string, entity_type string, embedding_text string")
            relations = self.spark.createDataFrame([], "object_id string, source_entity_id string, target_entity_id string, predicate string, embedding_text string")
            links = self.spark.createDataFrame([], "kind string, object_id string, chunk_id string")
        else:
            entities = indexing.index_entities(graph.entities, graph.aliases)
            relations = indexing.index_relations(graph.relations, graph.entities)
            links = graph.links
        hashed = indexing.index_items(chunks, entities, relations).select(
            F.concat_ws("\x1f", "kind", "object_id").alias("key"), F.sha2("embedding_text", 256).alias("hash")
        )
        fingerprint = indexing.content_fingerprint(hashed, "key", "hash").first()["fingerprint"] or ""
        index = self.indexes.build(chunks, entities, relations, links, self.embedder, fingerprint, force=force)
        profile = F.lit(index.profile_id).alias("profile_id")
        own = index.chunks.select(F.col("object_id").alias("chunk_id"), profile)
        derived = index.links.select("chunk_id", profile)
        built_from = edges(own.unionByName(derived).distinct(), "chunk", "chunk_id", "profile", "profile_id")
        self.dependencies.record(f"profile-{index.profile_id}", built_from)
        return index

    def retrieve(
        self, questions: DataFrame, mode: str = "mix", options: RetrievalOptions | None = None,
        profile_id: str | None = None,
    ) -> Retrieval:
        return retrieve(self.indexes.load(self.embedder, profile_id), questions, mode, options, self.reranker)

    def ask(self, questions: DataFrame, mode: str = "mix", options: RetrievalOptions | None = None) -> tuple[DataFrame, str]:
        """Grounded answers and the id of the stored trace."""
        keyed = questions.withColumn("keywords", deterministic_keywords(F.col("text")))
        index = self.indexes.load(self.embedder)
        found = retrieve(index, keyed, mode, options, self.reranker)
        given = answers.checked_answers(answers.deterministic_answers(found), found.context)
        stored_config = indexing.canonical_json_hash(index.metadata["config"])
        used_config = indexing.canonical_json_hash(indexing.semantic_config(self.embedder))
        trace = self.traces.save(found, index.profile_id, used_config, stored_config, given)
        return self.traces.replay(trace, "answers"), trace

    def evaluate(self, cases: DataFrame, gold: DataFrame, modes: tuple[str, ...], k: int = 8) -> DataFrame:
        """Metric rows ``mode, case_id, ...`` for ``cases(case_id, text)`` and ``gold(case_id, identity)``."""
        asked = cases.select(F.col("case_id").alias("query_id"), "text")
        whole = None
        for mode in modes:
            hits = self.retrieve(asked, mode).hits
            ranked = hits.select(F.col("query_id").alias("case_id"), "rank", F.col("object_id").alias("identity"))
            scores = metrics.retrieval_scores(cases, ranked, gold, k).withColumn("mode", F.lit(mode))
            whole = scores if whole is None else whole.unionByName(scores)
        return whole

    def evaluate_testset(
        self, path: str, modes: tuple[str, ...], options: RetrievalOptions | None = None, profile_id: str | None = None
    ) -> evaluation.Evaluation:
        """All scores of a stored test set against one pinned profile."""
        index = self.indexes.load(self.embedder, profile_id)
        found = read_testset(self.spark, path, corpus_hash=index.metadata["fingerprint"])
        return evaluation.evaluate_testset(index, found, modes, options, self.reranker)

    def agent_run(self, questions: DataFrame, budget: agent.Budget | None = None) -> DataFrame:
        return agent.AgentRunner(self.indexes.load(self.embedder)).run(questions, budget)
