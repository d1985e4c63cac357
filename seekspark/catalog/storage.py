"""Stored tables: incremental upserts, what a change makes stale, and resumable runs.

Each query builds its store below the session's checkpoint folder, in a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.graphs import DOC_SQL, completions
from seekspark.catalog.registry import Tables, query
from seekspark.operators.lookup import ObjectTables
from seekspark.plans import ingest
from seekspark.plans.engine import graph_stages
from seekspark.scale import checkpoint_dir
from seekspark.sources.testsets import read_testset, write_testset
from seekspark.storage.closure import edges, invalidation_closure
from seekspark.storage.snapshots import SnapshotStore
from seekspark.storage.stages import RunStore, stage_listing

BUCKETS = 256
UPDATED, ADDED, REPEATED = "src3", "src5", "src7"


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}"


def _versions(documents: DataFrame, text) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("document_id"), "source", F.sha2(text, 256).alias("content_hash"),
        F.lit("builtin-text").alias("parser_name"), F.lit("1").alias("parser_version"), F.lit("c").alias("processing_hash"),
    )


def two_batches(t: Tables) -> tuple[SnapshotStore, DataFrame]:
    """A store after two batches, and the actions of the second: one source comes changed,
    one for the first time, one again as it was."""
    schema = "document_id string, source string, content_hash string, parser_name string, parser_version string, processing_hash string"
    store = SnapshotStore(t.spark, _folder(t), {"documents": schema}, "document_id", BUCKETS)
    text = F.coalesce("text", F.lit(""))
    first = _versions(t.documents.where(F.col("source") != ADDED), text)
    store.replace(first, {"documents": first})
    sent = t.documents.where(F.col("source").isin(UPDATED, ADDED, REPEATED))
    second = _versions(sent, F.when(F.col("source") == UPDATED, F.concat(text, F.lit("!"))).otherwise(text))
    actions = ingest.classify(second, store.table("documents", buckets=store.touched(second)))
    changed = actions.where("action <> 'skip'").select("document_id")
    store.replace(changed, {"documents": second.join(changed, "document_id", "left_semi")})
    return store, actions


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE source WHEN '{UPDATED}' THEN 'update' WHEN '{ADDED}' THEN 'insert' WHEN '{REPEATED}' THEN 'skip' ELSE 'not sent' END AS action,
 sha256(coalesce(text, '') || CASE WHEN source = '{UPDATED}' THEN '!' ELSE '' END) AS content_hash FROM documents""")
def store_upsert_actions(t: Tables) -> DataFrame:
    """The second batch's actions, and the stored versions after it."""
    store, actions = two_batches(t)
    held = store.table("documents").select("document_id", "content_hash")
    return held.join(actions, "document_id", "left").fillna("not sent", ["action"]).select("document_id", "action", "content_hash")


@query(f"""WITH b AS (SELECT CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {BUCKETS} AS bucket, source FROM documents)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS documents, bool_or(source IN ('{UPDATED}', '{ADDED}')) AS rewritten FROM b GROUP BY bucket""")
def store_bucket_rewrites(t: Tables) -> DataFrame:
    """Which buckets the second batch rewrote; all others keep the files of the first."""
    store, _ = two_batches(t)
    version = store.version()
    rewritten = store.changed_buckets("documents", version - 1, version)
    counts = store.table("documents").groupBy("bucket").agg(F.count("*").alias("documents"))
    return counts.withColumn("rewritten", F.col("bucket").isin(rewritten))


@query("""WITH RECURSIVE deps AS (SELECT 'document' AS uk, CAST(c_nationkey AS VARCHAR) AS u, 'chunk' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer
 UNION SELECT 'chunk', CAST(o_custkey AS VARCHAR), 'extraction', CAST(o_orderkey AS VARCHAR) FROM orders
 UNION SELECT 'extraction', CAST(o_orderkey AS VARCHAR), 'run', o_orderpriority || '/' || year(o_orderdate) FROM orders
 UNION SELECT 'extraction', CAST(l_orderkey AS VARCHAR), 'entity', CAST(l_partkey AS VARCHAR) FROM lineitem
 UNION SELECT 'entity', CAST(p_partkey AS VARCHAR), 'profile', p_type FROM part),
w(kind, id, depth) AS (SELECT 'document', CAST(n_nationkey AS VARCHAR), 0 FROM nation WHERE n_regionkey = 2 AND n_name LIKE '%A%'
 UNION SELECT d.kind, d.id, depth + 1 FROM w JOIN deps d ON d.uk = w.kind AND d.u = w.id)
SELECT kind, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL""")
def stale_after_change(t: Tables) -> DataFrame:
    """Nations are documents, customers chunks, orders extractions, parts entities: what a
    change of some nations makes stale, down to runs and profiles."""
    priority = t.orders.withColumn("run", F.concat_ws("/", "o_orderpriority", F.year("o_orderdate")))
    dependencies = (
        edges(t.customer, "document", "c_nationkey", "chunk", "c_custkey")
        .unionByName(edges(t.orders, "chunk", "o_custkey", "extraction", "o_orderkey"))
        .unionByName(edges(priority, "extraction", "o_orderkey", "run", "run"))
        .unionByName(edges(t.lineitem, "extraction", "l_orderkey", "entity", "l_partkey"))
        .unionByName(edges(t.part, "entity", "p_partkey", "profile", "p_type"))
    )
    nations = t.nation.where("n_regionkey = 2 AND n_name LIKE '%A%'")
    changed = nations.select(F.lit("document").alias("kind"), F.col("n_nationkey").cast("string").alias("id"))
    return invalidation_closure(dependencies, changed)


@query(f"""WITH {DOC_SQL}, m AS (SELECT er.doc_id, CASE index WHEN 0 THEN source WHEN 1 THEN lang ELSE 'third' END AS name FROM er JOIN documents USING (doc_id) WHERE reason IS NULL),
l AS (SELECT rr.doc_id, source, CASE index WHEN 0 THEN lang ELSE 'third' END AS target, index FROM rr JOIN documents USING (doc_id) WHERE reason IS NULL)
SELECT 'read' AS stage, 'usable' AS table, count(*) AS rows FROM ok
UNION ALL SELECT 'read', 'failed', (SELECT count(*) FROM base) - (SELECT count(*) FROM ok)
UNION ALL SELECT 'entity_checks', 'entity_checks', count(*) FROM er
UNION ALL SELECT 'relation_checks', 'relation_checks', count(*) FROM rr
UNION ALL SELECT 'resolve', 'entities', count(DISTINCT name) FROM m
UNION ALL SELECT 'resolve', 'assignment', count(*) FROM m
UNION ALL SELECT 'resolve', 'aliases', 0
UNION ALL SELECT 'merge', 'relations', count(DISTINCT (source, target, index)) FROM l
UNION ALL SELECT 'merge', 'links', (SELECT count(*) FROM m) + (SELECT count(*) FROM l)
UNION ALL SELECT 'quality', 'quality', 1""")
def graph_run_stages(t: Tables) -> DataFrame:
    """A graph build that stops after its second stage and then goes on: rows per stage."""
    store = RunStore(t.spark, _folder(t))

    class Stopped(RuntimeError):
        pass

    class Stopping(type(store.run("r"))):
        def stage(self, name, build):
            if name == "relation_checks":
                raise Stopped
            return super().stage(name, build)

    try:
        graph_stages(Stopping(t.spark, f"{store.root}/runs", "r"), completions(t))
    except Stopped:
        pass
    graph_stages(store.run("r"), None)
    return stage_listing(t.spark, f"{store.root}/runs").drop("run_id")


@query("""SELECT item_id + 1 AS case_index, 'What says passage ' || item_id || '?' AS user_input, sha256(text) AS reference_hash, item_id % 3 <> 0 AS answerable,
 CASE WHEN item_id % 3 <> 0 THEN 'd:' || item_id ELSE '' END AS evidence, CASE WHEN item_id % 3 <> 0 THEN 'single_hop' ELSE 'unanswerable' END AS question_type FROM benchmark""")
def testset_round_trip(t: Tables) -> DataFrame:
    """A test set written from the passages and read again, with the corpus hash checked."""
    key, answerable = F.col("item_id"), F.col("item_id") % 3 != 0
    none = F.array().cast("array<string>")
    evidence = F.when(answerable, F.array(F.concat(F.lit("d:"), key.cast("string")))).otherwise(none)
    made = t.benchmark.select(
        (key + 1).alias("case_index"), F.format_string("What says passage %d?", key).alias("user_input"),
        F.col("text").alias("reference"), F.array("text").alias("reference_contexts"), evidence.alias("evidence_ids"),
        evidence.alias("context_evidence_ids"), none.alias("document_ids"), F.array("text").alias("evidence_quotes"),
        F.when(answerable, "single_hop").otherwise("unanswerable").alias("question_type"), answerable.alias("answerable"),
        F.lit("none").alias("generator_model"), F.lit("1").alias("prompt_version"), F.lit("approved").alias("review_status"),
    )
    folder, corpus = _folder(t), "0f" * 32
    write_testset(made, folder, corpus)
    cases = read_testset(t.spark, folder, versions=("2",), corpus_hash=corpus).cases
    return cases.select(
        "case_index", "user_input", F.sha2("reference", 256).alias("reference_hash"), "answerable",
        F.array_join("evidence_ids", ",").alias("evidence"), "question_type",
    )


@query("""WITH r AS (SELECT 'rel_' || l_orderkey || '_' || l_linenumber AS relation_id, 'ent_s' || l_suppkey AS source, 'ent_p' || l_partkey AS target, l_orderkey AS chunk_id FROM lineitem),
 e AS (SELECT 'ent_p' || p_partkey AS entity_id, p_name AS canonical_name FROM part UNION ALL SELECT 'ent_s' || s_suppkey, s_name FROM supplier)
SELECT 'entity' AS kind, entity_id, canonical_name, (SELECT coalesce(string_agg(relation_id, ',' ORDER BY relation_id), '') FROM r WHERE source = entity_id) AS outgoing,
 (SELECT coalesce(string_agg(relation_id || '<' || source, ',' ORDER BY relation_id, source), '') FROM r WHERE target = entity_id) AS incoming,
 (SELECT count(DISTINCT chunk_id) FROM r WHERE target = entity_id OR source = entity_id) AS evidence FROM e WHERE starts_with(entity_id, 'ent_p1')""")
def inspected_entities(t: Tables) -> DataFrame:
    """All entities whose id begins with ent_p1, with relations and evidence nested; parts
    and suppliers are the entities, line items the relations."""
    def name(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    store = ObjectTables(t.spark, _folder(t))
    relations = t.lineitem.select(
        F.concat_ws("_", F.lit("rel"), "l_orderkey", "l_linenumber").alias("relation_id"),
        name("ent_s", "l_suppkey").alias("source_entity_id"), name("ent_p", "l_partkey").alias("target_entity_id"),
        F.col("l_orderkey").alias("chunk_id"),
    )
    entities = t.part.select(name("ent_p", "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name")).unionByName(
        t.supplier.select(name("ent_s", "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"))
    )
    ends = F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")
    store.save("entity", entities, "entity_id")
    store.save("outgoing", relations.drop("chunk_id"), "source_entity_id")
    store.save("incoming", relations.drop("chunk_id"), "target_entity_id")
    store.save("entity_evidence", relations.select(ends, "chunk_id").distinct(), "entity_id")
    found = store.inspect("ent_p1")
    return found.select(
        "kind", "entity_id", "canonical_name",
        F.array_join(F.transform("outgoing", lambda r: r["relation_id"]), ",").alias("outgoing"),
        F.array_join(F.transform("incoming", lambda r: F.concat(r["relation_id"], F.lit("<"), r["source_entity_id"])), ",").alias("incoming"),
        F.size("entity_evidence").cast("long").alias("evidence"),
    )
