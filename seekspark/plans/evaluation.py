"""Evaluation of retrieval strategies and answers against a versioned test set.

All cases of a mode are asked in one plan, against one pinned index profile, whose corpus
hash the test set must carry. Hits and delivered context are each scored by evidence (ids,
or texts for sets without ids), by source document, by joint coverage and by embedding
similarity; answers by their citations and by whether they refuse.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.functions.ids import evidence_ids
from seekspark.functions.vectors import embed_column
from seekspark.operators import citations, metrics
from seekspark.plans import answers
from seekspark.plans.indexing import Index
from seekspark.plans.options import RetrievalOptions
from seekspark.plans.retrieval import Reranker, Retrieval, retrieve
from seekspark.scale import cut_lineage
from seekspark.sources.testsets import TestSet

SCOPES = ("hits", "context")


@dataclass
class Evaluation:
    """One row per mode, scope and case in each table.

    ``evidence`` and ``documents``: relevance scores; ``coverage``: evidence chains;
    ``semantic``: similarity to the reference texts; ``cited``: the cited evidence of the
    answers; ``answers``: refusals beside answerability. ``profile_id`` is what was asked.
    """

    profile_id: str
    evidence: DataFrame
    documents: DataFrame
    coverage: DataFrame
    semantic: DataFrame
    cited: DataFrame
    answers: DataFrame

    def means(self) -> DataFrame:
        """Macro means per mode and scope over the cases that apply."""
        parts = [
            metrics.macro_means(table, ["mode", "scope"]).withColumn("kind", F.lit(kind))
            for kind, table in (("evidence", self.evidence), ("documents", self.documents), ("cited", self.cited))
        ]
        return reduce(DataFrame.unionByName, parts)

    def behavior(self) -> DataFrame:
        return metrics.behavior_report(self.answers, "mode")


def evidence_items(index: Index, ranked: DataFrame) -> DataFrame:
    """``case_id, rank, text, identities, document_id`` of ``case_id, rank, object_id``."""
    place = [F.col(c) for c in ("document_id", "page_start", "page_end", "section_path")]
    body = index.chunks.select("object_id", "text", "document_id", evidence_ids(*place).alias("identities"))
    return ranked.join(body, "object_id").select("case_id", "rank", "object_id", "text", "identities", "document_id")


def _gold(test_set: TestSet) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases, evidence ids, reference texts and source documents of a test set."""
    table = cut_lineage(test_set.cases.withColumn("case_id", F.col("case_index").cast("string")))
    old = test_set.schema_version == "1"
    if old:
        none = F.array().cast("array<string>")
        table = table.withColumns({"evidence_ids": none, "document_ids": none, "answerable": F.lit(True), "question_type": F.lit("legacy")})
    cases = table.select("case_id", "user_input", "answerable", "question_type", F.lit(old).alias("by_text"))
    identities = table.select("case_id", F.explode("evidence_ids").alias("identity"))
    texts = table.select("case_id", F.posexplode("reference_contexts").alias("reference_id", "text"))
    sources = table.where("answerable").select("case_id", F.explode("document_ids").alias("identity"))
    return cases, identities, texts, sources


def _similarity(index: Index, cases: DataFrame, texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    asked = texts.join(cases.where("answerable").select("case_id"), "case_id", "left_semi")
    references = asked.select("case_id", "reference_id", embed_column(index.embedder, F.col("text")).alias("embedding"))
    given = items.select("case_id", embed_column(index.embedder, F.col("text")).alias("embedding"))
    return metrics.semantic_scores(references, given, threshold)


def evaluate_testset(
    index: Index, test_set: TestSet, modes: Sequence[str], options: RetrievalOptions | None = None,
    reranker: Reranker | None = None, threshold: float = metrics.SEMANTIC_THRESHOLD,
) -> Evaluation:
    """Ask all cases with every mode and score what comes back.

    The test set must have been made for the index's corpus. Answers are the deterministic
    ones; a client's answers can be scored by ``citations.evidence_scores`` alike.
    """
    if test_set.corpus_content_hash != index.metadata.get("fingerprint"):
        raise ValueError("the test set was made for another corpus than the index profile")
    options = options or RetrievalOptions()
    cases, identities, texts, sources = _gold(test_set)
    judged = cases.select("case_id", "by_text")
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("user_input").alias("text"))
    tables: dict[str, list[DataFrame]] = {name: [] for name in ("evidence", "documents", "coverage", "semantic", "cited", "answers")}

    def add(name: str, mode: str, scope: str, frame: DataFrame) -> DataFrame:
        tables[name].append(frame.select(F.lit(mode).alias("mode"), F.lit(scope).alias("scope"), "*"))
        return frame

    for mode in modes:
        found = retrieve(index, asked, mode, options, reranker)
        for scope, ranked in zip(SCOPES, _ranked(found)):
            items = cut_lineage(evidence_items(index, ranked))
            evidence = add("evidence", mode, scope, cut_lineage(citations.evidence_scores(judged, items, identities, texts, options.top_k)))
            documents = items.select("case_id", "rank", F.col("document_id").alias("identity"))
            by_source = add("documents", mode, scope, cut_lineage(metrics.retrieval_scores(cases, documents, sources, options.top_k)))
            add("coverage", mode, scope, metrics.evidence_coverage(evidence, by_source, items))
            add("semantic", mode, scope, _similarity(index, cases, texts, items, threshold))
        given = cut_lineage(answers.checked_answers(answers.deterministic_answers(found), found.context))
        cited = given.select(F.col("query_id").alias("case_id"), F.posexplode("citations").alias("position", "citation_id"))
        delivered = items.withColumn("citation_id", F.col("object_id")).drop("rank")
        add("cited", mode, "context", citations.evidence_scores(
            judged, citations.cited_items(delivered, cited), identities, texts, options.top_k, whole=True
        ))
        refusal = given.select(F.col("query_id").alias("case_id"), "insufficient_evidence")
        add("answers", mode, "context", cases.select("case_id", "answerable", "question_type").join(refusal, "case_id", "left"))
    whole = {name: reduce(DataFrame.unionByName, frames) for name, frames in tables.items()}
    return Evaluation(index.profile_id, **whole)


def _ranked(found: Retrieval) -> tuple[DataFrame, DataFrame]:
    case = F.col("query_id").alias("case_id")
    return (
        found.hits.select(case, "rank", "object_id"),
        found.context.select(case, F.col("position").alias("rank"), "object_id"),
    )
