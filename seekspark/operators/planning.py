"""Deterministic plans for evaluation cases: how many of which type, from which contexts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.operators.metrics import related_context

# --- fixed values: question types in order with their shares -------------------
SHARES = {
    "single_hop": 1 / 2, "summary_reasoning": 1 / 6, "multi_context": 1 / 6, "unanswerable": 1 / 6,
}
# -----------------------------------------------------------------------------


def apportion(size: int) -> dict[str, int]:
    """Cases per type by largest remainder, ties in type order."""
    exact = {name: size * share for name, share in SHARES.items()}
    counts = {name: math.floor(value) for name, value in exact.items()}
    by_rest = sorted(SHARES, key=lambda name: counts[name] - exact[name])
    for name in by_rest[: size - sum(counts.values())]:
        counts[name] += 1
    return counts


def plan_contexts(contexts: DataFrame, size: int) -> DataFrame:
    """Round-robin draws: ``case_index, question_type, draw, document_id, context_id``.

    ``contexts(document_id, place, context_id)`` with places from 0. Documents take turns
    per type; every draw moves the document's own cursor. Only as many documents as a
    type has cases can take part, so the ordered head of them is enough.
    """
    if size < 1:
        raise ValueError("size must be positive")
    counts = apportion(size)
    lengths = contexts.groupBy("document_id").agg(F.count("*").alias("n_contexts"))
    head = lengths.orderBy("document_id").limit(max(counts.values()) + 1)
    turn = Window.orderBy("document_id")  # at most size rows
    turns = head.withColumn("turn", F.row_number().over(turn) - 1)
    total = lengths.agg(F.count("*").alias("n_documents"))
    cases, start = [], 0
    for number, (name, count) in enumerate(counts.items()):
        draws = 2 if name == "summary_reasoning" else 1
        cases += [(start + i + 1, name, i, number, d) for i in range(count) for d in range(draws)]
        start += count
    drawn = contexts.sparkSession.createDataFrame(
        cases, "case_index int, question_type string, offset int, number int, draw int"
    )
    placed = (
        drawn.join(F.broadcast(total)).withColumn("turn", F.col("offset") % F.col("n_documents"))
        .withColumn("next_turn", (F.col("offset") + 1) % F.col("n_documents"))
        .join(F.broadcast(turns), "turn")
    )
    cursor = Window.partitionBy("document_id").orderBy("number", "offset", "draw")
    chosen = placed.withColumn("place", (F.row_number().over(cursor) - 1) % F.col("n_contexts"))
    other = turns.select(F.col("turn").alias("next_turn"), F.col("document_id").alias("other_document"))
    return (
        contexts.join(F.broadcast(chosen), ["document_id", "place"])
        .join(F.broadcast(other), "next_turn", "left")
        .select(
            "case_index", "question_type", "draw", "document_id", "context_id",
            F.when(F.col("question_type") == "multi_context", F.col("other_document")).alias("other_document"),
        )
    )


def second_contexts(plan: DataFrame, terms: DataFrame) -> DataFrame:
    """For multi-context cases the most similar context of the other document.

    ``terms(document_id, context_id, term)`` are distinct terms of all contexts.
    """
    wanted = plan.where(F.col("other_document").isNotNull())
    asked = wanted.join(terms, ["document_id", "context_id"]).select(
        F.col("other_document").alias("group_id"), F.col("case_index").alias("id"), "term"
    )
    offered = terms.select(F.col("document_id").alias("group_id"), F.col("context_id").alias("id"), "term")
    return related_context(asked, offered).select(
        F.col("id").alias("case_index"), F.col("group_id").alias("document_id"),
        F.col("related_id").alias("context_id"), "jaccard",
    )


def below_minimum(plan: DataFrame, documents: DataFrame, minimum: int) -> DataFrame:
    """Documents that fewer than ``minimum`` cases use; must be empty."""
    used = plan.groupBy("document_id").agg(F.count_distinct("case_index").alias("cases"))
    return documents.select("document_id").distinct().join(used, "document_id", "left").fillna(
        0, ["cases"]
    ).where(F.col("cases") < minimum)
