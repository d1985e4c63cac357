"""Scores of ranked or cited evidence, by evidence ids or, where a case has none, by text.

A case of an older test set carries reference texts but no evidence ids. Its items are
matched to the reference texts one to one: in rank order each item takes the first text,
in sorted order, that it equals or overlaps and that nothing before it has used up.
Candidate pairs come from an equi-join on fingerprints within the case; only the greedy
choice is a fold, over the few items of one case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.functions.text import normalize_context, overlaps
from seekspark.operators.matching import reference_keys, segment_keys
from seekspark.operators.metrics import first_matches, gain
from seekspark.scale import cut_lineage


def cited_items(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Evidence rows in the order they are cited, with their ``rank``.

    ``evidence(case_id, citation_id, ...)`` and ``citations(case_id, position,
    citation_id)``; citations of something that isn't evidence of the case are left out.
    """
    order = Window.partitionBy("case_id").orderBy("position")
    return citations.join(evidence, ["case_id", "citation_id"]).withColumn("rank", F.row_number().over(order))


def text_candidates(items: DataFrame, contexts: DataFrame) -> DataFrame:
    """``case_id, rank, identity, contexts``: digests of the reference texts that an item
    may take, in the order of the texts. Items without any have an empty array."""
    offered = cut_lineage(items.select("case_id", "rank", normalize_context(F.col("text")).alias("item")))
    wanted = cut_lineage(
        contexts.select("case_id", normalize_context(F.col("text")).alias("context")).where(F.length("context") > 0).distinct()
    )
    filled = offered.where(F.length("item") > 0)
    keys = filled.select("case_id", "rank", F.explode(segment_keys("item")).alias("key"))
    asked = wanted.select("case_id", "context", F.explode(reference_keys("context")).alias("key"))
    met = keys.join(asked, ["case_id", "key"]).select("case_id", "rank", "context").distinct()
    pairs = met.join(offered, ["case_id", "rank"]).where(overlaps(F.col("item"), F.col("context")))
    listed = pairs.groupBy("case_id", "rank").agg(
        F.transform(F.array_sort(F.collect_list("context")), lambda c: F.sha2(c, 256)).alias("contexts")
    )
    none = F.array().cast("array<string>")
    return offered.join(listed, ["case_id", "rank"], "left").select(
        "case_id", "rank", F.sha2("item", 256).alias("identity"), F.coalesce("contexts", none).alias("contexts")
    )


def greedy_choice(candidates: DataFrame) -> DataFrame:
    """``case_id, rank`` of the items that take a reference text, in rank order per case."""
    none = F.array().cast("array<string>")

    def step(state: Column, item: Column) -> Column:
        taken = F.get(F.filter(item["contexts"], lambda c: ~F.array_contains(state["seen"], c)), F.lit(0))
        used = F.when(taken.isNull(), F.array(item["identity"])).otherwise(F.array(item["identity"], taken))
        ranks = F.when(taken.isNull(), state["ranks"]).otherwise(F.array_append(state["ranks"], item["rank"]))
        return F.struct(F.concat(state["seen"], used).alias("seen"), ranks.alias("ranks"))

    start = F.struct(none.alias("seen"), F.array().cast("array<int>").alias("ranks"))
    listed = candidates.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "identity", "contexts"))).alias("items")
    )
    return listed.select("case_id", F.explode(F.aggregate("items", start, step, lambda s: s["ranks"])).alias("rank"))


def evidence_scores(
    cases: DataFrame, items: DataFrame, gold: DataFrame, contexts: DataFrame, k: int, whole: bool = False
) -> DataFrame:
    """Hit, recall, reciprocal rank and nDCG per case, with the ``matching_method``.

    ``cases(case_id, by_text)``; ``items(case_id, rank, text, identities)``; ``gold(case_id,
    identity)`` for cases with ids, ``contexts(case_id, text)`` for those matched by text.
    An item counts once, however many new identities it brings. ``whole`` scores all items
    of a case, as for citations, and raises k to their number.
    """
    if k < 1:
        raise ValueError("k must be positive")
    items = items if whole else items.where(F.col("rank") <= k)
    by_text = cases.where("by_text").select("case_id")
    by_id = cases.where("not by_text").select("case_id")
    relevant = gold.join(by_id, "case_id", "left_semi").select("case_id", "identity").distinct()
    ranked = items.join(by_id, "case_id", "left_semi").select("case_id", "rank", F.explode("identities").alias("identity"))
    first = first_matches(ranked, relevant, ["case_id"], 2**31 - 1)
    texts = contexts.join(by_text, "case_id", "left_semi")
    chosen = greedy_choice(text_candidates(items.join(by_text, "case_id", "left_semi"), texts))
    wanted_texts = texts.select("case_id", normalize_context(F.col("text")).alias("identity")).where("length(identity) > 0").distinct()
    hits = (
        first.groupBy("case_id", F.col("first_rank").alias("rank")).agg(F.count("*").alias("found"))
        .unionByName(chosen.withColumn("found", F.lit(1).cast("long")))
        .groupBy("case_id").agg(
            F.sum("found").alias("matched_count"), F.min("rank").alias("best_rank"), F.sum(gain(F.col("rank"))).alias("dcg")
        )
    )
    wanted = relevant.unionByName(wanted_texts).groupBy("case_id").agg(F.count("*").alias("relevant_count"))
    returned = items.groupBy("case_id").agg(F.count("*").alias("retrieved_count"))
    joined = (
        cases.join(wanted, "case_id", "left").join(returned, "case_id", "left").join(hits, "case_id", "left")
        .fillna(0, ["relevant_count", "retrieved_count", "matched_count"]).fillna(0.0, ["dcg"])
    )
    applicable = F.col("relevant_count") > 0
    limit = F.greatest("retrieved_count", F.lit(k)) if whole else F.lit(k)
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.least("relevant_count", limit), F.lit(1)).cast("long")),
        F.lit(0.0), lambda total, rank: total + gain(rank),
    )
    return joined.select(
        "case_id",
        F.when(F.col("by_text"), "normalized_context_overlap").otherwise("evidence_id").alias("matching_method"),
        applicable.alias("applicable"), "relevant_count", "retrieved_count", "matched_count",
        F.when(applicable, F.col("best_rank").isNotNull().cast("double")).alias("hit_at_k"),
        F.when(applicable, F.col("matched_count") / F.col("relevant_count")).alias("recall_at_k"),
        F.when(applicable, F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))).alias("mrr"),
        F.when(applicable, F.col("dcg") / ideal).alias("ndcg_at_k"),
    )
