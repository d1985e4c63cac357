"""Relevance metrics, their aggregates, paired comparison and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.operators.quantiles import nearest_ranks
from seekspark.operators.setjoin import most_similar
from seekspark.scale import cut_lineage, small_side

# --- fixed values ------------------------------------------------------------
TIE = 1e-12
BOOTSTRAP_RESAMPLES = 20_000
BOOTSTRAP_SEED = 20_260_721
CONFIDENCE = 0.95
SEMANTIC_THRESHOLD = 0.75
# Vectors of one side in a block of cosines, about, and the values of one matrix product.
COSINE_ROWS = 2048
PRODUCT_VALUES = 2_000_000
# -----------------------------------------------------------------------------

METRICS = ("hit_at_k", "recall_at_k", "mrr", "ndcg_at_k")


def gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def first_matches(ranked: DataFrame, gold: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First rank of every gold identity per case.

    ``ranked`` has one row per (case, rank, identity) and ``gold`` one per (case,
    identity). An item counts only if it brings an identity not seen before, so the
    relevant ranks of a case are the distinct first ranks.
    """
    near = ranked.where(F.col("rank") <= k)
    return (
        near.join(gold.distinct(), [*keys, "identity"])
        .groupBy(*keys, "identity")
        .agg(F.min("rank").alias("first_rank"))
    )


def retrieval_scores(
    cases: DataFrame, ranked: DataFrame, gold: DataFrame, k: int, keys: Sequence[str] = ("case_id",)
) -> DataFrame:
    """Hit, recall, reciprocal rank and nDCG at k for every row of ``cases``."""
    if k < 1:
        raise ValueError("k must be positive")
    keys = list(keys)
    first = first_matches(ranked, gold, keys, k)
    ranks = first.groupBy(*keys, "first_rank").agg(F.count("*").alias("found"))
    hits = ranks.groupBy(*keys).agg(
        F.sum("found").alias("matched_count"),
        F.min("first_rank").alias("best_rank"),
        F.sum(gain(F.col("first_rank"))).alias("dcg"),
    )
    wanted = gold.distinct().groupBy(*keys).agg(F.count("*").alias("relevant_count"))
    returned = (
        ranked.where(F.col("rank") <= k).select(*keys, "rank").distinct()
        .groupBy(*keys).agg(F.count("*").alias("retrieved_count"))
    )
    joined = (
        cases.select(*keys).join(wanted, keys, "left").join(returned, keys, "left")
        .join(hits, keys, "left")
        .fillna(0, ["relevant_count", "retrieved_count", "matched_count"])
        .fillna(0.0, ["dcg"])
    )
    applicable = F.col("relevant_count") > 0
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least("relevant_count", F.lit(k)), F.lit(1))),
        F.lit(0.0),
        lambda total, rank: total + gain(rank),
    )
    return joined.select(
        *keys,
        applicable.alias("applicable"),
        "relevant_count", "retrieved_count", "matched_count",
        F.when(applicable, F.col("best_rank").isNotNull().cast("double")).alias("hit_at_k"),
        F.when(applicable, F.col("matched_count") / F.col("relevant_count")).alias("recall_at_k"),
        F.when(applicable, F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))).alias("mrr"),
        F.when(applicable, F.col("dcg") / ideal).alias("ndcg_at_k"),
    )


def greedy_text_relevance(items: Column, contexts: Column) -> Column:
    """Relevance flags of ranked texts against reference texts, each used once.

    Both sides are normalized. A text takes the first unused context, in sorted
    order, that equals or overlaps it.
    """
    from seekspark.functions.text import overlaps

    none = F.array().cast("array<string>")

    def step(state: Column, text: Column) -> Column:
        free = F.filter(
            F.array_except(contexts, state["seen"]), lambda context: overlaps(text, context)
        )
        match = F.try_element_at(F.array_sort(free), F.lit(1))
        return F.struct(
            F.concat(state["flags"], F.array(match.isNotNull())).alias("flags"),
            F.concat(
                state["seen"],
                F.when(match.isNull(), F.array(text)).otherwise(F.array(text, match)),
            ).alias("seen"),
        )

    start = F.struct(F.array().cast("array<boolean>").alias("flags"), none.alias("seen"))
    return F.aggregate(items, start, step, lambda state: state["flags"])


def macro_means(
    scores: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Means over applicable cases with counts; per key set and overall in one pass."""
    usable = F.col("applicable")
    return scores.groupBy(*keys).agg(
        F.count("*").alias("total_cases"),
        F.count_if(usable).alias("eligible_cases"),
        F.count_if(~usable).alias("excluded_cases"),
        *[F.avg(F.when(usable, F.col(m))).alias(m) for m in metrics],
        micro_recall().alias("micro_recall"),
    )


def micro_recall() -> Column:
    usable = F.col("applicable")
    matched = F.sum(F.when(usable, F.col("matched_count")))
    wanted = F.sum(F.when(usable, F.col("relevant_count")))
    return F.try_divide(matched, wanted).cast("double")


def by_question_type(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mode totals and mode x question type rows from one scan (grouping sets)."""
    usable = F.col("applicable")
    return scores.groupingSets(
        [[F.col("mode")], [F.col("mode"), F.col("question_type")]], F.col("mode"), F.col("question_type")
    ).agg(
        F.grouping("question_type").alias("is_total"),
        F.count("*").alias("case_count"),
        F.count_if(usable).alias("eligible_cases"),
        *[F.avg(F.when(usable, F.col(m))).alias(m) for m in metrics],
    )


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and nearest-rank percentiles, without interpolation; null values don't count."""
    shares = {"latency_p50": 0.5, "latency_p95": 0.95}
    found = nearest_ranks(df, value, keys, list(shares.values()))
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("share") == share, F.col("result"))).alias(name) for name, share in shares.items()]
    )
    means = df.groupBy(*keys).agg(F.avg(value).alias("latency_mean"))
    joined = means.join(small_side(wide), list(keys), "left") if keys else means.join(F.broadcast(wide))
    return joined.select(*keys, "latency_mean", *shares)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that aren't null, and the rows where they are; null values become NaN."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    size = np.unique(column.value_lengths().drop_null().to_numpy())
    if len(size) > 1:
        raise ValueError("embedding dimensions differ")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(at), int(size[0]) if len(size) else 0), at


def best_cosines(references: pa.Array, candidates: pa.Array) -> np.ndarray:
    """The best cosine of each reference, -1 to 1; what has no cosine counts as 1.

    Zero and empty vectors have cosine 0; null vectors and those that hold null or
    non-finite values have none.
    """
    (a, at), (b, _) = _rows(references), _rows(candidates)
    best = np.ones(len(references))
    if not len(a):
        return best
    if a.shape[1] != b.shape[1]:
        raise ValueError("embedding dimensions differ")
    b_norm = np.linalg.norm(b, axis=1)
    step = max(PRODUCT_VALUES // len(b), 1)
    with np.errstate(all="ignore"):
        for begin in range(0, len(a), step):
            part = a[begin : begin + step]
            scale = np.linalg.norm(part, axis=1)[:, None] * b_norm
            value = np.where(scale == 0.0, 0.0, part @ b.T / scale)
            value = np.clip(np.where(np.isnan(value), 1.0, value), -1.0, 1.0)
            best[at[begin : begin + step]] = value.max(axis=1)
    return best


def semantic_scores(
    references: DataFrame, retrieved: DataFrame, threshold: float = SEMANTIC_THRESHOLD,
    keys: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Best cosine per reference text against the retrieved texts of its own case.

    ``references(case_id, reference_id, embedding)`` and ``retrieved(case_id,
    embedding)``. All pairs of a case are compared, in matrix products of blocks of both
    sides; a block returns one value per reference, so no pair of rows crosses a shuffle.
    """
    if not math.isfinite(threshold) or not -1.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between -1 and 1")
    keys = list(keys)
    # Equal vectors of a case are compared once. Stored, as they may come from an embedder.
    rows = cut_lineage(references.select(*keys, "reference_id", "embedding").distinct())
    # New columns, as both sides may come from one frame.
    given = retrieved.select(*[F.col(k).alias(k) for k in keys], F.col("embedding").alias("candidate"))
    other = cut_lineage(given.where(F.col("candidate").isNotNull()).distinct())
    sizes = [df.groupBy(*keys).agg(F.ceil(F.count("*") / COSINE_ROWS).alias(f"{name}_blocks")) for name, df in (("left", rows), ("right", other))]
    grid = small_side(cut_lineage(sizes[0].join(sizes[1], keys)))

    def blocks(df: DataFrame, own: str, across: str, *columns: str) -> DataFrame:
        """Each row in one block of its side, copied to all blocks of the other side."""
        place = F.pmod(F.xxhash64(*columns), F.col(f"{own}_blocks")).alias(f"{own}_block")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{across}_blocks") - 1)).alias(f"{across}_block")
        return df.join(grid, keys).select(*keys, *columns, place, copies)

    by = [*keys, "left_block", "right_block"]
    left = blocks(rows, "left", "right", "reference_id", "embedding").groupBy(*by)
    right = blocks(other, "right", "left", "candidate").groupBy(*by)
    plain = rows.select(*keys, "reference_id", F.lit(-1.0).alias("best"))
    names = [*keys, "reference_id"]

    def score(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return some.select(names).slice(0, 0).append_column("best", pa.array([], pa.float64()))
        found = best_cosines(some["embedding"].combine_chunks(), others["candidate"].combine_chunks())
        return some.select(names).append_column("best", pa.array(found))

    met = left.cogroup(right).applyInArrow(score, plain.schema)
    best = plain.unionByName(met).groupBy(*names).agg(F.max("best").alias("best"))
    covered = (F.round("best", 12) >= threshold).cast("double")
    return best.groupBy(*keys).agg(
        F.count("*").alias("reference_count"),
        F.avg("best").alias("mean_max_similarity"),
        F.avg(covered).alias("threshold_recall"),
        F.min(covered).alias("all_references_covered"),
    )


def evidence_coverage(
    evidence: DataFrame, document: DataFrame, ranked_documents: DataFrame,
    keys: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Whether all evidence and all source documents survived ranking."""
    keys = list(keys)
    sources = (
        ranked_documents.where(F.length("document_id") > 0).groupBy(*keys)
        .agg(F.count_distinct("document_id").alias("distinct_source_count"))
    )
    left = evidence.select(
        *keys, F.col("applicable").alias("e_ok"),
        (F.col("matched_count") == F.col("relevant_count")).cast("double").alias("chain"),
    )
    right = document.select(
        *keys, F.col("applicable").alias("d_ok"), F.col("recall_at_k").alias("coverage"),
        (F.col("matched_count") == F.col("relevant_count")).cast("double").alias("all_docs"),
    )
    ok = F.col("e_ok") & F.col("d_ok")
    return left.join(right, keys).join(sources, keys, "left").select(
        *keys,
        ok.alias("applicable"),
        F.when(ok, F.col("chain")).alias("complete_chain"),
        F.when(ok, F.col("coverage")).alias("document_coverage"),
        F.when(ok, F.col("all_docs")).alias("all_documents_covered"),
        F.coalesce("distinct_source_count", F.lit(0)).alias("distinct_source_count"),
    )


# --- paired comparison ---------------------------------------------------------
def paired_deltas(
    baseline: DataFrame, candidate: DataFrame, metrics: Sequence[str], key: str = "case_id"
) -> DataFrame:
    """Long ``case, label, delta`` rows; a case missing on one side is an error."""
    left = baseline.select(key, F.col("applicable").alias("l_ok"), *[F.col(m).alias(f"l_{m}") for m in metrics])
    right = candidate.select(key, F.col("applicable").alias("r_ok"), *[F.col(m).alias(f"r_{m}") for m in metrics])
    both = left.join(right, key, "full_outer")
    aligned = F.when(
        F.col("l_ok").isNull() | F.col("r_ok").isNull(),
        F.raise_error(F.lit("paired comparison received misaligned cases")),
    ).otherwise(F.col("l_ok") & F.col("r_ok"))
    pairs = F.array(
        *[F.struct(F.lit(m).alias("label"), (F.col(f"r_{m}") - F.col(f"l_{m}")).alias("delta")) for m in metrics]
    )
    return (
        both.where(aligned)
        .select(key, F.inline(pairs))
        .where(F.col("delta").isNotNull())
    )


def paired_summary(deltas: DataFrame, lower_is_better: Sequence[str] = ("latency_seconds",)) -> DataFrame:
    """Wins, ties, losses and mean delta per metric label."""
    better = F.when(F.col("label").isin(list(lower_is_better)), -F.col("delta")).otherwise(F.col("delta"))
    total = F.count("*")
    wins, losses = F.count_if(better > TIE), F.count_if(better < -TIE)
    ties = F.count_if(F.abs("delta") <= TIE)
    return deltas.groupBy("label").agg(
        total.alias("eligible_pairs"),
        wins.alias("candidate_wins"), ties.alias("ties"), losses.alias("baseline_wins"),
        (wins / total).alias("candidate_win_rate"),
        (ties / total).alias("tie_rate"),
        (losses / total).alias("baseline_win_rate"),
        F.avg("delta").alias("mean_delta"),
    )


def nearest_rank(ordered: Sequence[float], quantile: float) -> float:
    return ordered[max(0, math.ceil(len(ordered) * quantile) - 1)]


def bootstrap_interval(values: Sequence[float], label: str, resamples: int) -> tuple[float, float]:
    """Percentile interval of the resampled mean; the seed depends on the label."""
    digest = hashlib.sha256(label.encode("utf-8")).digest()
    draw = random.Random(BOOTSTRAP_SEED + int.from_bytes(digest[:8], "big")).randrange
    n = len(values)
    means = sorted(sum(values[draw(n)] for _ in range(n)) / n for _ in range(resamples))
    tail = (1.0 - CONFIDENCE) / 2.0
    return nearest_rank(means, tail), nearest_rank(means, 1.0 - tail)


def bootstrap_means(deltas: DataFrame, resamples: int = BOOTSTRAP_RESAMPLES, key: str = "case_id") -> DataFrame:
    """95 % interval per label. One label is one task: its values are evaluation cases,
    one number each, in case order, which the seeded draw depends on."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(key)["delta"].tolist()
        label = pdf["label"].iloc[0]
        low, high = bootstrap_interval(values, label, resamples)
        return pd.DataFrame({"label": [label], "ci_low": [low], "ci_high": [high]})

    return deltas.select(key, "label", "delta").groupBy("label").applyInPandas(
        one, "label string, ci_low double, ci_high double"
    )


# --- answer behaviour and citations ---------------------------------------------
def behavior_report(cases: DataFrame, *keys: str) -> DataFrame:
    """Confusion matrix with answerable as the positive class, and its rates."""
    a, r = F.col("answerable"), F.col("insufficient_evidence")
    usable = a.isNotNull() & r.isNotNull()
    counts = cases.groupBy(*keys).agg(
        F.count("*").alias("total_cases"),
        F.count_if(usable).alias("eligible_cases"),
        F.count_if(a & ~r).alias("tp"),
        F.count_if(~a & ~r).alias("fp"),
        F.count_if(a & r).alias("fn"),
        F.count_if(~a & r).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.try_divide(top, bottom).cast("double")

    return counts.select(
        *keys, "total_cases", "eligible_cases", "tp", "fp", "fn", "tn",
        ratio(tp + tn, F.col("eligible_cases")).alias("refusal_accuracy"),
        ratio(tp, tp + fp).alias("answerability_precision"),
        ratio(tp, tp + fn).alias("answerability_recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("answerability_f1"),
        ratio(fp, fp + tn).alias("false_answer_rate"),
        ratio(fn, tp + fn).alias("false_refusal_rate"),
        ratio(tn, fp + tn).alias("unanswerable_refusal_rate"),
    )


def citation_report(cases: DataFrame, *keys: str) -> DataFrame:
    """Means of citation completeness, correctness and unsupported claims over answerable cases."""
    judged = F.col("citation_correctness").isNotNull()
    return cases.where("answerable").groupBy(*keys).agg(
        F.count("*").alias("eligible_cases"),
        F.count_if(judged).alias("judged_cases"),
        F.avg("citation_correctness").alias("citation_correctness"),
        F.avg("reference_coverage").alias("citation_completeness"),
        F.avg("unsupported_claim_rate").alias("unsupported_claim_rate"),
        F.array_join(F.array_sort(F.collect_set("matching_method")), ",").alias("matching_methods"),
    )


def value_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    value = F.coalesce(F.lower(F.col(column).cast("string")), F.lit("missing"))
    return df.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))


# --- agent runs ----------------------------------------------------------------
def agent_run_scores(
    events: DataFrame, read: DataFrame, cited: DataFrame, gold: DataFrame
) -> DataFrame:
    """Tool use, evidence use, citation and refusal scores per run.

    ``events(run_id, position, event, tool, ok, insufficient, answerable)``,
    ``read(run_id, chunk_id, identity)`` for the evidence of the last answer,
    ``cited(run_id, chunk_id)``, ``gold(run_id, identity)``.
    """
    result = F.col("event") == "tool_result"
    answer = F.col("event") == "answer"
    runs = events.groupBy("run_id").agg(
        F.count_if(result).alias("tool_call_count"),
        F.count_if(result & F.col("ok")).alias("successful_tool_calls"),
        F.max_by(F.when(answer, F.col("insufficient")), F.when(answer, F.col("position"))).alias("insufficient_evidence"),
        F.max("answerable").alias("answerable"),
    )
    chunks = read.select("run_id", "chunk_id").distinct()
    citations = cited.select("run_id", "chunk_id").distinct()
    valid = citations.join(chunks, ["run_id", "chunk_id"], "left_semi")
    found = read.select("run_id", "identity").distinct()
    cited_found = read.join(valid, ["run_id", "chunk_id"], "left_semi").select("run_id", "identity").distinct()
    wanted = gold.select("run_id", "identity").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name))

    both = ["run_id", "identity"]
    parts = [
        count(chunks, "read_evidence_count"), count(citations, "cited_evidence_count"),
        count(valid, "valid_citations"), count(found, "found"), count(cited_found, "cited_found"),
        count(wanted, "wanted"), count(found.join(wanted, both, "left_semi"), "matched"),
        count(cited_found.join(wanted, both, "left_semi"), "cited_matched"),
    ]
    table = runs
    for part in parts:
        table = table.join(part, "run_id", "left")
    names = [part.columns[1] for part in parts]
    table = table.fillna(0, names)

    def ratio(top: str, bottom: str) -> Column:
        return F.try_divide(F.col(top), F.col(bottom)).cast("double")

    known = F.col("wanted") > 0
    return table.select(
        "run_id", "tool_call_count", "successful_tool_calls", "read_evidence_count", "cited_evidence_count",
        ratio("valid_citations", "read_evidence_count").alias("evidence_utilization"),
        ratio("valid_citations", "cited_evidence_count").alias("citation_validity"),
        F.when(known, F.coalesce(ratio("cited_matched", "cited_found"), F.lit(0.0))).alias("citation_reference_precision"),
        F.when(known, F.coalesce(ratio("matched", "found"), F.lit(0.0))).alias("reference_evidence_precision"),
        F.when(known, ratio("matched", "wanted")).alias("reference_evidence_recall"),
        "insufficient_evidence",
        (F.col("insufficient_evidence") == ~F.col("answerable")).alias("refusal_correct"),
    )


def tool_counts(events: DataFrame) -> DataFrame:
    return events.where((F.col("event") == "tool_result") & F.col("tool").isNotNull()).groupBy("run_id", "tool").agg(F.count("*").alias("calls"))


AGENT_MEANS = (
    "tool_call_count", "successful_tool_calls", "read_evidence_count", "cited_evidence_count",
    "evidence_utilization", "citation_validity", "citation_reference_precision",
    "reference_evidence_precision", "reference_evidence_recall",
)


def agent_means(scores: DataFrame) -> DataFrame:
    """Macro means over runs; a run without a value does not count for that mean."""
    return scores.agg(
        F.count("*").alias("runs"),
        *[F.avg(name).alias(name) for name in AGENT_MEANS],
        F.avg(F.col("refusal_correct").cast("double")).alias("refusal_accuracy"),
    )


# --- evaluation sets --------------------------------------------------------------
def smoke_sample(cases: DataFrame, quotas: dict[str, int], key: str = "case_index") -> DataFrame:
    """First n cases per question type, then the next cases in order up to the total."""
    target = sum(quotas.values())
    quota = F.lit(0)
    for name, size in quotas.items():
        quota = F.when(F.col("question_type") == name, size).otherwise(quota)
    per_type = Window.partitionBy("question_type").orderBy(key)
    marked = cases.withColumn("place", F.row_number().over(per_type)).where(
        F.col("place") <= target
    )
    filled = marked.withColumn("late", (F.col("place") > quota).cast("int"))
    return filled.orderBy("late", key).limit(target).drop("place", "late")


def coverage_by_document(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct questions and contexts per document, zero where there are none."""
    counted = links.groupBy("document_id").agg(
        F.count_distinct("case_id").alias("questions"),
        F.count("*").alias("contexts"),
    )
    return documents.select("document_id").distinct().join(counted, "document_id", "left").fillna(
        0, ["questions", "contexts"]
    )


def related_context(primaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Most similar candidate document by Jaccard of distinct terms.

    Both are distinct ``id, group_id, term`` rows; a primary meets candidates of its own
    ``group_id`` through the filters of the set join. Candidates without any shared term
    tie at zero, where the smallest id stands for them.
    """
    lefts = primaries.select("group_id", "id").distinct()
    best = most_similar(primaries, candidates).withColumnRenamed("left_id", "id")
    fallback = candidates.groupBy("group_id").agg(F.min("id").alias("smallest"))
    return (
        lefts.join(small_side(fallback), "group_id", "left").join(best, ["group_id", "id"], "left")
        .select(
            "group_id", "id", F.coalesce("right_id", "smallest").alias("related_id"),
            F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"),
        )
    )
