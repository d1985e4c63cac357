"""Extraction job bookkeeping: eligibility, attempts, run counters, reviews.

State is derived from append-only tables. A Spark task owns its rows alone, so the
compare-and-swap of a shared row store becomes a join that yields new log rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions.ids import stable_id

STAGES = ("extract", "repair", "glean")
ACCEPTED_REVIEWS = ("not_required", "approved")
PRIVATE_FIELDS = ("messages", "raw_response")


def is_eligible(now: Column) -> Column:
    """Pending and due, or running with an expired lease."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return ((F.col("status") == "pending") & due) | (
        (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    )


def as_time(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def stage_counts(attempts: DataFrame, *keys: str) -> DataFrame:
    """Attempts per key and stage as columns; one aggregate, no pivot job."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        *[F.count_if(F.col("stage") == s).alias(f"{s}_attempts") for s in STAGES],
    )


def pending_jobs(
    extractions: DataFrame, items: DataFrame, chunks: DataFrame, attempts: DataFrame,
    now: datetime | Column,
) -> DataFrame:
    """Eligible jobs of every run with their chunk and the attempts already spent.

    Counts are aggregated before the join, so a job with many attempts stays one row.
    """
    totals = stage_counts(attempts, "extraction_id").drop("attempts")
    own = attempts.groupBy("extraction_id", "run_id").agg(
        F.count("*").alias("run_attempt_count")
    )
    jobs = (
        extractions.where(is_eligible(as_time(now)))
        .join(items.select("run_id", "extraction_id"), "extraction_id")
        .join(chunks.select("chunk_id", "document_id"), "chunk_id")
        .join(own, ["extraction_id", "run_id"], "left")
        .join(totals, "extraction_id", "left")
    )
    counts = ["run_attempt_count", *[f"{s}_attempts" for s in STAGES]]
    return jobs.fillna(0, counts)


def accepted_results(extractions: DataFrame, items: DataFrame) -> DataFrame:
    kept = items.where(F.col("review_status").isin(*ACCEPTED_REVIEWS))
    return extractions.where(F.col("status") == "succeeded").join(kept, "extraction_id")


def run_counters(extractions: DataFrame, items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Chunk, attempt and token counters of every run, and the derived status."""
    status, review = F.col("status"), F.col("review_status")
    by_run = (
        items.join(extractions.select("extraction_id", "status"), "extraction_id")
        .groupBy("run_id")
        .agg(
            F.count("*").alias("total_chunks"),
            F.count_if(F.col("disposition") == "cached").alias("cached_chunks"),
            F.count_if(F.col("disposition") == "scheduled").alias("scheduled_chunks"),
            F.count_if((status == "succeeded") & review.isin(*ACCEPTED_REVIEWS)).alias(
                "succeeded_chunks"
            ),
            F.count_if(
                status.isin("succeeded", "needs_review") & (review == "pending")
            ).alias("needs_review_chunks"),
            F.count_if((status == "failed") | (review == "rejected")).alias("failed_chunks"),
        )
    )
    usage = (
        attempts.join(items.select("run_id", "extraction_id"), ["run_id", "extraction_id"])
        .groupBy("run_id")
        .agg(
            F.count("*").alias("attempt_count"),
            *[F.count_if(F.col("stage") == s).alias(f"{s}_count") for s in STAGES],
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
        )
    )
    joined = by_run.join(usage, "run_id", "left")
    numbers = [name for name, kind in joined.dtypes if kind == "bigint"]
    return joined.fillna(0, numbers).withColumn("run_status", run_status())


def run_status() -> Column:
    failed, done = F.col("failed_chunks"), F.col("succeeded_chunks")
    open_chunks = F.col("total_chunks") - done - F.col("needs_review_chunks") - failed
    return (
        F.when(open_chunks > 0, "running")
        .when(F.col("needs_review_chunks") > 0, "awaiting_review")
        .when((failed > 0) & (done > 0), "completed_with_failures")
        .when(failed > 0, "failed")
        .otherwise("completed")
    )


def prepare_jobs(
    chunks: DataFrame, known: DataFrame, config_hash: str, review_required: bool = False
) -> DataFrame:
    """Content-addressed jobs for chunks: cached when a success is already stored."""
    keyed = chunks.withColumn(
        "extraction_id",
        stable_id("xtr", F.col("chunk_id"), F.col("content_hash"), F.lit(config_hash)),
    )
    prior = known.select("extraction_id", F.col("status").alias("known_status"))
    cached = F.coalesce(F.col("known_status") == "succeeded", F.lit(False))
    waits = F.lit(review_required) & ~cached
    return keyed.join(prior, "extraction_id", "left").select(
        "extraction_id",
        "chunk_id",
        F.when(cached, "cached").otherwise("scheduled").alias("disposition"),
        F.when(waits, "pending").otherwise("not_required").alias("review_status"),
        F.when(F.col("known_status") == "failed", "pending")
        .otherwise(F.coalesce("known_status", F.lit("pending")))
        .alias("status"),
    )


def claim_jobs(
    extractions: DataFrame, attempts: DataFrame, stage: str, now: datetime | Column,
    lease_seconds: int, max_attempts: int, max_stage_attempts: int,
) -> DataFrame:
    """New attempt rows for all eligible jobs whose attempt budgets are not used up."""
    if stage not in STAGES:
        raise ValueError(f"unsupported attempt stage: {stage}")
    if lease_seconds <= 0 or max_attempts <= 0:
        raise ValueError("lease_seconds and max_attempts must be positive")
    if max_stage_attempts < 0:
        raise ValueError("max_stage_attempts must not be negative")
    spent = attempts.groupBy("extraction_id").agg(
        F.count("*").alias("spent"),
        F.count_if(F.col("stage") == stage).alias("stage_spent"),
    )
    open_jobs = (
        extractions.where(is_eligible(as_time(now)))
        .join(spent, "extraction_id", "left")
        .fillna(0, ["spent", "stage_spent"])
    )
    ordinal = F.col("spent") + 1
    expires = as_time(now) + F.make_dt_interval(secs=F.lit(lease_seconds))
    return open_jobs.where(
        (F.col("spent") < max_attempts) & (F.col("stage_spent") < max_stage_attempts)
    ).select(
        stable_id("xat", F.col("extraction_id"), ordinal).alias("attempt_id"),
        "extraction_id",
        ordinal.alias("ordinal"),
        F.lit(stage).alias("stage"),
        F.lit("running").alias("outcome"),
        expires.alias("lease_expires_at"),
    )


def exhausted_jobs(
    extractions: DataFrame, attempts: DataFrame, now: datetime | Column, max_attempts: int
) -> DataFrame:
    """Open jobs that may not be tried again; the caller appends a failed state for them."""
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") <= as_time(now))
    spent = attempts.groupBy("extraction_id").agg(F.count("*").alias("spent"))
    return (
        extractions.where((F.col("status") == "pending") | expired)
        .join(spent.where(F.col("spent") >= max_attempts), "extraction_id")
        .withColumn("status", F.lit("failed"))
    )


def latest_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current row per key of an append-only log; max_by reduces map-side."""
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(key).agg(newest.alias("now")).select(key, "now.*")


def interrupted_attempts(attempts: DataFrame) -> DataFrame:
    """Running attempts that a later attempt of the same job has overtaken."""
    last = attempts.groupBy("extraction_id").agg(F.max("ordinal").alias("last"))
    return (
        attempts.where(F.col("outcome") == "running")
        .join(last, "extraction_id")
        .where(F.col("ordinal") < F.col("last"))
        .drop("last")
        .withColumn("outcome", F.lit("interrupted"))
    )


def review_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``decisions(run_id, extraction_id, decision)`` to items awaiting review."""
    verdict = (
        F.when(F.col("decision") == "approve", "approved")
        .when(F.col("decision") == "reject", "rejected")
        .when(F.col("decision").isNotNull(), F.raise_error(F.lit("decision must be approve or reject")))
    )
    joined = items.join(decisions, ["run_id", "extraction_id"], "left")
    pending = F.col("review_status") == "pending"
    return joined.withColumn(
        "review_status", F.when(pending, F.coalesce(verdict, "review_status")).otherwise(F.col("review_status"))
    ).drop("decision")


def runs_touched(items: DataFrame, extractions: DataFrame, chunks: DataFrame, documents: DataFrame):
    """Distinct runs that used a chunk of one of the given documents."""
    doomed = chunks.join(documents.select("document_id"), "document_id", "left_semi")
    used = extractions.join(doomed.select("chunk_id"), "chunk_id", "left_semi")
    return items.join(used.select("extraction_id"), "extraction_id", "left_semi").select("run_id").distinct()


def failures(extractions: DataFrame, items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Failed jobs with their last attempt and the kind of failure."""
    last = latest_state(
        attempts.select("extraction_id", "ordinal", "stage", "outcome"),
        "extraction_id",
        ["ordinal", "stage", "outcome"],
    )
    failed = extractions.where(F.col("status") == "failed").join(items, "extraction_id")
    kind = F.when(F.col("review_status") == "rejected", "review_rejected").otherwise(
        F.coalesce("outcome", F.lit("failed"))
    )
    return failed.join(last, "extraction_id", "left").select(
        "run_id", "extraction_id", "chunk_id",
        F.coalesce("ordinal", F.lit(0)).alias("attempt"), "stage", kind.alias("failure_kind"),
    )


def redact(attempts: DataFrame) -> DataFrame:
    """Attempts without prompts and raw responses."""
    return attempts.drop(*PRIVATE_FIELDS)


def attempt_outcome() -> Column:
    """Outcome label from validated / covers_baseline / provider and validation errors."""
    regressed = (F.col("stage") == "glean") & F.col("has_baseline") & ~F.col("covers_baseline")
    return (
        F.when(F.col("validated") & regressed, "glean_regressed")
        .when(F.col("validated"), "succeeded")
        .when(F.col("provider_retryable"), "provider_retryable")
        .when(~F.col("provider_retryable"), "provider_terminal")
        .otherwise(F.col("validation_kind"))
    )


def next_step(max_repairs: int = 1) -> Column:
    """Route after an attempt: complete, glean, retry or fail."""
    repairs = F.col("repair_attempts")
    spent = F.col("run_attempt_number") >= F.col("max_attempts")
    repair_spent = repairs >= max_repairs
    may_glean = (F.col("stage") == "extract") & (
        F.col("glean_attempts") < F.col("max_glean_attempts")
    ) & (repairs == 0)
    return (
        F.when(F.col("stage") == "glean", "complete")
        .when(F.col("validated") & may_glean, "glean")
        .when(F.col("validated"), "complete")
        .when(spent, "fail")
        .when((F.col("stage") == "repair") & repair_spent, "fail")
        .when(F.col("provider_retryable").isNotNull(), F.when(F.col("provider_retryable"), "retry").otherwise("fail"))
        .when(F.col("repairable") & repair_spent, "fail")
        .when(F.col("repairable") | F.col("retryable_finish"), "retry")
        .otherwise("fail")
    )


def inspect_entities(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per entity: incident relations by direction and the evidence behind it, as counts.

    The lists themselves stay rows in their own tables; a hub would not fit one row.
    """
    ends = relations.select(F.col("source_entity_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        relations.select(F.col("target_entity_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    degrees = ends.groupBy("entity_id").agg(
        F.sum("o").alias("outgoing"), F.sum("i").alias("incoming")
    )
    proof = evidence.groupBy("entity_id").agg(F.count("*").alias("evidence"))
    return (
        entities.join(degrees, "entity_id", "left")
        .join(proof, "entity_id", "left")
        .fillna(0, ["outgoing", "incoming", "evidence"])
    )
