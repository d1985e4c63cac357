"""Answers restricted to delivered evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.plans.retrieval import Retrieval

INSUFFICIENT = "Insufficient evidence in the supplied retrieval context."


def deterministic_answers(retrieval: Retrieval) -> DataFrame:
    """The first delivered passage verbatim with its citation, else a refusal."""
    first = retrieval.context.where(F.col("position") == 1).select(
        "query_id", F.col("object_id").alias("citation"), "text"
    )
    none = F.array().cast("array<string>")
    return retrieval.questions.select("query_id").join(first, "query_id", "left").select(
        "query_id",
        F.coalesce("text", F.lit(INSUFFICIENT)).alias("answer"),
        F.when(F.col("citation").isNull(), none).otherwise(F.array("citation")).alias("citations"),
        F.col("citation").isNull().alias("insufficient_evidence"),
    )


def citation_violations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Citations outside the delivered evidence; any row makes an answer invalid."""
    cited = answers.select("query_id", F.explode("citations").alias("object_id"))
    return cited.join(context.select("query_id", "object_id"), ["query_id", "object_id"], "left_anti")


def checked_answers(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Answers of an injected client; a citation that was not delivered is an error."""
    bad = citation_violations(answers, context).groupBy("query_id").agg(F.count("*").alias("bad"))
    joined = answers.join(bad, "query_id", "left")
    guard = F.when(
        F.col("bad") > 0, F.raise_error(F.lit("citation is not in the retrieval allowlist"))
    ).otherwise(F.col("answer"))
    return joined.withColumn("answer", guard).drop("bad")
