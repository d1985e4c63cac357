"""Best cosines of a case by blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seekspark.functions.vectors import cosine
from seekspark.operators import metrics

VECTORS = "k int, reference_id long, embedding array<double>"


def _pairwise(references, retrieved):
    other = retrieved.select("k", F.col("embedding").alias("candidate"))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("candidate"))))
    best = references.join(other, "k", "left").groupBy("k", "reference_id").agg(
        F.coalesce(F.max(F.when(F.col("candidate").isNotNull(), value)), F.lit(-1.0)).alias("best")
    )
    return best.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("best"), 9).alias("mean"))


@pytest.mark.parametrize("rows", [1, 3, 2048])
def test_blocks_equal_the_pairwise_join(spark, monkeypatch, rows):
    monkeypatch.setattr(metrics, "COSINE_ROWS", rows)
    monkeypatch.setattr(metrics, "PRODUCT_VALUES", 4)
    made = random.Random(1)
    some = [(i % 4 or None, 100 + i, [made.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    odd = [[0.0, 0.0, 0.0], [1.0, None, 2.0], [math.nan, 1.0, 0.0], [math.inf, 1.0, 0.0], None]
    some += [(k, 200 + 10 * k + i, v) for k in (1, 5) for i, v in enumerate(odd)] + some[:5] + [(2, None, [1.0, 2.0, 3.0])]
    references = spark.createDataFrame(some, VECTORS)
    for left in ([], odd):
        given = [(k, 0, [made.gauss(0, 1) for _ in range(3)]) for k in (1, 1, 2, 2, 2, 6, None)] + [(3, 0, v) for v in left]
        retrieved = spark.createDataFrame(given, VECTORS).drop("reference_id")
        found = metrics.semantic_scores(references, retrieved, 0.5, ["k"])
        found = {(r["k"], r["reference_count"], round(r["mean_max_similarity"], 9)) for r in found.collect()}
        assert found == {tuple(r) for r in _pairwise(references, retrieved).collect()}


def test_no_pair_of_vectors_is_a_row(spark):
    references = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(30)], VECTORS)
    found = metrics.semantic_scores(references, references.drop("reference_id"), 0.5, ["k"])
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_unequal_lengths_are_an_error(spark):
    references = spark.createDataFrame([(1, 1, [1.0])], VECTORS)
    retrieved = spark.createDataFrame([(1, 1, [1.0, 2.0])], VECTORS).drop("reference_id")
    with pytest.raises(Exception, match="dimensions differ"):
        metrics.semantic_scores(references, retrieved, 0.5, ["k"]).collect()
