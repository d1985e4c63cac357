"""Exact order statistics of any number of values, without bringing them together.

A histogram between the smallest and the largest value of a key tells in which bin a rank
lies and how many values come before it. The bin's own smallest and largest value bound
the next histogram, until a bin holds one distinct value or few rows; those few are ranked
exactly. Each pass reads the values once and exchanges counts, at most ``BINS`` per rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.scale import cut_lineage, small_side

BINS = 1024
# A bin with at most this many rows is ranked by its distinct values.
FEW_ROWS = 50_000


def nearest_ranks(df: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``*keys, share, result``: the smallest value with at least ``share`` of the values
    at or below it. Null values don't count; a key without values has no rows."""
    keys = list(keys)
    if any(not 0.0 <= s <= 1.0 for s in shares):
        raise ValueError("shares must be between 0 and 1")
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    listed = F.array(*[F.lit(float(s)) for s in shares])
    open_ranks = cut_lineage(
        ends.withColumn("share", F.explode(listed)).select(
            *keys, "share", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)).alias("rank"), "lo", "hi", "n"
        )
    )
    done = None
    while True:
        exact = open_ranks.where("lo = hi").select(*keys, "share", F.col("lo").alias("result"))
        done = exact if done is None else done.unionByName(exact)
        few = open_ranks.where((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW_ROWS))
        done = done.unionByName(_ranked(rows, few, keys))
        open_ranks = open_ranks.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW_ROWS))
        if open_ranks.isEmpty():
            return cut_lineage(done)
        open_ranks = cut_lineage(_narrowed(rows, open_ranks, keys))


def _inside(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    # Without keys there is one row per share.
    joined = rows.join(small_side(ranks), keys) if keys else rows.join(F.broadcast(ranks))
    return joined.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The bin each rank lies in: its extremes, its rows, and the rank inside it."""
    width = F.col("hi") / 2 - F.col("lo") / 2  # halves, as the difference may overflow
    bin_of = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1))
    counted = (
        _inside(rows, ranks.drop("n"), keys)
        .groupBy(*keys, "share", "rank", bin_of.alias("bin"))
        .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    order = Window.partitionBy(*keys, "share").orderBy("bin")
    upto = counted.withColumn("upto", F.sum("n").over(order))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    return upto.where(hit).select(
        *keys, "share", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi", "n"
    )


def _ranked(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    counted = _inside(rows, ranks.drop("n"), keys).groupBy(*keys, "share", "rank", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys, "share").orderBy("value")
    upto = counted.withColumn("upto", F.sum("n").over(order))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    return upto.where(hit).select(*keys, "share", F.col("value").alias("result"))
