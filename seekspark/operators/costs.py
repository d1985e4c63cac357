"""Token usage roll-up and exact decimal cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.scale import small_side

PER_MILLION = 1_000_000


def usage_by_model(records: DataFrame, *keys: str) -> DataFrame:
    """Usage per key, operation and model; the cache split only if every row has one."""
    complete = F.bool_and("cache_breakdown_complete")
    return records.groupBy(*keys, "operation", "model").agg(
        F.sum("calls").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.when(complete, F.sum(F.coalesce("cache_hit_tokens", F.lit(0)))).alias("cache_hit_tokens"),
        F.when(complete, F.sum(F.coalesce("cache_miss_tokens", F.lit(0)))).alias("cache_miss_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        complete.alias("cache_breakdown_complete"),
    )


def with_breakdown(records: DataFrame) -> DataFrame:
    """Mark rows whose cache hits and misses add up; hide partial splits otherwise."""
    hit, miss = F.col("cache_hit_tokens"), F.col("cache_miss_tokens")
    empty = (F.col("prompt_tokens") == 0) & hit.isNull() & miss.isNull()
    complete = empty | F.coalesce(hit + miss == F.col("prompt_tokens"), F.lit(False))
    return records.select(
        *[c for c in records.columns if c not in ("cache_hit_tokens", "cache_miss_tokens")],
        F.when(complete, F.coalesce(hit, F.lit(0))).alias("cache_hit_tokens"),
        F.when(complete, F.coalesce(miss, F.lit(0))).alias("cache_miss_tokens"),
        complete.alias("cache_breakdown_complete"),
    )


def estimate(records: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """Cost per key, exact in decimals; unknown when a model or a cache split is missing.

    ``prices(model, hit_price, miss_price, output_price)`` are decimals per million tokens.
    """
    usage = usage_by_model(records, *keys).withColumn("price_key", F.lower("model"))
    priced = usage.join(
        small_side(prices.withColumnRenamed("model", "price_key")), "price_key", "left"
    )
    known = F.col("output_price").isNotNull() & F.col("cache_breakdown_complete")

    def charge(tokens: str, price: str):
        return F.col(tokens).cast("decimal(20,0)") * F.col(price)

    amount = (
        charge("cache_hit_tokens", "hit_price")
        + charge("cache_miss_tokens", "miss_price")
        + charge("completion_tokens", "output_price")
    )
    return priced.groupBy(*keys).agg(
        F.when(F.bool_and(known), F.sum(amount).cast("double") / PER_MILLION).alias("cost"),
        F.when(F.bool_and(known), "estimated").otherwise("unknown").alias("status"),
    )


def latest_snapshot_cost(traces: DataFrame, *keys: str, order: str) -> DataFrame:
    """Cost of the last cumulative snapshot; unknown if any trace lacks one."""
    missing = F.count_if(F.col("cost").isNull())
    return traces.groupBy(*keys).agg(
        F.when(missing == 0, F.max_by("cost", order)).alias("cost"),
        missing.alias("missing"),
        F.count("*").alias("observations"),
    )
