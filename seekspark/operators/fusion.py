"""Ranking, normalisation, fusion and budgeted selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.scale import small_side

# Scores are compared after this rounding, so summation order never decides a tie.
SCORE_DIGITS = 12
# Chunks of a path that count, in path limits.
PATH_DEPTH = 2


def score_order(score: str = "score", tie: str = "object_id") -> list[Column]:
    return [F.round(F.col(score), SCORE_DIGITS).desc(), F.col(tie).asc()]


def top_k(
    df: DataFrame, k: int, by: Sequence[str], score: str = "score", tie: str = "object_id"
) -> DataFrame:
    """Best k rows per key with their rank; each map task forwards at most k per key."""
    if k < 0:
        raise ValueError("limit must not be negative")
    window = Window.partitionBy(*by).orderBy(*score_order(score, tie))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def flat_bounds(lo: float, hi: float) -> bool:
    """True when all scores between ``lo`` and ``hi`` count as equal."""
    return abs(hi - lo) <= 1e-9 * max(abs(hi), abs(lo))


def min_max(
    df: DataFrame, by: Sequence[str], score: str = "score", bounds: DataFrame | None = None
) -> DataFrame:
    """Add ``normalized``: scores scaled to 0..1 per key, all 1 when they are equal.

    The bounds come from a partial aggregate, not from a window: a key holding most
    of the rows is reduced map-side and never gathered in one task. When ``df`` holds only
    some rows of a key, ``bounds(*by, lo, hi)`` are those over all of them.
    """
    if bounds is None:
        bounds = df.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    flat = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    scaled = F.when(flat, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo))
    joined = df.join(small_side(bounds), list(by))
    return joined.withColumn("normalized", scaled).drop("lo", "hi")


def weighted_fusion(
    route_scores: DataFrame, weights: Mapping[str, float], id_column: str = "object_id"
) -> DataFrame:
    """Additive fusion of ``query_id, route, object_id, score``.

    Gives one column per positively weighted route and ``score``, their sum in
    route-name order. Routes without weight are dropped before normalising.
    """
    active = {route: weights[route] for route in sorted(weights) if weights[route] > 0.0}
    kept = route_scores.where(F.col("route").isin(list(active)))
    normal = min_max(kept, ["query_id", "route"])
    parts = [
        F.max(F.when(F.col("route") == route, F.col("normalized") * weight)).alias(route)
        for route, weight in active.items()
    ]
    wide = normal.groupBy("query_id", id_column).agg(*parts)
    total = F.lit(0.0)
    for route in active:
        total = total + F.coalesce(F.col(route), F.lit(0.0))
    return wide.withColumn("score", total)


def weighted_average_fusion(
    scorer_scores: DataFrame, weights: Mapping[str, float], id_column: str = "object_id"
) -> DataFrame:
    """Weighted average of ``query_id, scorer, object_id, score``.

    A scorer without rows for a query, or without weight, leaves the denominator of
    that query. Gives raw, normalized and weighted values per scorer, and ``score``.
    """
    active = {name: weights[name] for name in sorted(weights) if weights[name] > 0.0}
    kept = scorer_scores.where(F.col("scorer").isin(list(active)))
    present = kept.groupBy("query_id").agg(
        *[F.bool_or(F.col("scorer") == name).alias(f"has_{name}") for name in active]
    )
    denominator = F.lit(0.0)
    for name, weight in active.items():
        denominator = denominator + F.when(F.col(f"has_{name}"), weight).otherwise(0.0)
    shares = present.select(
        "query_id",
        *[(F.lit(weight) / denominator).alias(f"share_{name}") for name, weight in active.items()],
    )
    normal = min_max(kept, ["query_id", "scorer"])

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("scorer") == name, F.col(value)))

    wide = normal.groupBy("query_id", id_column).agg(
        *[of(name, "score").alias(f"{name}_raw") for name in active],
        *[of(name, "normalized").alias(f"{name}_normalized") for name in active],
    )
    joined = wide.join(small_side(shares), "query_id")
    total = F.lit(0.0)
    for name in active:
        weighted = F.col(f"{name}_normalized") * F.col(f"share_{name}")
        joined = joined.withColumn(f"{name}_weighted", weighted)
        total = total + F.coalesce(F.col(f"{name}_weighted"), F.lit(0.0))
    return joined.withColumn("score", total).drop(*[f"share_{name}" for name in active])


def budget_fold(items: Column, tokens: str, budget: Column | int) -> Column:
    """Walk an array of structs in order and keep each item that still fits.

    An item that does not fit is skipped, and later smaller ones may still be kept;
    a running sum would stop at the first overflow.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    empty = F.filter(items, lambda _: F.lit(False))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + item[tokens] <= limit
        return F.struct(
            F.when(fits, state["used"] + item[tokens]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(item)))
            .otherwise(state["kept"])
            .alias("kept"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept"))
    return F.aggregate(items, start, step, lambda state: state["kept"])


def select_within_budget(
    ranked: DataFrame, budget: int, by: str = "query_id", tokens: str = "tokens"
) -> DataFrame:
    """Budget selection over rows ``by, object_id, rank, tokens`` with bounded groups.

    ``ranked`` must already be a top-k, so the array per key has at most k items.
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    arrays = ranked.groupBy(by).agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "object_id", F.col(tokens).cast("long").alias("tokens"))
            )
        ).alias("items")
    )
    return arrays.select(
        by, F.posexplode(budget_fold(F.col("items"), "tokens", budget)).alias("at", "item")
    ).select(
        by,
        F.col("item.object_id").alias("object_id"),
        F.col("item.tokens").alias("tokens"),
        (F.col("at") + 1).alias("position"),
    )


def top_k_with_anchors(scores: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Keep up to k anchors, fill by score, and rank the survivors by score again.

    ``anchors(query_id, object_id, anchor_rank)`` is bounded by the sub-questions.
    """
    marked = scores.join(
        small_side(anchors.select("query_id", "object_id", "anchor_rank")),
        ["query_id", "object_id"],
        "left",
    )
    window = Window.partitionBy("query_id").orderBy(
        F.col("anchor_rank").asc_nulls_last(), *score_order()
    )
    kept = marked.withColumn("slot", F.row_number().over(window)).where(F.col("slot") <= k)
    final = Window.partitionBy("query_id").orderBy(*score_order())
    return kept.drop("slot").withColumn("rank", F.row_number().over(final))


def best_path_per_key(paths: DataFrame) -> DataFrame:
    """One path per (query, relation ids): best score, the earlier arrival on a tie."""
    best = F.max_by(
        F.struct("node_ids", "relation_ids", "source_chunk_ids", "score", "arrival"),
        F.struct(F.round("score", SCORE_DIGITS), -F.col("arrival")),
    )
    key = F.when(F.size("relation_ids") > 0, F.col("relation_ids")).otherwise(
        F.col("node_ids")
    )
    return (
        paths.groupBy("query_id", key.alias("path_key"))
        .agg(best.alias("path"))
        .select("query_id", "path.*")
    )


def inject_paths(paths: DataFrame, path_chunks: DataFrame, path_limit: int) -> DataFrame:
    """Chunk scores from multi-hop paths: the first path in order wins a chunk.

    ``paths(query_id, node_ids, relation_ids, score)`` and ``path_chunks(query_id,
    relation_ids, object_id)``. At most ``path_limit`` chunks per query. Every path
    that counts adds a chunk, so the chunk limit also bounds the paths.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", SCORE_DIGITS).desc(), "node_ids", "relation_ids"
    )
    eligible = paths.where((F.size("relation_ids") >= 2) & (F.col("score") > 0)).withColumn(
        "path_rank", F.row_number().over(order)
    )
    # The first path_limit chunks of a path may all be taken by earlier paths, which
    # take at most path_limit; twice that many are enough for an exact result.
    per_path = Window.partitionBy("query_id", "relation_ids").orderBy("object_id")
    near = path_chunks.withColumn("place", F.row_number().over(per_path)).where(
        F.col("place") <= PATH_DEPTH * path_limit
    )
    first = (
        near.join(eligible, ["query_id", "relation_ids"])
        .groupBy("query_id", "object_id")
        .agg(F.min(F.struct("path_rank", "score")).alias("best"))
        .select("query_id", "object_id", "best.path_rank", "best.score")
    )
    taken = Window.partitionBy("query_id").orderBy("path_rank", "object_id")
    return (
        first.withColumn("place", F.row_number().over(taken))
        .where(F.col("place") <= path_limit)
        .select("query_id", "object_id", "score")
    )


def document_anchors(candidates: DataFrame, limit: int) -> DataFrame:
    """One anchor per sub-question whose document no earlier anchor covers.

    ``candidates(query_id, part, part_rank, object_id, document_id, score)`` hold the
    top of each sub-ranking, so the array folded per query stays below 3 x depth.
    """
    packed = candidates.groupBy("query_id", "part").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.round("score", SCORE_DIGITS)).alias("negative"),
                    "part_rank", "object_id", "document_id",
                )
            )
        ).alias("choices")
    )
    parts = packed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "choices"))).alias("parts")
    )
    none = F.array().cast("array<string>")

    def step(state: Column, part: Column) -> Column:
        free = F.filter(
            part["choices"], lambda c: ~F.array_contains(state["documents"], c["document_id"])
        )
        pick = F.try_element_at(free, F.lit(1))
        take = pick.isNotNull() & (F.size(state["ids"]) < limit)
        return F.struct(
            F.concat(state["ids"], F.when(take, F.array(pick["object_id"])).otherwise(none)).alias("ids"),
            F.concat(
                state["documents"], F.when(take, F.array(pick["document_id"])).otherwise(none)
            ).alias("documents"),
        )

    start = F.struct(none.alias("ids"), none.alias("documents"))
    folded = parts.select("query_id", F.aggregate("parts", start, step)["ids"].alias("ids"))
    return folded.select(
        "query_id", F.posexplode("ids").alias("anchor_rank", "object_id")
    )
