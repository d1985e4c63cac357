"""Nearest neighbours by inner product: one vantage-point tree per shard.

Vectors get one more component so that all have the same norm; distance in that space
falls as the inner product rises, so trees over distances answer largest-product queries.
A tree keeps, per leaf, the range of its points' distances from each vantage point above
it. By the triangle inequality a leaf whose range is further from the query's distance
than the k-th best found can't hold a better point. Multiplying that bound by a factor
above one skips more leaves at some loss of recall; factor one is exact.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.frames import stored
from seekspark.llm.vectors import packed_vectors, precision, unpacked

NEIGHBOURS = 20
SHARD_VECTORS = 4096
QUERY_BLOCK = 2048
LEAF_VECTORS = 64
PRUNING_FACTOR = 2.0
# Leaves every query scans before it prunes.
FIRST_LEAVES = 3
# Scores closer than this are compared again by the exact sum.
ROUNDING = 1e-9


@dataclass
class Tree:
    vectors: np.ndarray  # distinct vectors, leaf by leaf
    ids: list[np.ndarray]  # the smallest ids of each vector
    bounds: np.ndarray  # leaf i holds vectors[bounds[i]:bounds[i + 1]]
    points: np.ndarray  # vantage points, with their extra component
    above: np.ndarray  # per leaf the vantage points on its path (-1: none)
    low: np.ndarray
    high: np.ndarray
    norm: float  # squared norm that all vectors have with the extra component


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.maximum(norm - (vectors**2).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def build_tree(vectors: np.ndarray, ids: list, norm: float, leaf: int = LEAF_VECTORS) -> Tree:
    lifted = _lifted(vectors, norm)
    points, leaves, paths = [], [], []
    todo = [(np.arange(len(vectors)), [])]
    while todo:
        rows, path = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            paths.append(path)
            continue
        # The point farthest from the first one sees the others at varied distances.
        start = lifted[rows[0]]
        vantage = lifted[rows[np.argmax(((lifted[rows] - start) ** 2).sum(1))]]
        distance = np.sqrt(((lifted[rows] - vantage) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        points.append(vantage)
        half = len(rows) // 2
        path = [*path, len(points) - 1]
        todo += [(rows[order[half:]], path), (rows[order[:half]], path)]
    depth = max((len(p) for p in paths), default=0)
    above = np.full((len(leaves), max(depth, 1)), -1)
    low, high = np.zeros(above.shape), np.full(above.shape, np.inf)
    for i, (rows, path) in enumerate(zip(leaves, paths)):
        for j, point in enumerate(path):
            distance = np.sqrt(((lifted[rows] - points[point]) ** 2).sum(1))
            above[i, j], low[i, j], high[i, j] = point, distance.min(), distance.max()
    order = np.concatenate(leaves)
    return Tree(
        vectors[order], [ids[i] for i in order], np.concatenate([[0], np.cumsum([len(x) for x in leaves])]),
        np.array(points).reshape(len(points), lifted.shape[1]), above, low, high, norm,
    )


def search_tree(tree: Tree, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs: at least each query's ``k`` best of the leaves not pruned."""
    count, total = len(queries), len(tree.vectors)
    leaves = len(tree.bounds) - 1
    norms = (queries**2).sum(1)
    bound = np.zeros((count, leaves))
    if len(tree.points):
        square = norms[:, None] + tree.norm - 2 * queries @ tree.points[:, :-1].T
        distance = np.sqrt(np.maximum(square, 0))
        for j in range(tree.above.shape[1]):
            seen = np.flatnonzero(tree.above[:, j] >= 0)
            d = distance[:, tree.above[seen, j]]
            outside = np.maximum(tree.low[seen, j] - d, d - tree.high[seen, j])
            bound[:, seen] = np.maximum(bound[:, seen], outside)
    scores = np.full((count, total), -np.inf)
    done = np.zeros((count, leaves), bool)
    first = np.argsort(bound, axis=1, kind="stable")[:, :FIRST_LEAVES]
    np.put_along_axis(done, first, True, axis=1)

    def scan(leaf: int, rows: np.ndarray) -> None:
        a, b = tree.bounds[leaf], tree.bounds[leaf + 1]
        if len(rows):
            scores[rows, a:b] = queries[rows] @ tree.vectors[a:b].T

    for leaf in range(leaves):
        scan(leaf, np.flatnonzero(done[:, leaf]))
    take = min(k, total)

    def kth() -> np.ndarray:
        return np.partition(scores, total - take, axis=1)[:, total - take]

    reach = np.sqrt(np.maximum(norms + tree.norm - 2 * kth(), 0))
    for leaf in np.argsort(bound.mean(0)):
        rows = np.flatnonzero(~done[:, leaf] & (factor * bound[:, leaf] <= reach + ROUNDING))
        scan(leaf, rows)
    least = kth()
    return np.nonzero(scores >= np.where(np.isfinite(least), least - ROUNDING, -np.finfo(float).max)[:, None])


def _best(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    out = []
    block = max(1, (1 << 22) // max(len(tree.vectors), 1))
    for a in range(0, len(queries), block):
        # One place more, as a query's own vector doesn't count.
        row, column = search_tree(tree, queries[a : a + block], k + 1, factor)
        row = row + a
        score = (queries[row] * tree.vectors[column]).sum(1)
        size = np.array([len(tree.ids[c]) for c in column], np.int64)
        ids = np.concatenate([tree.ids[c] for c in column]) if len(column) else np.zeros(0, np.int64)
        found = pd.DataFrame({"query_id": np.repeat(query_ids[row], size), "vec_id": ids, "score": np.repeat(score, size)})
        found = found[found["query_id"] != found["vec_id"]]
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        out.append(found.groupby("query_id").head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest_neighbours(
    rows: DataFrame, id_column: str, vector_column: str, is_query: Column,
    k: int = NEIGHBOURS, factor: float = PRUNING_FACTOR,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products found.

    Queries are the usable rows for which ``is_query`` (over ``id``) holds, candidates
    all usable rows but the query's own; see ``packed_vectors`` for what is usable.
    Scores are sums over the original vectors in double precision. Ties go to the smaller
    id. Equal vectors are indexed once with the k + 1 smallest of their ids, which is all
    that any query can return of them. With fewer candidates than ``k`` all are returned.
    """
    kind = precision(rows, vector_column)
    base = packed_vectors(rows, id_column, vector_column)
    rank = F.row_number().over(Window.partitionBy("raw").orderBy("id"))
    distinct = stored(
        base.withColumn("place", rank).where(F.col("place") <= k + 1)
        .groupBy("raw").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    total = distinct.count()
    queries = base.where(is_query)
    asked = queries.count()
    shards, blocks = -(-total // SHARD_VECTORS) or 1, -(-asked // QUERY_BLOCK) or 1
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    usable = rows.select(F.col(vector_column).cast("array<double>").alias("v")).where(
        "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    largest = usable.agg(F.max(norm)).first()[0] or 0.0

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("raw")
        ids = [np.array(x, np.int64) for x in frame["ids"]]
        tree = build_tree(unpacked(frame["raw"], kind), ids, float(largest))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(vars(tree), 5)]})

    trees = stored(
        distinct.withColumn("shard", F.pmod(F.xxhash64("raw"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(build, "shard int, tree binary")
    )
    # Every block of the stated queries meets every shard's tree.
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def answer(trees_of: pd.DataFrame, asked_of: pd.DataFrame) -> pd.DataFrame:
        if not len(trees_of) or not len(asked_of):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        tree = Tree(**pickle.loads(trees_of["tree"].iloc[0]))
        return _best(tree, asked_of["id"].to_numpy(), unpacked(asked_of["raw"], kind), k, factor)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        answer, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
