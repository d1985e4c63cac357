"""Exact dense top-k: block matrix products inside tasks, k rows per query between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.operators.fusion import top_k

# Queries are shipped to every executor only below this size (values, not rows).
MAX_QUERY_VALUES = 8_000_000
BLOCK_ROWS = 20_000
# Scores of one matrix product inside a task.
MAX_PRODUCT_VALUES = 2_000_000


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query by rounded score, then id; ties are never cut blindly."""
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor - 1e-11)
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -np.round(scores, 12)))[:k]
    return ids[order], scores[order]


def best_positions(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; of equal ones the earlier are taken."""
    return _best(np.arange(len(scores)), scores, k)[0]


def _products(queries: np.ndarray, block: np.ndarray, limit: int = MAX_PRODUCT_VALUES) -> Iterator[np.ndarray]:
    """The scores of each query, by matrix products of at most ``limit`` values."""
    step = max(limit // max(len(block), 1), 1)
    for begin in range(0, len(queries), step):
        yield from queries[begin : begin + step] @ block.T


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != len(column) * dimensions:
        raise ValueError("embedding dimensions differ")
    return flat.reshape(len(column), dimensions)


def collect_queries(queries: DataFrame, dimensions: int) -> pd.DataFrame | None:
    """The query vectors when they are small enough to ship, else None."""
    rows = max(MAX_QUERY_VALUES // dimensions, 1)
    head = queries.select("query_id", "embedding").limit(rows + 1).toPandas()
    return head if len(head) <= rows else None


def dense_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    dimensions: int,
    collected: pd.DataFrame | None = None,
) -> DataFrame:
    """Rank ``vectors(object_id, embedding)`` by cosine for ``queries(query_id, embedding)``.

    Output ``query_id, object_id, score, rank``. No pair of rows crosses a shuffle:
    each task keeps k candidates per query, and only those are exchanged. A query
    set too large to ship is cut into hash blocks and joined block by block. Callers
    that rank several tables pass the queries they ``collected`` once.
    """
    head = collected if collected is not None else collect_queries(queries, dimensions)
    if head is not None:
        local = _local_candidates(vectors, head, k, dimensions)
    else:
        local = _block_candidates(vectors, queries, k, dimensions)
    ranked = top_k(local, k, ["query_id"])
    return ranked.select("query_id", "object_id", "score", "rank")


def _candidate_schema(queries_type: T.DataType, objects_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries_type),
            T.StructField("object_id", objects_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _local_candidates(
    vectors: DataFrame, queries: pd.DataFrame, k: int, dimensions: int
) -> DataFrame:
    spark = vectors.sparkSession
    names = queries["query_id"].to_numpy()
    values = np.array(queries["embedding"].tolist(), dtype=float).reshape(-1, dimensions)
    shipped = spark.sparkContext.broadcast((names, _unit_rows(values)))
    query_type = T.LongType() if queries["query_id"].dtype.kind in "iu" else T.StringType()
    schema = _candidate_schema(query_type, vectors.schema["object_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shipped.value
        best: list = [None] * len(query_ids)
        for batch in batches:
            ids = batch.column("object_id").to_numpy(zero_copy_only=False)
            block = _unit_rows(_matrix(batch.column("embedding"), dimensions))
            for q, known in enumerate(_products(query_matrix, block)):
                known_ids = ids
                if best[q] is not None:
                    known_ids = np.concatenate([best[q][0], known_ids])
                    known = np.concatenate([best[q][1], known])
                best[q] = _best(known_ids, known, k)
        found = [(q, pair) for q, pair in zip(query_ids, best) if pair is not None]
        if found:
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(
                            np.array([q for q, _ in found], dtype=names.dtype),
                            [len(pair[0]) for _, pair in found],
                        ),
                        "object_id": np.concatenate([pair[0] for _, pair in found]),
                        "score": np.concatenate([pair[1] for _, pair in found]),
                    }
                ),
                preserve_index=False,
            )

    return vectors.select("object_id", "embedding").mapInArrow(score, schema)


def _block_candidates(
    vectors: DataFrame, queries: DataFrame, k: int, dimensions: int
) -> DataFrame:
    """Fallback beyond the shipping bound: grid of query blocks x vector blocks."""
    n_vectors = max(-(-vectors.count() // BLOCK_ROWS), 1)
    n_queries = max(-(-queries.count() // BLOCK_ROWS), 1)

    def grid(df: DataFrame, key: str, own: int, other: int, own_name: str, other_name: str):
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select(
            key,
            "embedding",
            F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(own_name),
            copies.alias(other_name),
        )

    left = grid(vectors, "object_id", n_vectors, n_queries, "v_block", "q_block")
    right = grid(queries, "query_id", n_queries, n_vectors, "q_block", "v_block")
    schema = _candidate_schema(
        queries.schema["query_id"].dataType, vectors.schema["object_id"].dataType
    )

    def score(objects: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if objects.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "object_id": [], "score": []})
        block = _unit_rows(np.array(objects["embedding"].tolist(), dtype=float))
        ids = objects["object_id"].to_numpy()
        parts = []
        for query_id, vector in zip(asked["query_id"], asked["embedding"]):
            unit = _unit_rows(np.asarray(vector, dtype=float)[None, :])[0]
            found, values = _best(ids, block @ unit, k)
            parts.append(
                pd.DataFrame({"query_id": query_id, "object_id": found, "score": values})
            )
        return pd.concat(parts)

    keys = ["v_block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)
