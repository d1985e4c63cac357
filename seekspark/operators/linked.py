"""The best chunks behind scored objects, without a row per question and chunk.

A chunk scores, per question and component, the maximum of the objects that it is linked to.
Links lie sorted by chunk; each task takes these maxima in blocks, for all questions, and
returns bounds or its best chunks. Scored objects are few and shipped; links are exchanged
once, by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.operators.dense import best_positions
from seekspark.operators.fusion import flat_bounds, top_k
from seekspark.scale import cut_lineage, fits, small_side

# Links of one block, about; a block ends with a chunk.
BLOCK_LINKS = 1 << 16

# Per question, its name and per component the numbers and scores of its objects.
Scored = list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]]


@dataclass
class LinkedScores:
    """``links``: object_id, number, sorted by chunk; ``scored``: query_id, component,
    number, score; ``bounds``: query_id, component, lo, hi over all linked chunks."""

    links: DataFrame
    scored: DataFrame
    bounds: DataFrame
    shipped: object
    names: list[str]

    def best(self, weights: Mapping[str, float], k: int) -> DataFrame:
        """``query_id, object_id`` of the ``k`` best chunks by the sum of their weighted
        components, each scaled to 0..1 by its bounds."""
        found = {(r["query_id"], r["component"]): (r["lo"], r["hi"]) for r in self.bounds.collect()}
        names, shipped, kind = self.names, self.shipped, self.links.schema["object_id"].dataType

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scored, objects = shipped.value
            held: list = [None] * len(scored)
            for chunks, starts, numbers in _blocks(batches):
                for q, (question, parts) in enumerate(scored):
                    total, any_part = np.zeros(len(chunks)), np.zeros(len(chunks), bool)
                    for name, (codes, values) in zip(names, parts):
                        if (question, name) not in found:
                            continue
                        part = _maxima(codes, values, objects, starts, numbers)
                        known = part > -np.inf
                        lo, hi = found[question, name]
                        part = np.ones(len(part)) if flat_bounds(lo, hi) else (part - lo) / (hi - lo)
                        total += np.where(known, part * weights[name], 0.0)
                        any_part |= known
                    if not any_part.any():
                        continue
                    at = np.flatnonzero(any_part)
                    at = at[best_positions(total[at], k)]
                    ids, sums = chunks[at], total[at]
                    if held[q] is not None:  # earlier chunks of the task come first
                        ids, sums = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], sums])
                        keep = best_positions(sums, k)
                        ids, sums = ids[keep], sums[keep]
                    held[q] = ids, sums
            for (question, _), pair in zip(scored, held):
                if pair is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([question] * len(pair[0]), pa.string()), pa.array(pair[0].tolist(), pa.string()), pa.array(pair[1], pa.float64())],
                        names=["query_id", "object_id", "score"],
                    )

        schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("object_id", kind), T.StructField("score", T.DoubleType())])
        return top_k(self.links.mapInArrow(rank, schema), k, ["query_id"]).select("query_id", "object_id")

    def of(self, pairs: DataFrame) -> DataFrame:
        """``query_id, object_id, component, score`` of given ``query_id, object_id``."""
        asked = small_side(pairs.select("query_id", F.col("object_id").alias("asked_id")))
        met = self.links.join(asked, F.col("object_id").eqNullSafe(F.col("asked_id"))).drop("asked_id")
        return met.join(small_side(self.scored), ["query_id", "number"]).groupBy("query_id", "object_id", "component").agg(
            F.max("score").alias("score")
        )


def linked_scores(links: DataFrame, scored: Mapping[str, DataFrame]) -> LinkedScores | None:
    """Chunk scores of ``links(kind, object_id, chunk_id)`` for components of ``query_id,
    kind, object_id, score``; None when these are too many to ship."""
    frames = [df.select("query_id", F.lit(name).alias("component"), "kind", "object_id", "score") for name, df in scored.items()]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    key = ["query_id", "component", "kind", "object_id"]
    whole = cut_lineage(whole.where("query_id IS NOT NULL AND object_id IS NOT NULL").groupBy(*key).agg(F.max("score").alias("score")))
    if not fits(whole):
        return None
    spark, names = links.sparkSession, list(scored)
    rows = whole.toPandas()
    objects = rows[["kind", "object_id"]].drop_duplicates().reset_index(drop=True)
    numbered = spark.createDataFrame(
        [(kind, name, n) for n, (kind, name) in enumerate(objects.itertuples(index=False, name=None))],
        "kind string, object_id string, number int",
    )
    objects["number"] = np.arange(len(objects), dtype=np.int32)
    rows = rows.merge(objects, on=["kind", "object_id"])
    none = np.zeros(0, np.int32), np.zeros(0)
    parts: dict[str, dict[str, tuple]] = {q: {} for q in rows["query_id"].unique()}
    for (question, name), own in rows.groupby(["query_id", "component"]):
        parts[question][name] = own["number"].to_numpy(np.int32), own["score"].to_numpy(float)
    asked: Scored = [(q, [own.get(name, none) for name in names]) for q, own in parts.items()]
    shipped = spark.sparkContext.broadcast((asked, len(objects)))
    # At most as many objects as scored rows, which are few.
    known = links.join(F.broadcast(numbered), ["kind", "object_id"]).select(F.col("chunk_id").alias("object_id"), "number")
    stored = cut_lineage(known.repartition("object_id").sortWithinPartitions("object_id"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, count = shipped.value
        low, high = np.full((len(asked), len(names)), np.inf), np.full((len(asked), len(names)), -np.inf)
        for _, starts, numbers in _blocks(batches):
            for q, (_, own) in enumerate(asked):
                for c, (codes, values) in enumerate(own):
                    part = _maxima(codes, values, count, starts, numbers)
                    high[q, c] = max(high[q, c], part.max())
                    low[q, c] = min(low[q, c], np.where(part > -np.inf, part, np.inf).min())
        q, c = np.nonzero(high > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array([asked[i][0] for i in q], pa.string()), pa.array([names[i] for i in c], pa.string()), pa.array(low[q, c]), pa.array(high[q, c])],
            names=["query_id", "component", "lo", "hi"],
        )

    bounds = stored.mapInArrow(bound, "query_id string, component string, lo double, hi double")
    bounds = cut_lineage(bounds.groupBy("query_id", "component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    coded = whole.join(F.broadcast(numbered), ["kind", "object_id"]).select("query_id", "component", "number", "score")
    return LinkedScores(stored, coded, bounds, shipped, names)


def _maxima(codes: np.ndarray, values: np.ndarray, objects: int, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The best score of each chunk, -inf for chunks without a scored object."""
    score = np.full(objects, -np.inf)
    score[codes] = values
    return np.maximum.reduceat(score[numbers], starts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct chunks in order, the first link of each, and the numbers of all links; only
    the last chunk of a block may go on and is carried over."""
    ids: list[np.ndarray] = []
    numbers: list[np.ndarray] = []

    def cut(whole: bool):
        chunk, number = np.concatenate(ids), np.concatenate(numbers)
        starts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1])
        end = len(chunk) if whole else int(starts[-1])
        ids[:], numbers[:] = [chunk[end:]], [number[end:]]
        starts = starts[starts < end]
        return (chunk[starts], starts, number[:end]) if len(starts) else None

    for batch in batches:
        ids.append(batch.column("object_id").to_numpy(zero_copy_only=False))
        numbers.append(batch.column("number").to_numpy(zero_copy_only=False))
        if sum(map(len, ids)) >= BLOCK_LINKS:
            block = cut(False)
            if block:
                yield block
    if sum(map(len, ids)):
        yield cut(True)
