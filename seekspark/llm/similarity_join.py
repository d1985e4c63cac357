"""Cosine self-join by pigeonhole over rotated subspaces.

On unit vectors cosine >= t means squared distance <= 2 - 2t. A random rotation spreads
the distance evenly; the rotated vectors are cut into low-dimensional blocks, each with a
budget in proportion to its dimensions. A close pair keeps within the budget of one block
at least, so range joins of the blocks find every pair, and each pair belongs to the first
block whose budget it keeps.

The range join of a block deals vectors into strips of its first coordinate; a vector is
also sent, as a guest, to higher strips that start within the budget's radius. Inside a
strip, tiles that are small in all coordinates of the block are compared where their boxes
are near enough. Strips verify whole vectors exactly and return, per vector, its number of
links and one link to its local component; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.frames import stored
from seekspark.llm.vectors import packed_vectors, precision, unpacked
from seekspark.operators.graph import connected_components

COSINE = 0.95
BLOCK_DIMENSIONS = 8
STRIP_VECTORS = 8192
GUEST_VECTORS = 32768
TILE = 256
ROUNDING = 1e-9
# Far above the error of a squared distance of unit vectors in single precision, which only
# picks pairs for the exact test.
SINGLE_ROUNDING = 1e-5
SEED = 20_240


def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    basis, upper = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimensions, dimensions)))
    return basis * np.sign(np.diag(upper))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _blocks(dimensions: int) -> list[slice]:
    edges = [*range(0, dimensions, BLOCK_DIMENSIONS), dimensions]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _budgets(dimensions: int, cosine: float) -> np.ndarray:
    whole = 2 - 2 * cosine
    return np.array([whole * (b.stop - b.start) / dimensions for b in _blocks(dimensions)])


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of all pairs; a component's parent is its smallest member."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _tiles(points: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """``members`` in tiles, halved at the median of the widest coordinate until small enough."""
    waiting, tiles = [members] if len(members) else [], []
    while waiting:
        part = waiting.pop()
        if len(part) <= TILE:
            tiles.append(part)
            continue
        values = points[part]
        along = values[:, np.argmax(np.ptp(values, axis=0))]
        order = np.argpartition(along, len(part) // 2)
        waiting += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return tiles


def _distance_factors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is the squared distance of each two points, in single precision."""
    square, one = (points**2).sum(1, keepdims=True), np.ones((len(points), 1))
    return (
        np.hstack([-2 * points, square, one]).astype(np.float32),
        np.hstack([points, one, square]).astype(np.float32),
    )


def strip_links(
    vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, home: np.ndarray,
    block: int, cosine: float, pair_homes: bool,
) -> pd.DataFrame:
    """id, links, root of the members of one strip that link with another.

    Pairs have a home member and a guest or, if ``pair_homes`` says so, two home members.
    Members are cut into tiles that are small in all coordinates of the block, and only
    tiles whose boxes are within the budget of each other are compared.
    """
    unit = _unit(vectors)
    turned = unit @ rotation(vectors.shape[1])
    parts, budgets = _blocks(vectors.shape[1]), _budgets(vectors.shape[1], cosine)
    tiles = _tiles(turned[:, parts[block]], np.flatnonzero(~home))
    guests = len(tiles)
    tiles += _tiles(turned[:, parts[block]], np.flatnonzero(home))
    order = np.concatenate(tiles) if tiles else np.zeros(0, np.int64)
    unit, turned, ids, copies = unit[order], turned[order], ids[order], copies[order]
    own = np.ascontiguousarray(turned[:, parts[block]])
    begins = np.cumsum([0, *map(len, tiles)])
    low = np.array([own[a:b].min(0) for a, b in zip(begins[:-1], begins[1:])])
    high = np.array([own[a:b].max(0) for a, b in zip(begins[:-1], begins[1:])])
    left, right = _distance_factors(own)
    left_first, right_first = _distance_factors(turned[:, parts[0]])
    budget = budgets[block]
    links = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))
    for t in range(guests, len(tiles)):
        tile = np.arange(begins[t], begins[t + 1])
        # Tiles, then their members, that are nearer than the budget to the box of this tile.
        most = t + 1 if pair_homes else guests
        gap = np.maximum(np.maximum(low[t] - high[:most], low[:most] - high[t]), 0)
        close = np.flatnonzero((gap**2).sum(1) <= budget + 3 * ROUNDING)
        if not len(close):
            continue
        others = np.concatenate([np.arange(begins[c], begins[c + 1]) for c in close])
        gap = np.maximum(np.maximum(low[t] - own[others], own[others] - high[t]), 0)
        others = others[(gap**2).sum(1) <= budget + 3 * ROUNDING]
        if not len(others):
            continue
        near = left[tile] @ right[others].T <= budget + SINGLE_ROUNDING
        if others[-1] >= tile[0]:
            near &= others[None, :] < tile[:, None]
        if block and near.sum() > 4 * len(tile):
            # Pairs that surely belong to the first block needn't be looked at one by one.
            near &= left_first[tile] @ right_first[others].T > budgets[0] - SINGLE_ROUNDING
        i, j = np.nonzero(near)
        i, j = tile[i], others[j]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            good = (unit[p] * unit[q]).sum(1) >= cosine
            p, q = p[good], q[good]
            gap = (turned[p] - turned[q]) ** 2
            # One test decides in every block; its margin is far above rounding errors, so a
            # pair at the limit keeps a budget, and blocks agree on which is the first.
            mine = gap[:, parts[block]].sum(1) <= budget + ROUNDING
            for b in range(block):
                mine &= gap[:, parts[b]].sum(1) > budgets[b] + ROUNDING
            p, q = p[mine], q[mine]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            _union(parent, p, q)
    some = links > 0
    low_id = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low_id, parent, ids)
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": low_id[parent[some]]})


def linked_vectors(rows: DataFrame, id_column: str, vector_column: str, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per id of ``rows``.

    n_links counts other usable vectors (see ``packed_vectors``) with a cosine of at least
    ``cosine``, in double precision on the original vectors; component_id is the smallest
    id reachable by links. Equal vectors are compared once, with their number as weight.
    Unusable vectors have no link and are their own component; rows with a null id come
    back with a null component, kept. Ids that repeat count once.
    """
    base = packed_vectors(rows, id_column, vector_column)
    kind = precision(rows, vector_column)
    distinct = stored(base.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    total = distinct.count()
    strips = max(1, -(-total // STRIP_VECTORS))
    sample = distinct.select("raw").first()
    dimensions = len(sample["raw"]) // np.dtype(kind).itemsize if sample else BLOCK_DIMENSIONS
    parts, budgets = _blocks(dimensions), _budgets(dimensions, cosine)
    spin = rotation(dimensions)
    firsts = [p.start for p in parts]

    def coordinates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            along = (_unit(unpacked(frame["raw"], kind)) @ spin)[:, firsts] if len(frame) else np.zeros((0, len(firsts)))
            yield pd.DataFrame({"block": np.tile(np.arange(len(firsts)), len(frame)), "along": along.ravel()})

    # Strip edges are quantiles: a few numbers per block and strip.
    edges = {b: np.zeros(0) for b in range(len(parts))}
    if strips > 1:
        cuts = [i / strips for i in range(1, strips)]
        for row in (
            distinct.select("raw").mapInPandas(coordinates, "block int, along double")
            .groupBy("block").agg(F.percentile_approx("along", cuts, 10_000).alias("cuts")).collect()
        ):
            edges[row["block"]] = np.array(row["cuts"])
    chunks = max(1, -(-total // (4 * GUEST_VECTORS)))

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            along = (_unit(unpacked(frame["raw"], kind)) @ spin)[:, firsts]
            chunk = frame["id"].to_numpy() % chunks
            for b in range(len(parts)):
                strip = np.searchsorted(edges[b], along[:, b], "right")
                last = np.searchsorted(edges[b], along[:, b] + np.sqrt(budgets[b] + 3 * ROUNDING), "right")
                guest = np.repeat(np.arange(len(frame)), last - strip)
                to = strip[guest] + 1 + np.arange(len(guest)) - np.repeat(np.cumsum(last - strip) - (last - strip), last - strip)
                out = frame.iloc[guest].assign(block=b, strip=to, chunk=chunk[guest], home=False)
                yield out
                for c in range(chunks):
                    yield frame.assign(block=b, strip=strip, chunk=c, home=True)

    def compare(key, frame: pd.DataFrame) -> pd.DataFrame:
        return strip_links(
            unpacked(frame["raw"], kind), frame["id"].to_numpy(), frame["copies"].to_numpy(),
            frame["home"].to_numpy(bool), int(key[0]), cosine, key[2] == 0,
        )

    schema = "raw binary, id long, copies long, block int, strip int, chunk int, home boolean"
    found = stored(
        distinct.select("raw", "id", "copies").mapInPandas(dealt, schema)
        .groupBy("block", "strip", "chunk").applyInPandas(compare, "id long, links long, root long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges_found = found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))
    components = connected_components(edges_found)
    repeated = distinct.where("copies > 1").select("raw", F.col("id").alias("first_id"), "copies")
    member = base.join(repeated, "raw", "left").select(
        "id", F.coalesce("first_id", "id").alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    result = (
        member.join(links.withColumnRenamed("id", "first_id"), "first_id", "left")
        .join(components.withColumnRenamed("node", "first_id"), "first_id", "left")
        .select(
            F.col("id").alias("vec_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "first_id").alias("component_id"),
        )
    )
    named = rows.select(F.col(id_column).cast("long").alias("vec_id"))
    every = named.where("vec_id is not null").distinct().join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    nameless = named.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return every.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
