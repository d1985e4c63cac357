"""Graph operators over entity and relation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.scale import BROADCAST_ROWS, compact, cut_lineage, free_storage, small_side, split_hot_join

# A node with more neighbour rows than this is joined by broadcast, not by shuffle.
HOT_NODE_ROWS = 1_000_000
# The filter of the last hop of a path search: 32 MB at most, in blocks of 8 KB.
BITS_PER_PAIR = 16
MAX_FILTER_BITS = 1 << 28
BLOCK_WORDS = 1024
# Asked pairs and their ends, one or two names a row, are broadcast up to this many.
NARROW_ROWS = 4 * BROADCAST_ROWS


def _with_minimum(pairs: DataFrame, total: int) -> DataFrame:
    """Attach to every ``u, v`` row the smallest v of its u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    if total <= HOT_NODE_ROWS:
        return pairs.join(low.drop("n"), "u")
    return split_hot_join(pairs, low, "u", "n", HOT_NODE_ROWS)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` for undirected ``src, dst`` rows; component = smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014): the number of rounds grows with the logarithm of
    the size, not with the diameter. Every round ends in a reliable checkpoint.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    pairs = edges.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).where("u <> v")
    pairs = cut_lineage(pairs.distinct())
    known = None
    for _ in range(max_rounds):
        size = pairs.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if known == (size["n"], size["h"]):
            break
        known = (size["n"], size["h"])
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_minimum(both, 2 * size["n"])
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
            .distinct()
        )
        star = _with_minimum(large, size["n"])
        small = star.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        pairs = cut_lineage(
            small.unionByName(star.select("u", F.col("low").alias("v"))).distinct()
        )
        del both, large, star, small
        free_storage(pairs.sparkSession)
    else:
        raise RuntimeError("components did not converge")
    roots = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def degrees(relations: DataFrame) -> DataFrame:
    """``entity_id, in_degree, out_degree, degree`` of the directed multigraph."""
    ends = relations.select(
        F.explode(
            F.array(
                F.struct(F.col("source_entity_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target_entity_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("end")
    )
    return ends.groupBy("end.entity_id").agg(
        F.sum("end.i").alias("in_degree"),
        F.sum("end.o").alias("out_degree"),
        F.count("*").alias("degree"),
    )


def entity_degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    joined = entities.join(degrees(relations), "entity_id", "left")
    return joined.fillna(0, ["in_degree", "out_degree", "degree"])


def top_entities(entities: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """Highest degree first, then name without case, then id."""
    if k < 0:
        raise ValueError("top_k must not be negative")
    ordered = entity_degrees(entities, relations).orderBy(
        F.desc("degree"), F.lower("canonical_name"), "entity_id"
    )
    return ordered.limit(k)


def graph_summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: nodes, edges, weak components, size of the largest, isolated nodes."""
    pairs = relations.select(
        F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst")
    )
    sizes = (
        connected_components(pairs).groupBy("component").agg(F.count("*").alias("size"))
    )
    isolated = entities.join(
        pairs.select(F.explode(F.array("src", "dst")).alias("entity_id")), "entity_id", "left_anti"
    )
    parts = sizes.agg(F.count("*").alias("linked"), F.max("size").alias("largest"))
    return (
        entities.agg(F.count("*").alias("nodes"))
        .join(F.broadcast(relations.agg(F.count("*").alias("edges"))))
        .join(F.broadcast(parts))
        .join(F.broadcast(isolated.agg(F.count("*").alias("isolated_nodes"))))
        .select(
            "nodes",
            "edges",
            (F.col("linked") + F.col("isolated_nodes")).alias("components"),
            F.greatest(
                F.coalesce("largest", F.lit(0)), F.least(F.col("isolated_nodes"), F.lit(1))
            ).alias("largest_component"),
            "isolated_nodes",
        )
    )


def adjacency(relations: DataFrame) -> DataFrame:
    """Both directions of every relation: ``entity_id, relation_id, neighbor_id, direction``."""
    ends = F.array(
        F.struct(
            F.col("source_entity_id").alias("entity_id"),
            F.col("target_entity_id").alias("neighbor_id"),
            F.lit("outgoing").alias("direction"),
        ),
        F.struct(
            F.col("target_entity_id").alias("entity_id"),
            F.col("source_entity_id").alias("neighbor_id"),
            F.lit("incoming").alias("direction"),
        ),
    )
    return relations.select("relation_id", F.explode(ends).alias("end")).select(
        "end.entity_id", "relation_id", "end.neighbor_id", "end.direction"
    )


def dangling_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation ends without an entity; must be empty before a graph is published."""
    ends = relations.select(
        "relation_id",
        F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"),
    )
    return ends.join(entities.select("entity_id"), "entity_id", "left_anti")


def expand_one_hop(
    seeds: DataFrame, neighbors: DataFrame, traversed: DataFrame, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Next edges of ``seeds(session_id, entity_id)`` and the seeds then exhausted.

    Each relation is taken once per session, from its smallest (seed, relation,
    neighbour); at most ``limit`` edges per session are selected.
    """
    seen = traversed.select("session_id", "relation_id")
    around = neighbors.join(small_side(seeds.select("session_id", "entity_id")), "entity_id")
    fresh = around.join(small_side(seen), ["session_id", "relation_id"], "left_anti")
    once = fresh.groupBy("session_id", "relation_id").agg(
        F.min(F.struct("entity_id", "neighbor_id", "direction")).alias("edge")
    )
    order = Window.partitionBy("session_id").orderBy("edge.entity_id", "relation_id", "edge.neighbor_id")
    selected = (
        once.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(
            "session_id",
            F.col("edge.entity_id").alias("seed_entity_id"),
            "relation_id",
            F.col("edge.neighbor_id").alias("neighbor_id"),
            F.col("edge.direction").alias("direction"),
            "rank",
        )
    )
    left = fresh.join(
        small_side(selected.select("session_id", "relation_id")),
        ["session_id", "relation_id"],
        "left_anti",
    )
    exhausted = seeds.select("session_id", "entity_id").join(
        left.select("session_id", "entity_id"), ["session_id", "entity_id"], "left_anti"
    )
    return selected, exhausted


def linked_pairs(relations: DataFrame) -> DataFrame:
    """``low, high, relation_id``: each linked pair once, its smaller node first, without loops."""
    source, target = F.col("source_entity_id"), F.col("target_entity_id")
    return (
        relations.where(source != target)
        .groupBy(F.least(source, target).alias("low"), F.greatest(source, target).alias("high"))
        .agg(F.min("relation_id").alias("relation_id"))
    )


def both_ways(pairs: DataFrame, *others: str) -> DataFrame:
    """``a, b`` and other columns: both directions of ``low, high``, made where it is read."""
    ends = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("low", "high"), ("high", "low"))])
    return pairs.select(F.inline(ends), *others)


def undirected_edges(relations: DataFrame) -> DataFrame:
    """``a, b, relation_id``: both directions of each linked pair, once, without loops."""
    return both_ways(linked_pairs(relations), "relation_id")


def shortest_paths(pairs: DataFrame, relations: DataFrame, max_hops: int) -> DataFrame:
    """Undirected shortest paths of ``pairs(source, target)`` up to ``max_hops`` edges.

    The search grows from both ends in turn and keeps one path per (end, node). Linked pairs
    are stored once, as columns; each hop joins both directions with the ends or a stored
    frontier, broadcast while small, so that neither edges nor a hub's neighbours are exchanged.
    Pairs that have met drop out, and only ends of the others grow further. The last hop,
    the largest, keeps only nodes that a partner has reached. Among equally
    short paths the smallest node sequence wins; parallel edges give their smallest
    relation id. Output ``source, target, node_ids, relation_ids``.
    """
    if not 1 <= max_hops <= 4:
        raise ValueError("max_hops must be between 1 and 4")
    pair = compact(linked_pairs(relations))
    edge, steps = both_ways(pair, "relation_id"), both_ways(pair)
    asked = cut_lineage(pairs.select("source", "target").where("source <> target").distinct())
    reached = {
        side: asked.select(F.col(side).alias("end"), F.col(side).alias("node"), F.array(side).alias("path")).distinct()
        for side in ("source", "target")
    }
    found = []
    for hops in range(1, max_hops + 1):
        side = "source" if hops % 2 else "target"
        ends = asked.select(F.col(side).alias("end")).distinct()
        if hops <= 2:
            grown = steps.join(small_side(ends, NARROW_ROWS), F.col("a") == F.col("end"))
            grown = grown.select("end", F.col("b").alias("node"), F.array("end").alias("path"))
        else:
            frontier = cut_lineage(reached[side].join(small_side(ends), "end", "left_semi"))
            grown = steps.join(small_side(frontier), F.col("a") == F.col("node")).select("end", F.col("b").alias("node"), "path")
        if hops == max_hops:
            grown = _may_meet(grown, asked, reached, side)
        path = F.concat("path", F.array("node")) if side == "source" else F.concat(F.array("node"), "path")
        grown = grown.select("end", "node", path.alias("path"))
        # One step from its end, a node is met once.
        reached[side] = compact(grown if hops <= 2 else grown.groupBy("end", "node").agg(F.min("path").alias("path")))
        free_storage(pair.sparkSession)
        met = _meetings(asked, reached, hops)
        best = cut_lineage(met.groupBy("source", "target").agg(F.min("node_ids").alias("node_ids")))
        found.append(best)
        asked = cut_lineage(asked.join(small_side(best.select("source", "target")), ["source", "target"], "left_anti"))
        if asked.isEmpty():
            break
    shortest = reduce(DataFrame.unionByName, found)
    hop_rows = shortest.select(
        "source", "target", "node_ids",
        F.posexplode(F.slice("node_ids", F.lit(1), F.size("node_ids") - 1)).alias("at", "a"),
    ).withColumn("b", F.get("node_ids", F.col("at") + 1))
    return (
        edge.join(small_side(hop_rows), ["a", "b"])
        .groupBy("source", "target", "node_ids")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "relation_id"))),
                lambda hop: hop["relation_id"],
            ).alias("relation_ids")
        )
    )


def _meetings(asked: DataFrame, reached: dict[str, DataFrame], hops: int) -> DataFrame:
    """``source, target, node_ids`` of the pairs whose ends have reached one node."""
    if hops == 1:  # targets have reached themselves only
        left = reached["source"].select(F.col("end").alias("source"), F.col("node").alias("target"), F.col("path").alias("node_ids"))
        return left.join(small_side(asked, NARROW_ROWS), ["source", "target"])
    left = reached["source"].select(F.col("end").alias("source"), "node", F.col("path").alias("head"))
    right = reached["target"].select(F.col("end").alias("target"), "node", F.col("path").alias("tail"))
    small = small_side(asked, NARROW_ROWS)
    # Most nodes meet nobody, so paths are joined with the few that do.
    met = small_side(cut_lineage(small.join(left.drop("head"), "source").join(right.drop("tail"), ["target", "node"])))
    free_storage(asked.sparkSession)
    return met.join(left, ["source", "node"]).join(right, ["target", "node"]).select(
        "source", "target", F.concat("head", F.slice("tail", F.lit(2), F.size("tail"))).alias("node_ids")
    )


def _may_meet(grown: DataFrame, asked: DataFrame, reached: dict[str, DataFrame], side: str) -> DataFrame:
    """The rows of ``grown`` whose ``node`` a partner of their ``end`` may have reached.

    A Bloom filter of the pairs that can meet, cut into blocks of words of 64 bits, drops
    the others before they are exchanged. The few that pass wrongly meet nobody later.
    """
    other = "target" if side == "source" else "source"
    partner = reached[other].select(F.col("end").alias(other), "node")
    wanted = asked.select(F.col(side).alias("end"), other).join(partner, other).select("end", "node")
    bits = 1 << min((wanted.count() * BITS_PER_PAIR).bit_length(), MAX_FILTER_BITS.bit_length() - 1)
    bits = max(bits, 64 * BLOCK_WORDS)
    at = F.pmod(F.xxhash64("end", "node"), F.lit(bits))
    bit = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    marks = wanted.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), bit.alias("mask"))
    none = grown.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = marks.unionByName(none).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    blocks = words.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("masks")
    )
    placed = grown.withColumn("at", at).withColumn("block", F.shiftright("at", (64 * BLOCK_WORDS).bit_length() - 1))
    mask = F.get("masks", (F.shiftright("at", 6) % BLOCK_WORDS).cast("int"))
    # At most MAX_FILTER_BITS, whatever the input.
    return placed.join(F.broadcast(blocks), "block").where(F.getbit(mask, (F.col("at") % 64).cast("int")) == 1).select(*grown.columns)


def node_link_rows(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Node-link export as sorted JSON rows: ``section, sort_key, json``.

    The graph is written as JSON lines; one document would not fit one task.
    """
    node_fields = sorted(c for c in entities.columns if c != "entity_id")
    edge_fields = sorted(
        c for c in relations.columns
        if c not in ("relation_id", "source_entity_id", "target_entity_id")
    )
    nodes = entities.select(
        F.lit("nodes").alias("section"),
        F.col("entity_id").alias("sort_key"),
        F.to_json(F.struct(F.col("entity_id").alias("id"), *node_fields)).alias("json"),
    )
    edges = relations.select(
        F.lit("edges").alias("section"),
        F.concat_ws("\x1f", "source_entity_id", "target_entity_id", "relation_id").alias("sort_key"),
        F.to_json(
            F.struct(
                F.col("source_entity_id").alias("source"),
                F.col("target_entity_id").alias("target"),
                F.col("relation_id").alias("key"),
                *edge_fields,
            )
        ).alias("json"),
    )
    return nodes.unionByName(edges)
