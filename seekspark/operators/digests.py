"""A tree of digests over the rows of a table, to fingerprint, compare and update it.

A row belongs to the leaf named by the first hex digits of the hash of its key, so a
changed row stays where it was. A leaf digests its rows, a node its at most sixteen
children; no group is larger than a leaf. Two snapshots are compared from the root down,
entering only nodes that differ, and an update recomputes touched leaves and their paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions.ids import sha256_text
from seekspark.scale import cut_lineage, small_side

# Rows that a leaf holds on average when the depth is chosen from the size.
LEAF_ROWS = 256


def depth_for(rows: int) -> int:
    """Levels below the root for a table of so many rows."""
    depth = 1
    while 16**depth * LEAF_ROWS < rows:
        depth += 1
    return depth


def leaf_of(key: str, depth: int) -> Column:
    return F.substring(sha256_text(F.col(key).cast("string")), 1, depth)


def _leaves(rows: DataFrame, key: str, content_hash: str, depth: int) -> DataFrame:
    row = sha256_text(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(content_hash)))
    return rows.select(leaf_of(key, depth).alias("prefix"), row.alias("row")).groupBy("prefix").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("digest"), F.count("*").alias("n")
    )


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.concat("prefix", "digest")))
    return nodes.groupBy(F.substring("prefix", 1, level).alias("parent")).agg(
        F.sha2(F.array_join(listed, ""), 256).alias("digest"), F.sum("n").alias("n")
    ).select(F.col("parent").alias("prefix"), "digest", "n")


def _with_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.select(F.lit(level).alias("level"), "prefix", "digest", "n")


def digest_tree(rows: DataFrame, key: str, content_hash: str, depth: int) -> DataFrame:
    """``level, prefix, digest, n`` of all nodes; level 0 is the root. Without rows there
    are no nodes. Rows with a null key aren't part of the tree."""
    if depth < 1:
        raise ValueError("depth must be positive")
    nodes = cut_lineage(_leaves(rows.where(F.col(key).isNotNull()), key, content_hash, depth))
    levels = [_with_level(nodes, depth)]
    for level in range(depth - 1, -1, -1):
        nodes = _parents(nodes, level)
        levels.append(_with_level(nodes, level))
    return reduce(DataFrame.unionByName, levels)


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """``prefix`` of the leaves that differ between two trees of one depth."""
    differing = None
    for level in range(depth + 1):
        a, b = (tree.where(F.col("level") == level).select("prefix", "digest") for tree in (old, new))
        if differing is not None:
            inside = small_side(differing.withColumnRenamed("prefix", "parent"))
            parent = F.substring("prefix", 1, level - 1)
            a, b = (
                side.withColumn("parent", parent).join(inside, "parent", "left_semi").drop("parent") for side in (a, b)
            )
        met = a.withColumnRenamed("digest", "old").join(b.withColumnRenamed("digest", "new"), "prefix", "full_outer")
        differing = cut_lineage(met.where(~F.col("old").eqNullSafe(F.col("new"))).select("prefix"))
        if differing.isEmpty():
            break
    return differing


def changed_rows(
    old: DataFrame, new: DataFrame, leaves: DataFrame, key: str, content_hash: str, depth: int
) -> DataFrame:
    """``key, change`` (added, removed, changed) of the rows below the given leaves."""
    wanted = small_side(leaves)

    def below(rows: DataFrame, name: str) -> DataFrame:
        placed = rows.select(key, F.col(content_hash).alias(name), leaf_of(key, depth).alias("prefix"))
        return placed.join(wanted, "prefix", "left_semi").drop("prefix")

    met = below(old, "old").join(below(new, "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, change.alias("change"))


def updated_tree(
    tree: DataFrame, rows: DataFrame, changed: DataFrame, key: str, content_hash: str, depth: int
) -> DataFrame:
    """The tree of ``rows``, given the one before ``changed`` keys changed, came or went.

    Only rows in the leaves of changed keys are digested, and only nodes above them.
    """
    touched = cut_lineage(changed.select(leaf_of(key, depth).alias("prefix")).where("prefix is not null").distinct())
    inside = rows.withColumn("prefix", leaf_of(key, depth)).join(small_side(touched), "prefix", "left_semi")
    fresh = cut_lineage(_leaves(inside, key, content_hash, depth))
    levels = []
    for level in range(depth, -1, -1):
        kept = tree.where(F.col("level") == level).select("prefix", "digest", "n").join(
            small_side(touched), "prefix", "left_anti"
        )
        nodes = kept.unionByName(fresh)
        levels.append(_with_level(nodes, level))
        if level:
            above = touched.select(F.substring("prefix", 1, level - 1).alias("prefix")).distinct()
            children = nodes.withColumn("parent", F.substring("prefix", 1, level - 1)).join(
                small_side(above.withColumnRenamed("prefix", "parent")), "parent", "left_semi"
            )
            fresh = cut_lineage(_parents(children.drop("parent"), level - 1))
            touched = cut_lineage(above)
    return reduce(DataFrame.unionByName, levels)
