"""What a change makes stale: the fixed point over a stored dependency table.

An edge says that ``(kind, id)`` was derived from ``(upstream_kind, upstream_id)``:
document to chunk, chunk to entity and relation, any of them to run and profile. The
closure walks the edges by semi-joins, one round per level of derivation and one more that
finds nothing new; a cycle ends because only things not seen before go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.scale import cut_lineage, small_side
from seekspark.storage.files import SharedFiles

EDGES = "upstream_kind string, upstream_id string, kind string, id string"


def edges(rows: DataFrame, upstream_kind: str, upstream_id: str, kind: str, id_column: str) -> DataFrame:
    """Edge rows from a table that holds both ids."""
    return rows.select(
        F.lit(upstream_kind).alias("upstream_kind"), F.col(upstream_id).cast("string").alias("upstream_id"),
        F.lit(kind).alias("kind"), F.col(id_column).cast("string").alias("id"),
    )


def invalidation_closure(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """``kind, id, depth``: the ``changed(kind, id)`` and all that depends on them.

    ``depth`` counts the derivation steps from the nearest change. Each round reads only
    edges from the kinds in its frontier, broadcasts the frontier if it is small, and
    writes only what is new. Rows with a null kind or id take part in nothing.
    """
    named = "kind is not null and id is not null"
    frontier = cut_lineage(changed.select("kind", "id").where(named).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    while True:
        kinds = [r["kind"] for r in frontier.select("kind").distinct().collect()]
        if not kinds:
            return seen
        depth += 1
        asked = frontier.select(F.col("kind").alias("upstream_kind"), F.col("id").alias("upstream_id"))
        reached = (
            dependencies.where(F.col("upstream_kind").isin(kinds)).where(named)
            .join(small_side(asked), ["upstream_kind", "upstream_id"], "left_semi")
            .select("kind", "id").distinct()
        )
        frontier = cut_lineage(reached.join(seen, ["kind", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)


class DependencyStore:
    """Edges by owner (a run or profile): each owner writes its own once, whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def record(self, owner: str, rows: DataFrame) -> None:
        """Edges of ``owner``, laid out by upstream kind; a second call replaces the first."""
        rows.select("kind", "id", "upstream_id", "upstream_kind").write.mode("overwrite").partitionBy(
            "upstream_kind"
        ).parquet(f"{self.root}/owner={owner}")

    def owners(self) -> list[str]:
        return [n.split("=", 1)[1] for n in self.files.names(self.root) if n.startswith("owner=")]

    def forget(self, owner: str) -> None:
        self.files.remove(f"{self.root}/owner={owner}")

    def edges(self) -> DataFrame:
        if not self.owners():
            return self.spark.createDataFrame([], EDGES)
        schema = "kind string, id string, upstream_id string, upstream_kind string, owner string"
        return self.spark.read.schema(schema).parquet(self.root).select("upstream_kind", "upstream_id", "kind", "id")
