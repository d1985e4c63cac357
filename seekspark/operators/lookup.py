"""Inspection of stored objects by id or by the beginning of one.

Each kind of object has an id prefix and a table clustered by id: files hold neighbouring
ids in order, so asking for a beginning reads one range of row groups. What belongs to an
object (attempts of an extraction, relations of an entity, evidence) lies in tables
clustered by the owner's id and is found by the same range.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.storage.files import SharedFiles


@dataclass(frozen=True)
class Kind:
    """``prefix`` routes an id here; ``parts`` maps names to tables of rows per object, as
    ``owner column, order columns``."""

    name: str
    prefix: str
    id: str
    parts: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)


KINDS = (
    Kind("graph_build_run", "gbr_", "run_id", {"items": ("run_id", ("extraction_id",))}),
    Kind("chunk_extraction", "xtr_", "extraction_id", {
        "attempts": ("extraction_id", ("ordinal",)), "reviews": ("extraction_id", ("run_id",)),
    }),
    Kind("extraction_attempt", "xat_", "attempt_id"),
    Kind("entity", "ent_", "entity_id", {
        "outgoing": ("source_entity_id", ("relation_id",)), "incoming": ("target_entity_id", ("relation_id",)),
        "entity_evidence": ("entity_id", ("chunk_id",)),
    }),
    Kind("relation", "rel_", "relation_id", {"relation_evidence": ("relation_id", ("chunk_id",))}),
)


def in_prefix(column: str, prefix: str) -> Column:
    """The id range of a prefix, as comparisons that a scan can push down."""
    last = prefix[:-1] + chr(ord(prefix[-1]) + 1)
    return (F.col(column) >= prefix) & (F.col(column) < last)


class ObjectTables:
    """Clustered tables below a shared root, and look-ups in them."""

    def __init__(self, spark: SparkSession, root: str, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)
        self.kinds = {kind.name: kind for kind in kinds}

    def save(self, table: str, rows: DataFrame, id_column: str, parts: int | None = None) -> None:
        """Write a table in the order of ``id_column``, by a range exchange over the ids."""
        order = [F.col(id_column)]
        ranged = rows.repartitionByRange(*([parts] if parts else []), *order)
        ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.root}/{table}")

    def _rows(self, table: str, column: str, prefix: str) -> DataFrame | None:
        if not self.files.exists(f"{self.root}/{table}"):
            return None
        return self.spark.read.parquet(f"{self.root}/{table}").where(in_prefix(column, prefix))

    def kind_of(self, prefix: str) -> Kind:
        """The kind whose ids begin like ``prefix``, which must hold the whole kind prefix."""
        for kind in self.kinds.values():
            if prefix.startswith(kind.prefix):
                return kind
        raise ValueError(f"no kind of object has ids like {prefix!r}")

    def objects(self, prefix: str) -> DataFrame:
        """Rows of the objects whose id begins with ``prefix``."""
        kind = self.kind_of(prefix)
        found = self._rows(kind.name, kind.id, prefix)
        if found is None:
            raise ValueError(f"no table of {kind.name}")
        return found

    def parts(self, prefix: str, name: str) -> DataFrame:
        """Rows that belong to those objects; for hubs, read these instead of ``inspect``."""
        kind = self.kind_of(prefix)
        column, _ = kind.parts[name]
        found = self._rows(name, column, prefix)
        if found is None:
            raise ValueError(f"no table of {name}")
        return found

    def inspect(self, prefix: str) -> DataFrame:
        """``kind`` and each object with its parts nested, in their order.

        The parts of one object become arrays; all rows come from the range of the prefix.
        """
        kind = self.kind_of(prefix)
        whole = self.objects(prefix).withColumn("kind", F.lit(kind.name))
        for name, (column, order) in kind.parts.items():
            rows = self._rows(name, column, prefix)
            if rows is None:
                continue
            fields = [*order, *[c for c in rows.columns if c not in (*order, column)]]
            listed = rows.groupBy(F.col(column).alias(kind.id)).agg(
                F.array_sort(F.collect_list(F.struct(*fields))).alias(name)
            )
            whole = whole.join(listed, kind.id, "left").withColumn(name, F.coalesce(name, F.slice(F.array(F.struct(*[
                F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields
            ])), 1, 0)))
        return whole
