"""Runs of several stages that can stop anywhere and go on where they stopped.

Each stage writes its tables into a folder of its own attempt and then creates a marker
that names the folder. Creation is exclusive, so of two rival attempts one counts and the
other reads it. A stage with a marker is never computed again. Stages over items (one call
to a model per chunk, for instance) commit in parts and offer only unfinished items.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.storage.files import SharedFiles

Tables = Mapping[str, DataFrame]


class StageRun:
    """The stored stages of one run below ``root/run_id``."""

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.run_id, self.files = spark, run_id, SharedFiles(spark)
        self.folder = f"{root.rstrip('/')}/{run_id}"

    def _marker(self, stage: str) -> str:
        return f"{self.folder}/done/{stage}"

    def finished(self, stage: str) -> dict | None:
        text = self.files.read(self._marker(stage))
        return json.loads(text) if text else None

    def _commit(self, stage: str, tables: Tables) -> dict:
        attempt = f"{self.folder}/data/{stage}-{uuid.uuid4().hex[:12]}"
        for name, frame in tables.items():
            frame.write.parquet(f"{attempt}/{name}")
        rows = {name: self.spark.read.parquet(f"{attempt}/{name}").count() for name in tables}
        schemas = {name: frame.schema.json() for name, frame in tables.items()}
        entry = {"run_id": self.run_id, "stage": stage, "folder": attempt, "rows": rows, "schemas": schemas}
        if not self.files.create(self._marker(stage), json.dumps(entry)):
            self.files.remove(attempt)
        return self.finished(stage)

    def _tables(self, entry: dict) -> dict[str, DataFrame]:
        from pyspark.sql.types import StructType

        return {
            name: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{entry['folder']}/{name}")
            for name, schema in entry["schemas"].items()
        }

    def stage(self, name: str, build: Callable[[], Tables]) -> dict[str, DataFrame]:
        """The stored tables of a stage; ``build`` is only called if it isn't finished."""
        return self._tables(self.finished(name) or self._commit(name, build()))

    def items(
        self, name: str, items: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], parts: int = 16
    ) -> DataFrame:
        """Rows that ``build`` gives for all ``items``, each offered to it once.

        Unfinished items are found by an anti-join on the keys of the committed parts, so
        a later call may also bring new items. ``build`` sees a fraction of about
        ``1 / parts`` at a time; what a stop loses is one part.
        """
        done = [n for n in self.files.names(f"{self.folder}/done") if n.startswith(f"{name}.part-")]
        stored = [self._tables(self.finished(n)) for n in done]
        todo = items
        if stored:
            keys = reduce(DataFrame.unionByName, [old["keys"] for old in stored])
            todo = items.join(keys, key, "left_anti")
        for part in range(parts):
            mine = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
            if mine.isEmpty():
                continue
            entry = self._commit(
                f"{name}.part-{len(stored):06d}", {"rows": build(mine), "keys": mine.select(key).distinct()}
            )
            stored.append(self._tables(entry))
        if not stored:
            return build(items.where("false"))
        return reduce(DataFrame.unionByName, [part["rows"] for part in stored])


def stage_listing(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, stage, table, rows`` of every finished stage below ``root``, read from the
    markers as one JSON table."""
    schema = "run_id string, stage string, rows map<string, long>"
    if not SharedFiles(spark).exists(root):
        return spark.createDataFrame([], "run_id string, stage string, table string, rows long")
    found = spark.read.schema(schema).json(f"{root.rstrip('/')}/*/done/*")
    return found.select("run_id", "stage", F.explode("rows").alias("table", "rows"))


class RunStore:
    """Runs below a shared root: their state, and one pointer to the published run."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def run(self, run_id: str) -> StageRun:
        return StageRun(self.spark, f"{self.root}/runs", run_id)

    def runs(self) -> list[str]:
        return self.files.names(f"{self.root}/runs")

    def state(self, run_id: str) -> dict | None:
        text = self.files.read(f"{self.root}/states/{run_id}")
        return json.loads(text) if text else None

    def active(self) -> str | None:
        return self.files.read(f"{self.root}/ACTIVE") or None

    def publish(self, run_id: str, facts: Mapping[str, object]) -> None:
        """Make a finished run the one that readers see, with one pointer change."""
        self.files.write(f"{self.root}/states/{run_id}", json.dumps({"status": "ready", **facts}))
        self.files.write(f"{self.root}/ACTIVE", run_id)

    def invalidate(self, run_id: str, reason: str) -> None:
        state = self.state(run_id)
        if state is None or state["status"] == "stale":
            return
        self.files.write(f"{self.root}/states/{run_id}", json.dumps({**state, "status": "stale", "error": reason}))
        if self.active() == run_id:
            self.files.write(f"{self.root}/ACTIVE", "")
