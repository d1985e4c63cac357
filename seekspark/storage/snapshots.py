"""Copy-on-write tables in hash buckets: an update rewrites only the buckets it touches.

A store holds several tables that share one key, so all rows of a key lie in the bucket of
the same number in each table. A version is a manifest: for every table and bucket the
commit whose folder holds it. A commit writes new folders for the touched buckets, then
creates the next manifest, which fails if another writer created it first. Readers see a
whole version or the one before it, and older versions stay readable until they expire.

Work per commit follows the touched buckets, never the table: old rows are read from the
touched folders only. The manifest has one name per table and bucket, so its size is
fixed by ``buckets``; choose them so that a bucket is a few files (about 1 GB at scale).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.storage.files import SharedFiles

BUCKETS = 64


class CommitConflict(RuntimeError):
    """Another writer committed the version this one was about to create."""


def bucket_of(key: Column, buckets: int) -> Column:
    """Stable bucket of a text key: the leading 32 bits of its SHA-256 modulo ``buckets``."""
    head = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10)
    return F.pmod(head.cast("long"), F.lit(buckets)).cast("int")


class SnapshotStore:
    def __init__(
        self, spark: SparkSession, root: str, schemas: Mapping[str, str], key: str, buckets: int = BUCKETS
    ) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.files = SharedFiles(spark)
        self.schemas = dict(schemas)
        first = self._manifest(0)
        self.buckets = first["buckets"] if first else buckets

    # --- versions ------------------------------------------------------------------
    def _path(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}"

    def _manifest(self, version: int) -> dict | None:
        text = self.files.read(self._path(version))
        return json.loads(text) if text else None

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.root}/versions") if n.isdigit()]

    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        wanted = self.version() if version is None else version
        found = self._manifest(wanted)
        if found is None and wanted:
            raise ValueError(f"version {wanted} doesn't exist")
        return found or {"buckets": self.buckets, "tables": {t: {} for t in self.schemas}, "notes": {}}

    # --- reading -------------------------------------------------------------------
    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, of all buckets or only of those asked for, with ``bucket``."""
        held = self.manifest(version)["tables"][name]
        wanted = held if buckets is None else {str(b): held[str(b)] for b in buckets if str(b) in held}
        schema = f"{self.schemas[name]}, bucket int"
        base = f"{self.root}/tables/{name}"
        paths = [f"{base}/commit={v}/bucket={b}" for b, v in sorted(wanted.items(), key=lambda p: int(p[0]))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema + ", commit string").option("basePath", base).parquet(*paths)
        return found.drop("commit")

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that hold the keys of ``rows``; at most ``buckets`` numbers."""
        numbers = rows.select(bucket_of(F.col(self.key), self.buckets).alias("bucket")).distinct()
        return sorted(r["bucket"] for r in numbers.collect())

    # --- writing -------------------------------------------------------------------
    def replace(
        self, keys: DataFrame, rows: Mapping[str, DataFrame], notes: Mapping[str, object] | None = None
    ) -> int:
        """Replace all rows of ``keys`` by ``rows`` in every table; returns the version.

        Keys without new rows are deleted. Without keys nothing is written but the notes,
        if they differ. ``rows`` must not hold other keys than ``keys``.
        """
        base = self.version()
        before = self.manifest(base)
        merged = {**before["notes"], **(notes or {})}
        keys = keys.select(self.key).distinct()
        touched = self.touched(keys)
        if not touched and merged == before["notes"]:
            return base
        version = base + 1
        commit = f"{version}-{uuid.uuid4().hex[:8]}"  # an own folder, also beside a rival writer
        tables = {}
        for name in self.schemas:
            held = dict(before["tables"][name])
            if touched:
                kept = self.table(name, base, touched).join(keys, self.key, "left_anti")
                columns = kept.columns
                fresh = self.with_bucket(rows[name]).select(*columns) if name in rows else kept.where("false")
                # The hint splits a bucket that has grown large over several tasks.
                out = kept.unionByName(fresh).hint("rebalance", "bucket")
                target = f"{self.root}/tables/{name}/commit={commit}"
                out.write.partitionBy("bucket").parquet(target)
                written = {n.split("=")[1] for n in self.files.names(target) if n.startswith("bucket=")}
                for bucket in map(str, touched):
                    held.pop(bucket, None)
                    if bucket in written:
                        held[bucket] = commit
            tables[name] = held
        manifest = {"buckets": self.buckets, "tables": tables, "notes": merged}
        if base == 0 and self._manifest(0) is None:
            empty = {"buckets": self.buckets, "tables": {t: {} for t in self.schemas}, "notes": {}}
            self.files.create(self._path(0), json.dumps(empty))
        if not self.files.create(self._path(version), json.dumps(manifest)):
            raise CommitConflict(f"version {version} was committed meanwhile")
        return version

    def changed_buckets(self, name: str, old: int, new: int) -> list[int]:
        """Buckets of a table that differ between two versions, from the manifests alone."""
        a, b = self.manifest(old)["tables"][name], self.manifest(new)["tables"][name]
        return sorted(int(k) for k in set(a) | set(b) if a.get(k) != b.get(k))

    def expire(self, keep: int) -> list[int]:
        """Drop all but the newest ``keep`` versions and the folders only they used."""
        versions = [v for v in self.versions() if v]
        gone = versions[: max(len(versions) - keep, 0)]
        used = {
            (t, b, v) for n in versions[len(gone) :] for t, held in self.manifest(n)["tables"].items() for b, v in held.items()
        }
        for n in gone:
            for table, held in self.manifest(n)["tables"].items():
                for b, v in held.items():
                    if (table, b, v) not in used:
                        self.files.remove(f"{self.root}/tables/{table}/commit={v}/bucket={b}")
            self.files.remove(self._path(n))
        return gone
