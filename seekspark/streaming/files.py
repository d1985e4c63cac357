"""Streaming ingestion: new files become document versions, bad ones a failure log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekspark.sources.files import LOADERS, load_documents, suffix_of

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    root = folder.rstrip("/")
    label = root.rsplit("/", 1)[-1] or "root"
    found = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(root)
    )
    inside = F.element_at(F.split("path", "/" + label + "/", 2), 2)
    return found.select(
        "path", inside.alias("relative_path"), F.lit(label).alias("root"), "content", suffix_of(F.col("path")).alias("suffix")
    ).where(F.col("suffix").isin(list(LOADERS)))


def start_ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every new document version; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        documents, failures = load_documents(batch)
        documents.write.mode("overwrite").parquet(f"{out}/documents/epoch={epoch}")
        failures.write.mode("overwrite").parquet(f"{out}/failures/epoch={epoch}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_documents(spark: SparkSession, out: str) -> DataFrame:
    """Newest version per document over all batches."""
    log = spark.read.parquet(f"{out}/documents")
    rest = [c for c in log.columns if c not in ("document_id", "epoch")]
    newest = F.max_by(F.struct(*rest), "epoch")
    return log.groupBy("document_id").agg(newest.alias("now")).select("document_id", "now.*")
