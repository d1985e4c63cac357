"""Small helpers shared by the operators: columns, splits and stored intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.scale import checkpoint_dir


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so other columns can't clash with its own."""
    return docs.select("doc_id", "text", *more)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text modulo ``modulus``; -1 for a null id."""
    value = F.crc32(F.col(column).cast("string").cast("binary")) % modulus
    return F.coalesce(value, F.lit(-1)).cast("int")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Like ``checkpoint()`` it cuts the lineage and survives lost executors; columnar
    files are a fraction of the size of checkpointed rows.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
