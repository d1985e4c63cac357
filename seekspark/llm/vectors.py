"""Vector columns: which rows are usable, and their packing as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from seekspark.llm.frames import stored


def packed_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Stored ``id, raw`` of the usable rows: the bytes of single or double components.

    Single precision is kept where the column has it; ``unpacked`` returns doubles.

    Not usable are null or empty vectors, vectors with a null or non-finite component,
    zero vectors, rows without an id, and vectors of another length than most rows have
    (the longer one, if tied). Of rows that share an id the smallest vector counts.
    """
    named = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = named.where(
        "id is not null and v is not null "
        "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(v, x -> x <> 0)"
    )
    width = (
        fine.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("width")).first()
    )
    width = width["width"] if width else 1
    return stored(
        fine.where(F.size("v") == width)
        .mapInArrow(_packer(precision(rows, vector_column)), "id long, raw binary")
        .groupBy("id").agg(F.min("raw").alias("raw"))
    )


def _packer(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if batch.num_rows:
                at = column.offsets.to_numpy()
                values = column.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
                values = values.astype(kind)
                raw = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    return run


def precision(rows: DataFrame, vector_column: str) -> str:
    return "<f4" if rows.schema[vector_column].dataType.elementType == FloatType() else "<f8"


def unpacked(raw, kind: str) -> np.ndarray:
    rows = list(raw)
    if not rows:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
