"""Building blocks that keep plans safe when data grows or a key turns hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it as a lambda variable inside ``body``.

    Catalyst would otherwise inline the expression at every use, which is
    quadratic when the use sits inside another higher-order function.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, which the optimizer cannot inline or repeat.

    Use it for expensive values that several later expressions refer to.
    """
    named = [value.alias(name) for name, value in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*named))))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than it needs."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the measured size allows it, else leave a shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def split_hot_join(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    hot_rows: int,
    max_hot_keys: int = 10_000,
) -> DataFrame:
    """Inner join on ``key`` where ``lookup`` has one row per key and its row weight.

    Keys with more than ``hot_rows`` rows in ``big`` are joined by broadcast, so a
    hot key never lands in one task; all the others use a shuffle join. The
    threshold is raised until at most ``max_hot_keys`` keys count as hot, which
    bounds the broadcast whatever the data looks like.
    """
    while not fits(lookup.where(F.col(weight) > hot_rows), max_hot_keys):
        hot_rows *= 10
    hot = F.broadcast(lookup.where(F.col(weight) > hot_rows).drop(weight))
    cold = lookup.where(F.col(weight) <= hot_rows).drop(weight)
    return big.join(hot, key).unionByName(big.join(cold, key))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a private one only in local mode."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="seekspark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame) -> DataFrame:
    """The table stored as compressed columns in the checkpoint folder: for tables of many
    rows, which a checkpoint would write row by row and uncompressed."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_storage(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints of tables that nothing refers to any
    more; it learns of them when the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()
