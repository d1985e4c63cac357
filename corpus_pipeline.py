"""Corpus preparation as a list of stages; each reads what the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns documents, which are written as
Parquet and reread as the next stage's input; the last returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm.frames import stored
from seekspark.scale import small_side
from seekspark.session import ARROW_BATCH

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# Ids to drop are broadcast up to this many, 8 bytes each; beyond it they are joined by id.
BROADCAST_IDS = 1_000_000


def _read(spark: SparkSession, docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of documents; Python workers get small batches, however long the texts are."""
    spark.conf.set(*ARROW_BATCH)
    return docs.select(*columns)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids``."""
    ids = stored(ids.where("doc_id is not null").distinct())
    return docs.join(small_side(ids, BROADCAST_IDS), "doc_id", "left_anti").select(*COLUMNS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, doesn't predict toxic.

    Decides by row and text alone, so repeated rows share their fate. A null, empty or
    wordless text has no clause and gets the score of no evidence; a null id, source or
    language plays no part. Without labels nothing is rejected; no rows give no rows; only the columns
    of documents go on.
    """
    from seekspark.llm.toxicity import toxicity_scores, train_toxicity

    docs = _read(spark, docs, *COLUMNS)
    model = train_toxicity(docs, _labels(spark, sf_dir), F.lit(True))
    return toxicity_scores(docs, model, *COLUMNS).where("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Decides by doc_id: rows that share an id go if one of them is rejected, rows without an
    id stay. Null and empty texts stay; without trusted labels nothing is rejected; no rows give no rows; only the columns of documents
    go on.
    """
    from seekspark.llm.quality import quality_scores

    docs = _read(spark, docs, *COLUMNS)
    rejected = quality_scores(docs, _labels(spark, sf_dir)).where("not kept").select("doc_id")
    return _without(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Decides by doc_id: rows of one id count as one document, by the text of the smallest
    digest, and stay or go together; rows without an id belong to no class and stay. Texts
    with equal words are one class; null texts and texts without words all stay; no rows give
    no rows; only the columns of documents go on.
    """
    from seekspark.llm.neardup import near_duplicate_classes

    docs = _read(spark, docs, *COLUMNS)
    dropped = near_duplicate_classes(docs).where("not kept").select("doc_id")
    return _without(docs, dropped)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences.

    Every row is packed, also repeated ones and those without an id; a null or empty text is
    the end token alone; no rows give no rows.
    """
    import public_tokenizers

    from seekspark.llm.packing import pack_documents

    return pack_documents(_read(spark, docs, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# Learned models and tokenization can't be stated in SQL; the stages are tested against
# brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
