"""A stored inverted index whose blocks carry score bounds, and search that skips blocks.

Documents lie in ranges of neighbouring documents, the same for all terms. A block holds
the postings of one term in one range. The table of bounds has a row per block with the
largest count and the shortest document in it; BM25 rises with the one and falls with the
other, so they bound every score in the block for any valid k1 and b.

A search sums the bounds of its terms per range, scores the few most promising ranges of
each question whole, and takes the k-th score found as the threshold. Of all other ranges
only those whose bound reaches it are scored. Ranges that hold a document of the true top
k always do, so the result is that of a full scan. No step gathers a term: a frequent term
is many blocks, and its postings lie in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions.text import lexical_tokens, run_lengths
from seekspark.operators.fusion import top_k
from seekspark.operators.lexical import B, K1, TOTALS, check_parameters, query_terms, term_weights
from seekspark.scale import cut_lineage, small_side

# Documents per range; the bounds of a term are one row for so many of its documents.
RANGE_DOCUMENTS = 32
# Ranges per question that are scored to find the threshold.
FIRST_RANGES = 4
# Terms up to this many are named in the scan filter, so that row groups can be skipped.
NAMED_TERMS = 1_000
# Bounds and scores are sums in different orders; a bound this close still counts.
SLACK = 1e-9


@dataclass
class LexicalIndex:
    """``bounds``: term, range, n, tokens, max_tf, min_len. ``postings``: term, range and an
    array of object_id, tf, doc_len. ``terms``: term, df, tokens, with the totals row."""

    bounds: DataFrame
    postings: DataFrame
    terms: DataFrame

    NAMES = ("bounds", "postings", "terms")


@dataclass
class Found:
    """``hits`` are query_id, object_id, score, rank. ``blocks`` counts per query_id the
    blocks of its terms and those whose postings were scored."""

    hits: DataFrame
    blocks: DataFrame


def in_ranges(corpus: DataFrame, text: str, order: tuple[str, ...], documents: int) -> DataFrame:
    """``object_id, range, text`` with neighbours in ``order`` in one range.

    Ranges are numbered within the tasks of a range exchange; no global count is needed.
    """
    columns = [F.col(c) for c in order]
    place = F.monotonically_increasing_id()
    inside = F.floor(place.bitwiseAND((1 << 33) - 1) / documents)
    placed = corpus.where(F.col(text).isNotNull()).repartitionByRange(*columns).sortWithinPartitions(*columns)
    return placed.select(
        "object_id", (F.shiftright(place, 33) * F.lit(1 << 33) + inside).alias("range"), F.col(text).alias("text")
    )


def build_index(
    corpus: DataFrame, folder: str, text: str = "text", order: tuple[str, ...] = ("object_id",),
    documents: int = RANGE_DOCUMENTS,
) -> LexicalIndex:
    """Write the index of ``corpus(object_id, text)`` below ``folder``; null texts are no
    documents.

    ``order`` decides which documents are neighbours: the more alike they are, the more
    blocks a search skips. Both tables are sorted by term and range.
    """
    spark = corpus.sparkSession
    tokens = in_ranges(corpus, text, order, documents).select(
        "object_id", "range", F.explode(F.array(lexical_tokens(F.col("text")))).alias("tokens")
    )
    whole = F.array(F.struct(F.lit(TOTALS).alias("term"), F.size("tokens").alias("tf")))
    counted = tokens.select(
        "object_id", "range", F.size("tokens").alias("doc_len"),
        F.explode(F.concat(whole, run_lengths(F.col("tokens")))).alias("p"),
    )
    blocks = counted.groupBy("p.term", "range").agg(
        F.count("*").alias("n"), F.sum("p.tf").alias("tokens"), F.max("p.tf").alias("max_tf"), F.min("doc_len").alias("min_len"),
        F.collect_list(F.struct("object_id", F.col("p.tf").alias("tf"), "doc_len")).alias("postings"),
    )
    blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.parquet(f"{folder}/blocks")
    stored = spark.read.parquet(f"{folder}/blocks")
    # The bounds are a small table of their own, so that choosing ranges reads no postings.
    stored.drop("postings").repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.parquet(
        f"{folder}/bounds"
    )
    bounds = spark.read.parquet(f"{folder}/bounds")
    bounds.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tokens").alias("tokens")).repartitionByRange(
        "term"
    ).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> LexicalIndex:
    blocks = spark.read.parquet(f"{folder}/blocks")
    return LexicalIndex(
        spark.read.parquet(f"{folder}/bounds"), blocks.select("term", "range", "postings"),
        spark.read.parquet(f"{folder}/terms"),
    )


def _gain(tf: Column, length: Column, k1: float, b: float) -> Column:
    tf = tf.cast("double")
    return F.col("idf") * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (length / F.col("avg_len")))))


def search(
    index: LexicalIndex, queries: DataFrame, k: int, k1: float = K1, b: float = B, first_ranges: int = FIRST_RANGES
) -> Found:
    """The ``k`` best documents per query with a positive BM25 score."""
    check_parameters(k1, b)
    if k < 0:
        raise ValueError("limit must not be negative")
    terms = cut_lineage(query_terms(queries).select("query_id", "term"))
    asked = terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()
    names = [r["term"] for r in asked] if len(asked) <= NAMED_TERMS else None

    def of_terms(table: DataFrame, *more: str) -> DataFrame:
        return table if names is None else table.where(F.col("term").isin([*names, *more]))

    weights = cut_lineage(term_weights(terms, of_terms(index.terms, TOTALS)))
    weights_side = small_side(weights)
    bounds = (
        of_terms(index.bounds).join(weights_side, "term")
        .groupBy("query_id", "range")
        .agg(F.sum(_gain(F.col("max_tf"), F.col("min_len"), k1, b)).alias("bound"), F.count("*").alias("blocks"))
    )

    def scored(ranges: DataFrame) -> DataFrame:
        pairs = small_side(ranges.select("query_id", "range"))
        blocks = of_terms(index.postings).join(weights_side, "term").join(pairs, ["query_id", "range"])
        postings = blocks.select("query_id", "idf", "avg_len", F.explode("postings").alias("p"))
        scores = postings.groupBy("query_id", F.col("p.object_id").alias("object_id")).agg(
            F.sum(_gain(F.col("p.tf"), F.col("p.doc_len"), k1, b)).alias("score")
        )
        return top_k(scores.where(F.col("score") > 0.0), k, ["query_id"]).select("query_id", "object_id", "score", "rank")

    first = cut_lineage(top_k(bounds, first_ranges, ["query_id"], "bound", "range").drop("rank"))
    best = cut_lineage(scored(first))
    threshold = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    reach = F.coalesce("least", F.lit(0.0)) * (1.0 - SLACK)
    more = (
        bounds.join(small_side(threshold), "query_id", "left").where(F.col("bound") >= reach)
        .join(small_side(first.select("query_id", "range")), ["query_id", "range"], "left_anti")
        .select("query_id", "range", "blocks")
    )
    more = cut_lineage(more)
    hits = top_k(best.drop("rank").unionByName(scored(more).drop("rank")), k, ["query_id"])
    read = first.select("query_id", "blocks").unionByName(more.select("query_id", "blocks"))
    blocks = (
        bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
        .join(read.groupBy("query_id").agg(F.sum("blocks").alias("blocks_read")), "query_id", "left")
    )
    return Found(hits.select("query_id", "object_id", "score", "rank"), blocks)
