"""BM25 over an inverted index that is restricted to the asked vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.text import lexical_tokens, run_lengths, token_counter
from seekspark.operators.dense import best_positions
from seekspark.operators.fusion import top_k
from seekspark.scale import cut_lineage, fits

K1 = 1.2
B = 0.75
# Every document carries one posting of this pseudo term; it holds the totals.
TOTALS = ""
# Pairs of a question and a document in one partition, at most, and the most partitions.
PAIRS_PER_PART = 500_000
MAX_PARTS = 20_000
# Scores that a task holds at a time, and pairs of a posting and a question behind them.
BLOCK_VALUES = 2_000_000


def check_parameters(k1: float, b: float) -> None:
    if not math.isfinite(k1) or k1 <= 0.0:
        raise ValueError("k1 must be finite and positive")
    if not math.isfinite(b) or not 0.0 <= b <= 1.0:
        raise ValueError("b must be between zero and one")


def postings(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``object_id, term, tf, doc_len``: counted inside each row, no shuffle."""
    counted = corpus.select(
        "object_id", F.explode(F.array(lexical_tokens(F.col(text)))).alias("tokens")
    ).select(
        "object_id",
        F.size("tokens").alias("doc_len"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(TOTALS).alias("term"), F.size("tokens").alias("tf"))),
                run_lengths(F.col("tokens")),
            )
        ).alias("posting"),
    )
    return counted.select("object_id", "posting.term", "posting.tf", "doc_len")


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query with their first position."""
    tokens = F.array_distinct(lexical_tokens(F.col("text")))
    return queries.select("query_id", F.posexplode(tokens).alias("position", "term"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    """``term, df, tokens``; the TOTALS row gives document and token counts.

    The conditions hold for every posting. They keep all columns in use, so both
    readers of the index share one exchange instead of tokenizing twice.
    """
    real = F.col("object_id").isNotNull() & (F.col("tf") >= 0) & (F.col("doc_len") >= 0)
    return index.groupBy("term").agg(
        F.count_if(real).alias("df"), F.sum("tf").alias("tokens")
    )


def term_weights(terms: DataFrame, statistics: DataFrame) -> DataFrame:
    """Attach idf and the average length to each query term."""
    totals = statistics.select(
        F.when(F.col("term") == TOTALS, F.col("df")).alias("n"),
        F.when(F.col("term") == TOTALS, F.col("tokens")).alias("all_tokens"),
    ).agg(F.max("n").alias("n"), F.max("all_tokens").alias("all_tokens"))
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    return (
        terms.join(statistics, "term")
        .join(F.broadcast(totals))  # exactly one row
        .select(
            "query_id",
            "term",
            F.log(1.0 + (n - df + 0.5) / (df + 0.5)).alias("idf"),
            (F.col("all_tokens") / n).alias("avg_len"),
        )
    )


def score_parts(documents: DataFrame, queries: DataFrame) -> int:
    """Partitions of the documents that bound the scores of each.

    Adaptive execution would merge partitions by the bytes of their postings, but in the
    next step a posting becomes a row for every question that has its term.
    """
    pairs = documents.count() * queries.count()
    least = documents.sparkSession.sparkContext.defaultParallelism
    return min(max(-(-pairs // PAIRS_PER_PART), least), MAX_PARTS)


def bm25_scores(
    corpus: DataFrame,
    queries: DataFrame,
    k1: float = K1,
    b: float = B,
    index: DataFrame | None = None,
) -> DataFrame:
    """Positive BM25 scores ``query_id, object_id, score``.

    ``index`` may be a stored posting table; otherwise it is built from ``corpus``.
    Postings outside the asked vocabulary are dropped before the only exchange of
    postings, which is keyed by document: statistics, scores and per-partition
    top-k all run on that one partitioning.
    """
    check_parameters(k1, b)
    terms = query_terms(queries)
    vocabulary = terms.select("term").union(
        queries.sparkSession.range(1).select(F.lit(TOTALS))
    ).distinct()
    small = fits(terms)
    hint = F.broadcast if small else (lambda df: df)
    source = postings(corpus) if index is None else index
    documents = corpus if index is None else index.where(F.col("term") == TOTALS)
    asked = (
        source.join(hint(vocabulary), "term", "left_semi")
        .select("object_id", "term", "tf", "doc_len")
        .repartition(score_parts(documents.select("object_id"), queries.select("query_id")), "object_id")
    )
    weights = term_weights(terms, corpus_statistics(asked))
    tf = F.col("tf").cast("double")
    length = F.col("doc_len") / F.col("avg_len")
    part = F.col("idf") * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length)))
    scored = (
        asked.join(hint(weights), "term")
        .groupBy("query_id", "object_id")
        .agg(F.sum(part).alias("score"))
    )
    return scored.where(F.col("score") > 0.0)


def bm25_top_k(
    corpus: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B,
    index: DataFrame | None = None, blocks: bool = False,
) -> DataFrame:
    """The ``k`` best documents per query with a positive score.

    With ``blocks``, while the questions' terms are few enough to ship, each task scores
    blocks of documents of ``corpus`` and returns k rows per question; then no row per
    question and document is made, but the counts of the asked terms are stored.
    """
    check_parameters(k1, b)
    terms = query_terms(queries).select("query_id", "term")
    if not blocks or index is not None or k < 1 or not fits(terms):
        return top_k(bm25_scores(corpus, queries, k1, b, index), k, ["query_id"])
    return top_k(_local_top(corpus, terms, k, k1, b), k, ["query_id"])


def _asked_counts(corpus: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """``object_id, doc_len, terms, tfs`` of every document with a text: the numbers of the
    asked terms in it, in order, and their counts."""
    shipped = corpus.sparkSession.sparkContext.broadcast(numbers)
    kind, size = corpus.schema["object_id"], max(len(numbers), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(shipped.value)
        for batch in batches:
            sizes, found, held = [], [], []
            for text in batch.column("text").to_pylist():
                length, asked = counter(text)
                sizes.append(length)
                found += asked
                held.append(len(asked))
            doc = np.repeat(np.arange(len(held)), held)
            pair, tf = np.unique(doc * size + np.array(found, np.int64), return_counts=True)
            doc, term = np.divmod(pair, size)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(held)))]), pa.int32())
            terms, tfs = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (term, tf))
            yield pa.RecordBatch.from_arrays(
                [batch.column("object_id"), pa.array(sizes, pa.int32()), terms, tfs],
                names=["object_id", "doc_len", "terms", "tfs"],
            )

    whole = corpus.where(F.col("text").isNotNull()).select("object_id", "text")
    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("terms", "tfs")]
    return whole.mapInArrow(count, T.StructType([kind, T.StructField("doc_len", T.IntegerType()), *fields]))


def _local_top(corpus: DataFrame, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """At least the ``k`` best of each question, ``query_id, object_id, score``: counts are
    taken once and stored by document, then scored in blocks against all questions."""
    asked = terms.collect()
    names, vocabulary = ({v: n for n, v in enumerate(dict.fromkeys(r[c] for r in asked))} for c in ("query_id", "term"))
    question = np.array([names[r["query_id"]] for r in asked], np.int64)
    term = np.array([vocabulary[r["term"]] for r in asked], np.int64)
    counts = _asked_counts(corpus, vocabulary)
    stored = cut_lineage(counts.repartition("object_id").sortWithinPartitions("object_id"))
    real = F.col("object_id").isNotNull()
    total = stored.agg(F.count_if(real).alias("n"), F.sum("doc_len").alias("tokens")).first()
    held = stored.where(real).select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    df = np.zeros(len(vocabulary))
    df[held["term"].to_numpy(int)] = held["count"]
    idf = np.log(1.0 + (total["n"] - df + 0.5) / (df + 0.5))
    mean = total["tokens"] / total["n"] if total["n"] else 0.0
    # The questions of term t are asking[first[t] : first[t + 1]].
    asking = question[np.argsort(term, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    shipped = corpus.sparkSession.sparkContext.broadcast((list(names), asking, first, idf, mean))
    query_type, object_type = terms.schema["query_id"].dataType, corpus.schema["object_id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asking, first, idf, mean = shipped.value
        best: list = [None] * len(names)
        floor = np.full(len(names), np.finfo(float).tiny)
        arrow = None
        for ids, doc, terms, tf, length in _document_blocks(batches, max(BLOCK_VALUES // max(len(names), 1), 1)):
            arrow = ids.type
            part = idf[terms] * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean)))
            scores = np.zeros(len(ids) * len(names))
            askers = first[terms + 1] - first[terms]
            ends = np.cumsum(askers)
            begin = 0
            while begin < len(terms):  # a slice of postings with bounded pairs, one posting at least
                before = ends[begin - 1] if begin else 0
                end = max(int(np.searchsorted(ends, before + BLOCK_VALUES, "right")), begin + 1)
                n = askers[begin:end]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[terms[begin:end]], n)
                cell = np.repeat(doc[begin:end] * len(names), n) + asking[place]
                np.add.at(scores, cell, np.repeat(part[begin:end], n))
                begin = end
            table = scores.reshape(len(ids), len(names))
            at, of = np.nonzero(table >= floor)
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            for q, own in zip(np.unique(of), np.split(at, np.flatnonzero(np.diff(of)) + 1)):
                values, rows = table[own, q], ids.take(pa.array(own)).to_pylist()
                if best[q] is not None:  # earlier documents of the task come first
                    values, rows = np.concatenate([best[q][1], values]), best[q][0] + rows
                keep = best_positions(values, k)
                best[q] = [rows[i] for i in keep], values[keep]
                if len(keep) == k:
                    floor[q] = max(values[keep].min() - 1e-11, np.finfo(float).tiny)
        found = [(name, pair) for name, pair in zip(names, best) if pair is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name for name, pair in found for _ in pair[0]]),
                    pa.array([i for _, pair in found for i in pair[0]], arrow),
                    pa.array(np.concatenate([pair[1] for _, pair in found])),
                ],
                names=["query_id", "object_id", "score"],
            )

    fields = [("query_id", query_type), ("object_id", object_type), ("score", T.DoubleType())]
    return stored.mapInArrow(score, T.StructType([T.StructField(*field) for field in fields]))


def _document_blocks(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[tuple]:
    """Blocks of about so many documents, in order: their ids, and per posting the place of
    its document, its term, count and document length. Rows of one id are one document; only
    the last document of a batch may go on and is carried over."""
    rest = None

    def block(rows: pa.Table):
        ids = rows.column("object_id").combine_chunks()
        plain = ids.to_numpy(zero_copy_only=False)
        new = np.ones(len(plain), bool)
        new[1:] = plain[1:] != plain[:-1]
        if ids.null_count:  # a null is one document, too
            none = ids.is_null().to_numpy(zero_copy_only=False)
            new[1:] &= ~(none[1:] & none[:-1])
        lists = rows.column("terms").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        length = np.repeat(rows.column("doc_len").to_numpy().astype(float), size)
        return ids.filter(pa.array(new)), np.repeat(np.cumsum(new) - 1, size), terms, tf, length, np.flatnonzero(new)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        starts = block(rows)[-1]
        cuts = [*starts[:-1:documents], starts[-1]] if len(starts) else [0]
        for a, z in zip(cuts, cuts[1:]):
            yield block(rows.slice(a, z - a))[:-1]
        rest = rows.slice(cuts[-1]) if len(rows) else None
    if rest is not None and len(rest):
        yield block(rest)[:-1]
