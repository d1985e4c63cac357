"""Similarity of token sets without comparing all pairs: prefix, length and position filters.

All sets are put in one order, rare terms first. Two sets whose Jaccard similarity is at
least t share so many terms that some shared term lies in the first
``n - ceil(t n) + 1`` of each, their sizes differ by a factor of t at most, and what
follows their first shared term is long enough for the rest of the overlap. Only pairs
that meet on such a term are compared in full. Frequent terms, which would bring together
almost everything, come last and are hardly ever in a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.scale import cut_lineage, small_side, split_hot_join

# Rarest terms through which a best match is first looked for.
FIRST_TERMS = 6
# A term with more rows than this is joined by broadcast when sets are put in order.
HOT_TERM_ROWS = 100_000
ROUNDING = 1e-9


def ordered_sets(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``group_id, id, terms, size`` from distinct ``group_id, id, term`` rows.

    ``frequencies(term, df)`` gives the order; terms it doesn't hold come first.
    """
    known = split_hot_join(rows, frequencies.withColumn("weight", F.col("df")), "term", "weight", HOT_TERM_ROWS)
    absent = rows.join(small_side(frequencies.select("term")), "term", "left_anti").withColumn("df", F.lit(0).cast("long"))
    whole = known.unionByName(absent)
    return whole.groupBy("group_id", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda t: t["term"]).alias("terms"),
        F.count("*").alias("size"),
        F.count_if(F.col("df") == 0).alias("absent"),
    )


def term_frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def _needed(least: Column, size: Column) -> Column:
    """Shared terms that a set of ``size`` needs for similarity ``least``; at least one."""
    return F.greatest(F.ceil(least * size - ROUNDING), F.lit(1))


def _meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs that may reach the left set's ``least``; ``first_term`` and
    ``last_term`` bound the left places that are looked up."""
    least, size, other = F.col("least"), F.col("left_size"), F.col("right_size")
    asked = left.select(
        "group_id", F.col("id").alias("left_id"), F.col("size").alias("left_size"), "least", "first_term", "last_term",
        F.posexplode("terms").alias("left_place", "term"),
    ).where(
        (F.col("left_place") >= F.col("first_term")) & (F.col("left_place") < F.col("last_term"))
        & (F.col("left_place") <= size - _needed(least, size))
    ).drop("first_term", "last_term")
    offered = right.select(
        "group_id", F.col("id").alias("right_id"), F.col("size").alias("right_size"),
        F.posexplode("terms").alias("right_place", "term"),
    )
    overlap = _needed(least / (1 + least), size + other)
    rest = F.least(size - F.col("left_place"), other - F.col("right_place"))
    fits = (
        (other >= least * size - ROUNDING) & (size >= least * other - ROUNDING)
        & (F.col("right_place") <= other - _needed(least, other)) & (rest >= overlap)
    )
    return (
        offered.join(small_side(asked), ["group_id", "term"]).where(fits)
        .select("group_id", "left_id", "right_id").distinct()
    )


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``group_id, left_id, right_id, jaccard`` of pairs, by their whole sets."""
    a = left.select("group_id", F.col("id").alias("left_id"), F.col("terms").alias("left_terms"))
    b = right.select("group_id", F.col("id").alias("right_id"), F.col("terms").alias("right_terms"))
    common = F.size(F.array_intersect("left_terms", "right_terms"))
    return (
        pairs.join(small_side(a), ["group_id", "left_id"]).join(b, ["group_id", "right_id"])
        .select(
            "group_id", "left_id", "right_id",
            (common / (F.size("left_terms") + F.size("right_terms") - common)).alias("jaccard"),
        )
    )


def _both_sets(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    frequencies = cut_lineage(term_frequencies(right))
    return cut_lineage(ordered_sets(left, frequencies)), cut_lineage(ordered_sets(right, frequencies))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All ``group_id, left_id, right_id, jaccard`` with at least ``threshold``.

    Both sides are distinct ``group_id, id, term`` rows; only sets of one group meet.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be above 0 and at most 1")
    a, b = _both_sets(left, right)
    asked = a.withColumns({"least": F.lit(threshold), "first_term": F.lit(0), "last_term": F.col("size")})
    return _compared(_meetings(asked, b), a, b).where(F.col("jaccard") >= threshold - ROUNDING)


def most_similar(left: DataFrame, right: DataFrame, first_terms: int = FIRST_TERMS) -> DataFrame:
    """The most similar right set of each left set that shares a term with any; ties go
    to the smallest ``right_id``.

    The best match over the rarest terms that occur on the right bounds the search: only
    sets that may reach its similarity are looked for among the other terms.
    """
    a, b = _both_sets(left, right)
    start, stop = F.col("absent"), F.col("absent") + F.lit(first_terms)
    rare = a.withColumns({"least": F.lit(0.0), "first_term": start, "last_term": stop})
    order = F.struct(-F.round("jaccard", 12), F.col("right_id"))

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("group_id", "left_id").agg(F.min_by(F.struct("right_id", "jaccard"), order).alias("best")).select(
            "group_id", "left_id", "best.right_id", "best.jaccard"
        )

    first = cut_lineage(best(_compared(_meetings(rare, b), a, b)))
    found = first.select("group_id", F.col("left_id").alias("id"), F.col("jaccard").alias("known"))
    bounded = a.join(small_side(found), ["group_id", "id"], "left").withColumns(
        {"least": F.coalesce("known", F.lit(0.0)), "first_term": stop, "last_term": F.col("size")}
    )
    more = _compared(_meetings(bounded, b), a, b)
    return best(first.unionByName(more))
