"""Entity resolution and relation merging over mention tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.functions.ids import stable_id
from seekspark.functions.text import exact_casefold, nfkc, normalize_alias, normalize_predicate
from seekspark.operators.fusion import budget_fold
from seekspark.operators.graph import connected_components

MAX_DESCRIPTION_CHARS = 4000


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; must be empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def most_frequent(df: DataFrame, by: str, value: str, *tie: str) -> DataFrame:
    """Most frequent value per key, ties by the given order; two partial aggregates."""
    counted = df.groupBy(by, value, *[c for c in tie if c != value]).agg(
        F.count("*").alias("n")
    )
    order = F.struct((-F.col("n")).alias("n"), *(tie or (value,)))
    return counted.groupBy(by).agg(F.min_by(value, order).alias(value))


def merge_descriptions(df: DataFrame, key: str, description: str = "description") -> DataFrame:
    """Distinct texts, longest first, that together fit 4000 characters with newlines.

    Of texts with length L at most 4001 / (L + 1) can ever be kept, and they are the
    first in order. Dropping the rest first bounds the array per key exactly, even
    for a key that owns a third of all rows.
    """
    limit = MAX_DESCRIPTION_CHARS + 1
    texts = df.select(
        key,
        F.col(description).alias("value"),
        F.length(description).alias("size"),
        F.lower(description).alias("folded"),
    ).distinct()
    order = Window.partitionBy(key, "size").orderBy("folded", "value")
    bounded = (
        texts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .where(F.col("rank") <= F.greatest(F.floor(F.lit(limit) / (F.col("size") + 1)), F.lit(1)))
    )
    packed = bounded.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("size")).alias("negative"),
                    "folded",
                    "value",
                    (F.col("size") + 1).cast("long").alias("cost"),
                )
            )
        ).alias("items")
    )
    kept = F.transform(budget_fold(F.col("items"), "cost", limit), lambda item: item["value"])
    first = F.substring(F.get("items", F.lit(0))["value"], 1, MAX_DESCRIPTION_CHARS)
    return packed.select(
        key,
        F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(first).alias(description),
    )


def spelled_names(mentions: DataFrame) -> DataFrame:
    """One row per mention and spelling: its name and its aliases."""
    return mentions.select(
        "mention_id",
        F.explode(
            F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        ).alias("spelling"),
    )


def mention_groups(mentions: DataFrame) -> DataFrame:
    """``mention_id, entity_group``: mentions linked by shared normalized aliases."""
    links = spelled_names(mentions).select(
        F.concat(F.lit("m:"), F.col("mention_id").cast("string")).alias("src"),
        normalize_alias(F.col("spelling")).alias("alias"),
    )
    edges = links.where(F.length("alias") > 0).select(
        "src", F.concat(F.lit("x:"), F.col("alias")).alias("dst")
    )
    groups = connected_components(edges)
    return groups.where(F.col("node").startswith("m:")).select(
        F.substring("node", 3, 1 << 20).alias("mention_id"),
        F.col("component").alias("entity_group"),
    )


def resolve_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical entities, the mention assignment, and the alias rows.

    ``mentions(mention_id, name, entity_type, description, aliases)``. Aliases and
    sources stay rows: an entity may own any number of them.
    """
    groups = mention_groups(mentions)
    members = mentions.withColumn("mention_id", F.col("mention_id").cast("string")).join(
        groups, "mention_id"
    )
    named = members.select(
        "mention_id", "entity_group", "name", "entity_type", "description",
        normalize_alias(F.col("name")).alias("name_key"),
        exact_casefold(F.col("name")).alias("folded"),
    )
    keys = most_frequent(named, "entity_group", "name_key")
    shown = named.join(keys, ["entity_group", "name_key"])
    names = most_frequent(shown, "entity_group", "name", "folded", "name")
    types = most_frequent(named, "entity_group", "entity_type")
    entities = (
        keys.join(names, "entity_group")
        .join(types, "entity_group")
        .join(merge_descriptions(named, "entity_group"), "entity_group")
        .select(
            stable_id("ent", F.col("name_key")).alias("entity_id"),
            "entity_group",
            F.col("name").alias("canonical_name"),
            F.col("name_key").alias("normalized_name"),
            "entity_type",
            "description",
        )
    )
    assignment = members.select("mention_id", "entity_group").join(
        entities.select("entity_group", "entity_id"), "entity_group"
    ).select("mention_id", "entity_id")
    aliases = (
        distinct_spellings(
            spelled_names(mentions)
            .withColumn("mention_id", F.col("mention_id").cast("string"))
            .join(assignment, "mention_id"),
            "entity_id",
        )
        .join(entities.select("entity_id", "canonical_name"), "entity_id")
        .where(F.col("spelling") != F.col("canonical_name"))
        .select("entity_id", F.col("spelling").alias("alias"))
    )
    return entities.drop("entity_group"), assignment, aliases


def distinct_spellings(df: DataFrame, key: str, value: str = "spelling") -> DataFrame:
    """One spelling per compatibility form and key: the smallest without case."""
    forms = df.select(key, value, nfkc(F.col(value)).alias("form"), exact_casefold(F.col(value)).alias("folded"))
    best = forms.groupBy(key, "form").agg(F.min(F.struct("folded", value)).alias("best"))
    return best.select(key, F.col(f"best.{value}").alias(value))


def merge_relations(relation_mentions: DataFrame, assignment: DataFrame) -> DataFrame:
    """Directed relations per (source, target, predicate) with merged description."""
    located = locate_endpoints(relation_mentions, assignment).withColumn(
        "predicate", normalize_predicate(F.col("predicate"))
    )
    keyed = located.withColumn(
        "relation_id",
        stable_id("rel", F.col("source_entity_id"), F.col("target_entity_id"), F.col("predicate")),
    )
    heads = keyed.groupBy(
        "relation_id", "source_entity_id", "target_entity_id", "predicate"
    ).agg(F.count("*").alias("mentions"))
    return heads.join(merge_descriptions(keyed, "relation_id"), "relation_id")


def locate_endpoints(relation_mentions: DataFrame, assignment: DataFrame) -> DataFrame:
    """Replace both mention ends by entities; an unknown mention is an error."""
    source = assignment.select(
        F.col("mention_id").alias("source_mention_id"), F.col("entity_id").alias("source_entity_id")
    )
    target = assignment.select(
        F.col("mention_id").alias("target_mention_id"), F.col("entity_id").alias("target_entity_id")
    )
    joined = relation_mentions.join(source, "source_mention_id", "left").join(
        target, "target_mention_id", "left"
    )
    known = F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()
    checked = F.when(known, F.col("source_entity_id")).otherwise(
        F.raise_error(F.lit("relation mention references an unknown entity mention"))
    )
    return joined.withColumn("source_entity_id", checked)


def distinct_evidence(spans: DataFrame, key: str) -> DataFrame:
    """Evidence rows per object without repetitions."""
    return spans.select(key, "chunk_id", "char_start", "char_end", "quote").distinct()


def source_chunks(spans: DataFrame, key: str) -> DataFrame:
    return spans.select(key, "chunk_id").distinct()
