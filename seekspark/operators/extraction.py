"""Salvage validation of untrusted extraction completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.functions.ids import stable_id
from seekspark.functions.text import (
    casefold, normalize_alias, normalize_entity_type, strict_json_object, strip_code_fence,
    verbatim_span,
)

# --- fixed values: record limits and shapes ----------------------------------
MAX_ENTITIES = 24
MAX_RECORDS = 64
MAX_ALIASES = 12
MAX_QUOTE = 8000
ENTITY_SHAPE = (
    r"^OBJECT<(?:aliases: ARRAY<(?:STRING|VOID)>, )?description: STRING, entity_type: STRING, "
    r"evidence_quotes: ARRAY<STRING>, name: STRING, ref: STRING>$"
)
RELATION_SHAPE = (
    r"^OBJECT<description: STRING, evidence_quotes: ARRAY<STRING>, predicate: STRING, "
    r"source_ref: STRING, target_ref: STRING>$"
)
REF = r"^e[1-9][0-9]*$"
PREDICATE = r"^[A-Z][A-Z0-9_]{0,79}$"
# -----------------------------------------------------------------------------

ENTITY_SCHEMA = (
    "ref string, name string, entity_type string, description string, "
    "aliases array<string>, evidence_quotes array<string>"
)
RELATION_SCHEMA = (
    "source_ref string, target_ref string, predicate string, description string, "
    "evidence_quotes array<string>"
)


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _sized(value: Column, longest: int) -> Column:
    return F.length(value).between(1, longest)


def classify_completions(completions: DataFrame) -> DataFrame:
    """Add ``payload`` (the JSON text to read) and ``failure`` (NULL when usable).

    A strict object is read as it is; otherwise code fences are removed. Repairing
    broken JSON beyond that is left to an injected client.
    """
    bare = strip_code_fence(F.col("content"))
    payload = F.when(strict_json_object(F.col("content")), F.col("content")).otherwise(bare)
    ready = completions.withColumn("payload", payload)
    parsed = F.try_parse_json("payload")
    kind = F.schema_of_variant(parsed)
    failure = (
        F.when(F.col("finish_reason") == "content_filter", "content_filtered")
        .when(F.col("finish_reason") == "insufficient_system_resource", "retryable_provider_finish")
        .when(F.col("content").isNull() | (F.length(_strip(F.col("content"))) == 0), "empty_content")
        .when(parsed.isNull(), "invalid_json")
        .when(~kind.startswith("OBJECT"), "schema_invalid")
    )
    return ready.withColumn("failure", failure)


def _records(usable: DataFrame, field: str) -> DataFrame:
    listed = F.from_json("payload", f"{field} array<string>")[field]
    return usable.select(
        "extraction_id", "chunk_id", "chunk_text",
        F.posexplode(listed).alias("index", "raw"),
    )


def _located(typed: DataFrame) -> DataFrame:
    """``verbatim`` and the ``span`` of the quote instead of the chunk's text, which would
    otherwise be exchanged and stored with each record."""
    return typed.withColumns({
        "verbatim": F.contains("chunk_text", "quote"), "span": verbatim_span(F.col("quote"), F.col("chunk_text")),
    }).drop("chunk_text")


def validate_entities(usable: DataFrame) -> DataFrame:
    """One row per raw entity with ``reason`` NULL when accepted."""
    raw = _records(usable, "entities")
    shape = F.schema_of_variant(F.try_parse_json("raw"))
    typed = raw.withColumn("r", F.from_json("raw", ENTITY_SCHEMA)).select(
        "extraction_id", "chunk_id", "chunk_text", "index",
        shape.alias("shape"),
        _strip(F.col("r.ref")).alias("ref"),
        _strip(F.col("r.name")).alias("name"),
        normalize_entity_type(F.col("r.entity_type")).alias("entity_type"),
        _strip(F.col("r.description")).alias("description"),
        F.coalesce(
            F.transform("r.aliases", _strip), F.array().cast("array<string>")
        ).alias("aliases"),
        _strip(F.get("r.evidence_quotes", F.lit(0))).alias("quote"),
        F.size("r.evidence_quotes").alias("quotes"),
    )
    aliases_ok = (
        (F.size("aliases") <= MAX_ALIASES)
        & F.forall("aliases", lambda a: _sized(a, 300))
        & (F.size(F.array_distinct(F.transform("aliases", casefold))) == F.size("aliases"))
    )
    schema_ok = (
        F.col("shape").rlike(ENTITY_SHAPE)
        & F.col("ref").rlike(REF)
        & _sized(F.col("name"), 300)
        & F.col("entity_type").isNotNull()
        & _sized(F.col("description"), 4000)
        & (F.col("quotes") == 1)
        & _sized(F.col("quote"), MAX_QUOTE)
        & aliases_ok
    )
    checked = _located(typed).withColumn("schema_ok", F.coalesce(schema_ok, F.lit(False)))
    within = F.col("index") < MAX_ENTITIES
    good = within & F.col("schema_ok") & F.col("verbatim")
    same_ref = Window.partitionBy("extraction_id", "ref").orderBy("index")
    first = F.min(F.when(good, F.col("index"))).over(
        same_ref.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    reason = (
        F.when(~within, "over_limit")
        .when(~F.col("schema_ok"), "schema")
        .when(first < F.col("index"), "duplicate_ref")
        .when(~F.col("verbatim"), "not_verbatim")
    )
    return checked.withColumn("reason", reason).withColumn(
        "mention_id", stable_id("emn", F.col("extraction_id"), F.col("ref"))
    )


def validate_relations(usable: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per raw relation with ``reason`` NULL when accepted."""
    accepted = entities.where(F.col("reason").isNull())
    room = accepted.groupBy("extraction_id").agg(F.count("*").alias("taken"))
    raw = _records(usable, "relations")
    has_aliases = F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT<aliases:")
    shape = F.regexp_replace(
        F.schema_of_variant(F.try_parse_json("raw")), r"^OBJECT<aliases: (?:ARRAY<[^>]*>|\w+), ", "OBJECT<"
    )
    typed = raw.withColumn("r", F.from_json("raw", RELATION_SCHEMA)).select(
        "extraction_id", "chunk_id", "chunk_text", "index",
        shape.alias("shape"), has_aliases.alias("sanitized"),
        _strip(F.col("r.source_ref")).alias("source_ref"),
        _strip(F.col("r.target_ref")).alias("target_ref"),
        _strip(F.col("r.predicate")).alias("predicate"),
        _strip(F.col("r.description")).alias("description"),
        _strip(F.get("r.evidence_quotes", F.lit(0))).alias("quote"),
        F.size("r.evidence_quotes").alias("quotes"),
    )
    refs = accepted.select("extraction_id", "ref", "mention_id")

    def end(side: str) -> DataFrame:
        return refs.select(
            "extraction_id", F.col("ref").alias(f"{side}_ref"), F.col("mention_id").alias(f"{side}_mention_id")
        )

    joined = (
        _located(typed).join(room, "extraction_id", "left")
        .join(end("source"), ["extraction_id", "source_ref"], "left")
        .join(end("target"), ["extraction_id", "target_ref"], "left")
    )
    schema_ok = (
        F.col("shape").rlike(RELATION_SHAPE)
        & F.col("source_ref").rlike(REF)
        & F.col("target_ref").rlike(REF)
        & F.col("predicate").rlike(PREDICATE)
        & _sized(F.col("description"), 4000)
        & (F.col("quotes") == 1)
        & _sized(F.col("quote"), MAX_QUOTE)
    )
    checked = joined.select(
        "*",
        F.coalesce(schema_ok, F.lit(False)).alias("schema_ok"),
        (F.col("index") < MAX_RECORDS - F.coalesce("taken", F.lit(0))).alias("within"),
        (F.col("source_mention_id").isNotNull() & F.col("target_mention_id").isNotNull()).alias("linked"),
    )
    loop = F.col("source_ref") == F.col("target_ref")
    good = F.col("within") & F.col("schema_ok") & ~loop & F.col("linked") & F.col("verbatim")
    same = Window.partitionBy("extraction_id", "source_ref", "target_ref", "predicate")
    first = F.min(F.when(good, F.col("index"))).over(same)
    reason = (
        F.when(~F.col("within"), "over_limit")
        .when(~F.col("schema_ok"), "schema")
        .when(loop, "self_relation")
        .when(~F.col("linked"), "missing_endpoint")
        .when(first < F.col("index"), "duplicate_relation")
        .when(~F.col("verbatim"), "not_verbatim")
    )
    return checked.withColumn("reason", reason).withColumn(
        "mention_id",
        stable_id(
            "rmn", F.col("extraction_id"), F.col("index"), F.col("source_mention_id"),
            F.col("target_mention_id"), F.col("predicate"),
        ),
    )


def accepted_mentions(records: DataFrame) -> DataFrame:
    """Accepted records with the offsets of their evidence quote."""
    return records.where(F.col("reason").isNull())


def extraction_quality(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Raw, accepted, dropped and sanitized record counts over all completions."""
    kept = F.col("reason").isNull()
    left = entities.select("extraction_id", F.lit("e").alias("kind"), kept.alias("kept"), F.lit(False).alias("sanitized"))
    right = relations.select("extraction_id", F.lit("r").alias("kind"), kept.alias("kept"), "sanitized")
    entity, relation = F.col("kind") == "e", F.col("kind") == "r"
    per_chunk = left.unionByName(right).groupBy("extraction_id").agg(
        F.count_if(entity).alias("raw_entities"),
        F.count_if(entity & F.col("kept")).alias("accepted_entities"),
        F.count_if(relation).alias("raw_relations"),
        F.count_if(relation & F.col("kept")).alias("accepted_relations"),
        F.count_if(F.col("sanitized")).alias("sanitized_relation_records"),
    )
    total = [F.sum(c).alias(c) for c in per_chunk.columns if c != "extraction_id"]
    dropped_e = F.col("raw_entities") - F.col("accepted_entities")
    dropped_r = F.col("raw_relations") - F.col("accepted_relations")
    return per_chunk.agg(
        *total,
        F.sum(dropped_e).alias("dropped_entities"),
        F.sum(dropped_r).alias("dropped_relations"),
        F.count_if((dropped_e > 0) | (dropped_r > 0)).alias("chunks_with_drops"),
    )


def fact_signatures(mentions: DataFrame) -> DataFrame:
    """Comparable entity facts of an extraction: one hash per fact."""
    ordered = F.array_sort(F.transform("aliases", lambda a: F.struct(casefold(a), a)))
    return mentions.select(
        "extraction_id",
        F.sha2(
            F.to_json(
                F.struct(
                    normalize_alias(F.col("name")), "entity_type", "description",
                    ordered, "quote",
                )
            ),
            256,
        ).alias("fact"),
    ).distinct()


def glean_audit(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per extraction: does the candidate keep every baseline fact, and what does it add?

    ``baseline`` and ``candidate`` are distinct ``extraction_id, fact`` rows.
    """
    sides = baseline.select("extraction_id", "fact", F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        candidate.select("extraction_id", "fact", F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    facts = sides.groupBy("extraction_id", "fact").agg(F.max("b").alias("b"), F.max("c").alias("c"))
    counted = facts.groupBy("extraction_id").agg(
        F.sum("b").alias("baseline_facts"),
        F.sum("c").alias("candidate_facts"),
        F.count_if((F.col("b") == 1) & (F.col("c") == 0)).alias("lost"),
        F.count_if((F.col("b") == 0) & (F.col("c") == 1)).alias("added"),
    )
    accepted = F.col("lost") == 0
    return counted.select(
        "extraction_id", "baseline_facts", "candidate_facts",
        accepted.alias("accepted"),
        F.when(accepted, F.col("added")).otherwise(F.lit(0)).alias("added_facts"),
    )
