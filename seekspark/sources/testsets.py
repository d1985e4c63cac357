"""Versioned test sets: a checked reader, and a writer whose result appears at once.

A test set is an envelope with a schema version, the hash of the corpus it was made for,
its cases and optionally their public sources. Two forms are read: one JSON document, and
the folder that ``write_testset`` makes, where the envelope is a small file and the cases
are JSON lines in any number of files. Every case is checked against the schema of its
version by column rules; the first violation stops the job that reads it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.storage.files import SharedFiles

# --- fixed values ------------------------------------------------------------
VERSIONS = ("1", "2")
TEXT_FIELDS = ("user_input", "reference")
LIST_FIELDS = ("reference_contexts",)
TEXT_FIELDS_2 = ("question_type", "generator_model", "prompt_version", "review_status")
LIST_FIELDS_2 = ("evidence_ids", "context_evidence_ids", "document_ids", "evidence_quotes")
FLAG_FIELDS_2 = ("answerable",)
SOURCE_TEXTS = ("source_uri", "filename", "title", "venue", "pages", "official_url", "rights_notice")
CORPUS_HASH = re.compile(r"[a-f0-9]{64}")
# -----------------------------------------------------------------------------
ENVELOPE = "ENVELOPE"


@dataclass
class TestSet:
    """``cases`` has ``case_index`` (from 1) and the fields of its schema version."""

    __test__ = False

    schema_version: str
    corpus_content_hash: str
    file_sha256: str
    cases: DataFrame
    sources: list[dict]


def checked_hash(value: object, field: str = "corpus_content_hash") -> str:
    if not isinstance(value, str) or not CORPUS_HASH.fullmatch(value.strip()):
        raise ValueError(f"{field} must be a 64-character hexadecimal digest in lowercase")
    return value.strip()


def checked_sources(values: object) -> list[dict]:
    """Public sources with all fields, unique addresses and an HTTPS link."""
    if not isinstance(values, list) or not values:
        raise ValueError("sources must be a non-empty JSON array")
    seen: set[str] = set()
    for number, source in enumerate(values, 1):
        texts = [source.get(name) for name in SOURCE_TEXTS] if isinstance(source, dict) else [None]
        authors = source.get("authors") if isinstance(source, dict) else None
        if not all(isinstance(t, str) and t.strip() for t in [*texts, *(authors or [None])]):
            raise ValueError(f"source {number} lacks a text or an author")
        if type(source.get("year")) is not int or source["year"] < 1900:
            raise ValueError(f"source {number} year must be a valid integer")
        if not source["official_url"].strip().startswith("https://"):
            raise ValueError(f"source {number} official_url must use HTTPS")
        if source["source_uri"].strip() in seen:
            raise ValueError(f"source {number} repeats a source_uri")
        seen.add(source["source_uri"].strip())
    return values


def _fields(version: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    if version == "1":
        return TEXT_FIELDS, LIST_FIELDS, ()
    return (*TEXT_FIELDS, *TEXT_FIELDS_2), (*LIST_FIELDS, *LIST_FIELDS_2), FLAG_FIELDS_2


def _schema(version: str) -> str:
    texts, lists, flags = _fields(version)
    return ", ".join([f"{n} string" for n in texts] + [f"{n} array<string>" for n in lists] + [f"{n} boolean" for n in flags])


def _violation(raw: Column, version: str) -> Column:
    """What is wrong with the JSON text of a case; null if nothing is.

    Types are taken from the JSON itself, as reading would turn numbers into text.
    """
    value = F.try_parse_json(raw)

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("missing"))

    texts, lists, flags = _fields(version)
    problem = F.when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.lit("must be an object"))
    for name in texts:
        filled = F.length(F.trim(F.try_variant_get(value, f"$.{name}", "string"))) > 0
        problem = problem.when((kind(name) != "STRING") | ~filled, F.lit(f"has no {name}"))
    for name in lists:
        problem = problem.when(~kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"{name} must be a list of texts"))
        problem = problem.when(
            F.exists(F.from_json(F.try_variant_get(value, f"$.{name}", "string"), "array<string>"), lambda t: t.isNull()),
            F.lit(f"{name} must be a list of texts"),
        )
    for name in flags:
        problem = problem.when(kind(name) != "BOOLEAN", F.lit(f"{name} must be true or false"))
    return problem


def _checked_cases(raw: DataFrame, version: str) -> DataFrame:
    """``case_index`` and fields from ``case_index, raw``; a bad case is an error."""
    message = F.concat(F.lit("test set item "), F.col("case_index").cast("string"), F.lit(" "), "problem")
    guarded = raw.withColumn("problem", _violation(F.col("raw"), version)).withColumn(
        "raw", F.when(F.col("problem").isNotNull(), F.raise_error(message)).otherwise(F.col("raw"))
    )
    return guarded.select("case_index", F.from_json("raw", _schema(version)).alias("c")).select("case_index", "c.*")


def read_testset(
    spark: SparkSession, path: str, versions: tuple[str, ...] = VERSIONS, corpus_hash: str | None = None
) -> TestSet:
    """A test set of one of ``versions``; if ``corpus_hash`` is given, it must be its own."""
    files = SharedFiles(spark)
    folder = path.rstrip("/")
    stored = files.read(f"{folder}/{ENVELOPE}") if files.exists(f"{folder}/{ENVELOPE}") else None
    if stored is None:
        row = spark.read.text(path, wholetext=True).select(
            F.substring(F.ltrim("value"), 1, 1).alias("first"), F.sha2("value", 256).alias("sha"),
            F.from_json("value", "schema_version string, corpus_content_hash string, sources string").alias("e"),
            F.schema_of_variant(F.try_parse_json("value")).alias("kind"),
            F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.cases", "variant")).alias("cases"),
        ).first()
        if row is None or row["kind"] is None:
            raise ValueError(f"unable to read test set {path}")
        if row["first"] == "[":
            raise ValueError("a test set must be an envelope; bare JSON arrays are unsupported")
        if not row["kind"].startswith("OBJECT"):
            raise ValueError("a test set must be a JSON object envelope")
        head = {**row["e"].asDict(), "sha": row["sha"]}
        head["sources"] = json.loads(head["sources"]) if head["sources"] else None
        listed = row["cases"] is not None and row["cases"].startswith("ARRAY")
    else:
        head = {**json.loads(stored), "sha": hashlib.sha256(stored.encode()).hexdigest()}
        listed = True
    version = head.get("schema_version")
    if version not in versions:
        raise ValueError(f"unsupported test set schema_version {version!r}; expected one of {sorted(versions)}")
    found_hash = checked_hash(head.get("corpus_content_hash"))
    if corpus_hash is not None and found_hash != checked_hash(corpus_hash, "profile corpus_content_hash"):
        raise ValueError("the test set was made for another corpus")
    if not listed:
        raise ValueError("test set cases must be a non-empty JSON array")
    sources = checked_sources(head["sources"]) if head.get("sources") is not None else []
    if stored is None:
        whole = spark.read.text(path, wholetext=True)
        parts = F.posexplode(F.from_json("value", "cases array<string>")["cases"])
        raw = whole.select(parts.alias("place", "raw")).select((F.col("place") + 1).cast("long").alias("case_index"), "raw")
    else:
        lines = spark.read.text(f"{folder}/{head['data']}")
        raw = lines.select(F.get_json_object("value", "$.case_index").cast("long").alias("case_index"), F.col("value").alias("raw"))
    if raw.isEmpty():
        raise ValueError("test set cases must be a non-empty JSON array")
    return TestSet(version, found_hash, head["sha"], _checked_cases(raw, version), sources)


def write_testset(
    cases: DataFrame, path: str, corpus_hash: str, version: str = "2", sources: list[dict] | None = None,
    overwrite: bool = False,
) -> str:
    """Write ``cases(case_index, ...)`` as a test set folder; returns the hash of its envelope.

    Cases are checked as they are written. The envelope names the data folder and is put in
    place last, by one rename: readers see the whole new set, or the one before it.
    """
    if version not in VERSIONS:
        raise ValueError(f"unsupported test set schema_version {version!r}")
    corpus_hash = checked_hash(corpus_hash)
    files, folder, data = SharedFiles(cases.sparkSession), path.rstrip("/"), f"data-{uuid.uuid4().hex[:12]}"
    texts, lists, flags = _fields(version)
    body = F.to_json(F.struct("case_index", *sorted([*texts, *lists, *flags])))
    raw = cases.select("case_index", body.alias("raw"))
    message = F.concat(F.lit("test set item "), F.col("case_index").cast("string"), F.lit(" "), "problem")
    checked = raw.withColumn("problem", _violation(F.col("raw"), version)).select(
        F.when(F.col("problem").isNotNull(), F.raise_error(message)).otherwise(F.col("raw")).alias("value")
    )
    checked.write.text(f"{folder}/{data}")
    envelope = {"schema_version": version, "corpus_content_hash": corpus_hash, "data": data}
    if sources is not None:
        envelope["sources"] = checked_sources(sources)
    text = json.dumps(envelope, sort_keys=True, ensure_ascii=False)
    if cases.sparkSession.read.text(f"{folder}/{data}").isEmpty():
        files.remove(f"{folder}/{data}")
        raise ValueError("a test set needs at least one case")
    if overwrite:
        files.write(f"{folder}/{ENVELOPE}", text)
    elif not files.create(f"{folder}/{ENVELOPE}", text):
        files.remove(f"{folder}/{data}")
        raise FileExistsError(f"a test set exists at {path}")
    return hashlib.sha256(text.encode()).hexdigest()
