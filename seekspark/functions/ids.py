"""Content-addressed identifiers as column expressions."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def sha256_text(value: Column) -> Column:
    return F.sha2(value, 256)


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """``prefix_`` plus the first hex digits of sha256 over the separated parts.

    A NULL part makes the identifier NULL: concat_ws alone would silently skip it.
    """
    strings = [part.cast("string") for part in parts]
    digest = F.substring(F.sha2(F.concat_ws(SEPARATOR, *strings), 256), 1, length)
    present = strings[0].isNotNull()
    for part in strings[1:]:
        present = present & part.isNotNull()
    return F.when(present, F.concat(F.lit(prefix + "_"), digest))


def stable_id_value(prefix: str, *parts: str, length: int = 20) -> str:
    """Driver-side twin of :func:`stable_id` for configuration-sized values."""
    digest = hashlib.sha256(SEPARATOR.join(parts).encode("utf-8")).hexdigest()
    return f"{prefix}_{digest[:length]}"


def canonical_json_hash(value: Any) -> str:
    """sha256 of JSON with sorted keys, no blanks and non-ASCII kept. For configs only."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def file_source_uri(root_label: Column, relative_path: Column) -> Column:
    return F.concat(F.lit("file:"), F.lower(root_label), F.lit("/"), F.lower(relative_path))


def evidence_ids(
    document_id: Column, page_start: Column, page_end: Column, section_path: Column
) -> Column:
    """One locator per page of the range, or one for the section path without pages."""
    first = F.coalesce(page_start, page_end)
    last = F.coalesce(page_end, page_start)
    document = F.trim(document_id)
    sections = F.filter(
        F.transform(section_path, lambda name: F.trim(name)), lambda name: F.length(name) > 0
    )
    locator = F.concat(F.lit("section:"), F.array_join(sections, " > "))
    pages = F.transform(
        F.sequence(first, last),
        lambda page: stable_id(
            "evd", document, F.concat(F.lit("page:"), page.cast("string"))
        ),
    )
    return F.when(first.isNotNull(), pages).otherwise(
        F.array(stable_id("evd", document, locator))
    )
