"""Rule-based chunk quality classes; the first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.functions.text import quality_section_name

# --- fixed values: section names and patterns that define the classes ---------
REFERENCE_SECTIONS = ["references", "bibliography", "works cited", "参考文献"]
ACKNOWLEDGEMENT_SECTIONS = [
    "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "致谢",
]
VISUALIZATION_SECTIONS = [
    "attention visualization", "attention visualizations", "visualization", "visualizations",
]
REFERENCE_ENTRY = r"(?m)^\s*\[\d+\]\s+(?=[A-Z])"
COPYRIGHT = (
    r"(?i)(?:©|copyright|all rights reserved|permission to (?:copy|reproduce)|"
    r"provided proper attribution|版权所有|保留所有权利)"
)
BOILERPLATE = (  # all of them
    r"(?i)\bCVPR paper\b",
    r"(?i)\bOpen Access version\b",
    r"(?i)\bComputer Vision Foundation\b",
)
AFFILIATION = (
    r"(?i)(?:\b(?:university|institute|department|laboratory|research lab|equal contribution)\b|"
    r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b)"
)
VISUALIZATION = r"(?i)(?:<\s*(?:eos|bos|pad)\s*>|attention visuali[sz]ations?|input[- ]input layer\d*)"
CLASSES = (
    "normal", "references", "acknowledgements", "copyright", "author_affiliation",
    "visualization_label",
)
# -----------------------------------------------------------------------------


def _occurrences(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def quality_class(
    section_path: Column, text: Column, ordinal: Column, page_start: Column
) -> Column:
    names = F.transform(section_path, quality_section_name)

    def in_section(wanted: list[str]) -> Column:
        return F.arrays_overlap(names, F.array(*[F.lit(name) for name in wanted]))

    boilerplate = text.rlike(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate & text.rlike(phrase)
    front = (ordinal <= 1) & (page_start.isNull() | (page_start == 1)) & (F.size(section_path) == 0)
    return (
        F.when(in_section(REFERENCE_SECTIONS), "references")
        .when(in_section(ACKNOWLEDGEMENT_SECTIONS), "acknowledgements")
        .when(in_section(VISUALIZATION_SECTIONS), "visualization_label")
        .when(_occurrences(text, REFERENCE_ENTRY) >= 3, "references")
        .when(text.rlike(COPYRIGHT) | boilerplate, "copyright")
        .when(front & (_occurrences(text, AFFILIATION) >= 2), "author_affiliation")
        .when(text.rlike(VISUALIZATION), "visualization_label")
        .otherwise("normal")
    )
