"""Files to parsed documents: discovery, loader choice, text and Markdown segments."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.ids import file_source_uri, stable_id
from seekspark.functions.text import paragraphs

SEGMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("section_path", T.ArrayType(T.StringType())),
        ]
    )
)

# --- fixed values: loaders by suffix, heading pattern -------------------------
LOADERS = {".txt": ("builtin-text", "1"), ".md": ("builtin-markdown", "1"), ".markdown": ("builtin-markdown", "1")}
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
# -----------------------------------------------------------------------------

Parser = Callable[[DataFrame], DataFrame]


def suffix_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))


def discover(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """All files below ``folder`` with bytes, suffix and root-relative path."""
    root = folder.rstrip("/")
    label = root.rsplit("/", 1)[-1] or "root"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.element_at(F.split("path", re.escape("/" + label + "/"), 2), 2)
    listed = found.select("path", inside.alias("relative_path"), F.lit(label).alias("root"), "content", "modificationTime")
    suffix = suffix_of(F.col("path"))
    return listed.withColumn("suffix", suffix).where(suffix.isin(suffixes or list(LOADERS)))


def markdown_blocks(texts: Sequence[str]) -> tuple[list[str | None], list[list[dict]]]:
    """Titles, and the blocks between blank lines and headings with their heading path.

    One table of all lines of a batch: a running number tells blocks apart, and a heading
    stands one level below its predecessor at most, so its path is the latest heading of
    each level above it.
    """
    lines = pd.DataFrame({"text": [t.splitlines() for t in texts]}).explode("text").fillna({"text": ""})
    lines.index.name = "row"
    lines = lines.reset_index()
    head = lines["text"].str.extract(HEADING)
    marks, lines["name"] = head[0], head[1].str.strip()
    lines["heading"] = marks.notna()
    blank = lines["text"].str.strip() == ""
    lines["block"] = (lines["heading"] | blank | (lines["row"] != lines["row"].shift())).cumsum()
    depth = marks.str.len().fillna(0).astype(int)

    def level(above: int, wanted: int) -> int:
        return min(above + 1, wanted) if wanted else above

    lines["level"] = [
        x for _, part in depth.groupby(lines["row"]) for x in list(itertools.accumulate(part, level, initial=0))[1:]
    ]
    latest = {}
    for n in range(1, 7):
        name = lines["name"].where(lines["heading"] & (lines["level"] == n))
        latest[n] = name.groupby(lines["row"]).ffill()
    title = lines[lines["heading"] & (depth == 1)].groupby("row")["name"].first()
    segments: list[list[dict]] = [[] for _ in texts]
    body = lines[~lines["heading"] & ~blank]
    for (row, _), part in body.groupby(["row", "block"], sort=True):
        at = part.index[0]
        path = [latest[n][at] for n in range(1, int(lines["level"][at]) + 1)]
        segments[row].append({"text": "\n".join(part["text"]).strip(), "section_path": path})
    return [title.get(i) for i in range(len(texts))], segments


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("segments", SEGMENTS)]))
def parse_markdown(texts: pd.Series) -> pd.DataFrame:
    titles, segments = markdown_blocks([t or "" for t in texts])
    return pd.DataFrame({"title": titles, "segments": segments})


def text_segments(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.transform(paragraphs(text), lambda p: F.struct(p.alias("text"), none.alias("section_path")))


def load_documents(files: DataFrame, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and failures; a bad file never stops the others.

    ``parsers`` maps further suffixes, such as ``.pdf``, to functions that turn file rows
    into ``path, title, segments`` rows.
    """
    parsers = parsers or {}
    content = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(content, "^﻿", "")
    named = files.withColumns(
        {
            "text": text,
            "stem": F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""),
            "source_uri": file_source_uri(F.col("root"), F.col("relative_path")),
        }
    )
    known = F.col("suffix").isin([*LOADERS, *parsers])
    builtin = F.col("suffix").isin(list(LOADERS))
    reason = F.when(~known, F.concat(F.lit("unsupported file type: "), F.col("suffix"))).when(
        builtin & F.col("text").isNull(), F.lit("not valid UTF-8")
    )
    judged = named.withColumn("error", reason)
    failures = judged.where(F.col("error").isNotNull()).select("path", "error")
    good = judged.where(F.col("error").isNull())
    plain = good.where(F.col("suffix") == ".txt").withColumns(
        {"title": F.col("stem"), "segments": text_segments(F.col("text"))}
    )
    marked = good.where(F.col("suffix").isin(".md", ".markdown")).withColumn("parsed", parse_markdown(F.col("text")))
    marked = marked.withColumns(
        {"title": F.coalesce("parsed.title", "stem"), "segments": F.col("parsed.segments")}
    ).drop("parsed")
    frames = [plain, marked]
    for suffix, parser in parsers.items():
        own = good.where(F.col("suffix") == suffix)
        frames.append(own.join(parser(own).select("path", "title", "segments"), "path"))
    none = F.lit(None).cast("int")
    wanted = []
    for frame in frames:
        located = F.transform(
            "segments",
            lambda s: F.struct(
                s["text"].alias("text"), s["section_path"].alias("section_path"),
                none.alias("page_start"), none.alias("page_end"),
            ),
        ) if "page_start" not in str(frame.schema["segments"].dataType) else F.col("segments")
        parser_name = F.when(F.col("suffix") == ".txt", "builtin-text").when(builtin, "builtin-markdown").otherwise("injected")
        wanted.append(
            frame.select(
                stable_id("doc", F.col("source_uri")).alias("document_id"), "source_uri", "path",
                F.trim("title").alias("title"), F.expr("substring(suffix, 2)").alias("source_type"),
                F.sha2("content", 256).alias("content_hash"), parser_name.alias("parser_name"),
                F.lit("1").alias("parser_version"), located.alias("segments"),
            )
        )
    whole = wanted[0]
    for frame in wanted[1:]:
        whole = whole.unionByName(frame)
    return whole, failures
