"""Section-aware chunking: cleaned segments in, content-addressed chunk rows out."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.ids import canonical_json_hash, sha256_text, stable_id
from seekspark.functions.text import clean_text
from seekspark.operators.quality import quality_class
from seekspark.scale import computed_once, let

# --- fixed values: they are part of the chunk identity ------------------------
CHUNKER_NAME = "section-token-chunker"
CHUNKER_VERSION = "3"
CLASSIFIER_NAME = "rule-based-chunk-quality"
CLASSIFIER_VERSION = "3"
BOUNDARIES = ("\n\n", ". ", "; ", ", ", " ")
MAX_TOKENS = 512
OVERLAP_TOKENS = 64
# -----------------------------------------------------------------------------

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("section_path", T.ArrayType(T.StringType())),
        ]
    )
)

Counter = Callable[[str], int]


def count_whitespace(text: str) -> int:
    return len(text.split())


def chunker_config(tokenizer: str, max_tokens: int, overlap_tokens: int) -> dict:
    return {
        "name": CHUNKER_NAME,
        "version": CHUNKER_VERSION,
        "tokenizer": tokenizer,
        "max_tokens": max_tokens,
        "overlap_tokens": overlap_tokens,
        "quality_classifier": CLASSIFIER_NAME,
        "quality_classifier_version": CLASSIFIER_VERSION,
    }


def clean_segments(documents: DataFrame) -> DataFrame:
    """Clean every segment of ``document_id, ordinal, text, ...`` rows; drop empty ones."""
    return documents.withColumn("text", clean_text(F.col("text"))).where(F.length("text") > 0)


def place_segments(segments: Column) -> Column:
    """Add character offsets to ordered segments joined by blank lines."""
    none = F.array().cast("array<int>")
    lengths = F.transform(segments, lambda s: F.length(s["text"]))
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("cursor"), none.alias("starts")),
        lambda state, size: F.struct(
            (state["cursor"] + size + 2).alias("cursor"),
            F.concat(state["starts"], F.array(state["cursor"])).alias("starts"),
        ),
        lambda state: state["starts"],
    )
    return let(
        starts,
        lambda begin: F.transform(
            segments,
            lambda s, i: F.struct(
                s["text"].alias("text"),
                s["section_path"].alias("section_path"),
                s["page_start"].alias("page_start"),
                s["page_end"].alias("page_end"),
                F.get(begin, i).alias("char_start"),
                (F.get(begin, i) + F.length(s["text"])).alias("char_end"),
            ),
        ),
    )


class _Splitter:
    """Cuts one document; all it needs from outside is a token counter."""

    def __init__(self, count: Counter, max_tokens: int, overlap: int) -> None:
        self.count, self.max_tokens, self.overlap = count, max_tokens, overlap

    def fits(self, text: str, section: tuple) -> bool:
        head = " > ".join(section) + "\n" if section else ""
        return self.count(head + text) <= self.max_tokens

    def cut(self, text: str, start: int, stop: int, section: tuple) -> int:
        """``stop`` if everything fits, else the longest fitting prefix moved back to a
        late natural boundary."""
        room = furthest(stop - start, lambda n: self.fits(text[start : start + n], section), 4 * self.max_tokens)
        if start + room == stop:
            return stop
        end = start + max(room, 1)
        floor = start + max(1, (end - start) // 2)
        late = (text.rfind(mark, floor, end) + len(mark) for mark in BOUNDARIES)
        return next((at for at, mark in zip(late, BOUNDARIES) if at >= len(mark)), end)

    def tail(self, text: str, start: int, stop: int) -> int:
        """Start of the longest suffix within the overlap budget, at a word start."""
        if self.overlap <= 0:
            return stop
        size = furthest(stop - start, lambda n: self.count(text[stop - n : stop]) <= self.overlap, 4 * self.overlap)
        head, blank, _ = text[stop - size : stop].partition(" ")
        return stop - size + (len(head) + 1 if blank else 0)

    def pieces(self, text: str, begin: int, end: int, section: tuple) -> Iterator[tuple[int, int]]:
        """The parts of one segment that fit alone, without white space at their ends."""
        cuts = [begin]
        while cuts[-1] < end:
            cuts.append(self.cut(text, cuts[-1], end, section))
        bounds = (trimmed(text, a, b) for a, b in itertools.pairwise(cuts))
        return (span for span in bounds if span[0] < span[1])

    def spans(self, text: str, segments) -> list[tuple[int, int, tuple]]:
        """Chunks of a document: each takes as many pieces of its section as fit, and begins
        with the end of the one before it where that leaves room for its first piece."""
        for section in {s[2] for s in segments}:
            if section and self.count(" > ".join(section) + "\n") >= self.max_tokens or not self.fits("", section):
                raise ValueError("section heading consumes the entire chunk token budget")
        every = ((*piece, segment[2]) for segment in segments for piece in self.pieces(text, *segment))
        chunks = []
        for section, run in itertools.groupby(every, key=lambda p: p[2]):
            pieces = [(a, b) for a, b, _ in run]
            at, start = 0, pieces[0][0]
            while at < len(pieces):
                taken = furthest(len(pieces) - at, lambda n: self.fits(text[start : pieces[at + n - 1][1]], section))
                at += max(taken, 1)
                stop = pieces[at - 1][1]
                chunks.append((*trimmed(text, start, stop), section))
                if at < len(pieces):
                    overlap = self.tail(text, start, stop)
                    shared = self.overlap and self.fits(text[overlap : pieces[at][1]], section)
                    start = overlap if shared else pieces[at][0]
        return chunks


def furthest(limit: int, holds: Callable[[int], bool], first: int = 1) -> int:
    """Largest n up to ``limit`` for which ``holds``, true up to some n and false beyond;
    0 if it never is. Probes double from ``first``, so a long text isn't counted whole."""
    known, probe = 0, min(first, limit)
    while known < limit and holds(probe):
        known, probe = probe, min(2 * probe, limit)
    if known == limit:
        return limit
    return known + bisect.bisect_left(range(known + 1, probe), True, key=lambda n: not holds(n))


def trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """The span without white space at its ends; an empty one at ``start`` if nothing is left."""
    body = text[start:stop]
    lead = len(body) - len(body.lstrip())
    return (start, start) if lead == len(body) else (start + lead, start + len(body.rstrip()))


def chunk_spans(
    text: Column, segments: Column, count: Counter, max_tokens: int, overlap: int
) -> Column:
    """Spans of one document; only offsets leave the Python worker."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        splitter = _Splitter(count, max_tokens, overlap)
        return pd.Series(
            [
                [
                    {"start": a, "stop": b, "section_path": list(path)}
                    for a, b, path in splitter.spans(
                        body, [(r["char_start"], r["char_end"], tuple(r["section_path"])) for r in rows]
                    )
                ]
                for body, rows in zip(texts, ranges)
            ]
        )

    offsets = F.transform(
        segments,
        lambda s: F.struct(
            s["char_start"].alias("char_start"),
            s["char_end"].alias("char_end"),
            s["section_path"].alias("section_path"),
        ),
    )
    # Not deterministic for the optimizer: the call must not be copied into filters.
    return run.asNondeterministic()(text, offsets)


def pages_of_span(segments: Column, start: Column, stop: Column) -> Column:
    """First and last page of the segments a span overlaps."""
    hit = F.filter(segments, lambda s: (s["char_end"] > start) & (s["char_start"] < stop))
    return let(
        hit,
        lambda found: F.struct(
            F.array_min(F.transform(found, lambda s: s["page_start"])).alias("page_start"),
            F.array_max(F.transform(found, lambda s: s["page_end"])).alias("page_end"),
        ),
    )


def chunk_documents(
    documents: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    count: Counter = count_whitespace,
    tokenizer: str = "whitespace",
) -> DataFrame:
    """Chunks of ``document_id, segments`` rows; narrow, without any shuffle.

    ``segments`` are cleaned and ordered: text, section_path, page_start, page_end.
    """
    if max_tokens < 1 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("need max_tokens >= 1 and 0 <= overlap_tokens < max_tokens")
    config = canonical_json_hash(chunker_config(tokenizer, max_tokens, overlap_tokens))
    given = documents.select("document_id", F.col("segments").alias("given"))
    placed = computed_once(
        computed_once(given, kept=F.col("given")),
        segments=place_segments(F.col("kept")),
        body=F.array_join(F.transform("kept", lambda s: s["text"]), "\n\n"),
    ).where(F.length("body") > 0)
    spans = chunk_spans(F.col("body"), F.col("segments"), count, max_tokens, overlap_tokens)
    cut = placed.withColumn("spans", spans).select(
        "document_id", "body", "segments", F.posexplode("spans").alias("ordinal", "span")
    )
    text = F.substring(
        F.col("body"), F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")
    )
    label = F.array_join("span.section_path", " > ")
    located = cut.select(
        "document_id",
        "ordinal",
        F.col("span.section_path").alias("section_path"),
        pages_of_span(F.col("segments"), F.col("span.start"), F.col("span.stop")).alias("pages"),
        F.col("span.start").alias("char_start"),
        F.col("span.stop").alias("char_end"),
        text.alias("text"),
        F.when(F.length(label) > 0, F.concat(label, F.lit("\n"), text)).otherwise(text).alias("contextualized_text"),
    )
    counted = F.pandas_udf(lambda v: v.map(count).astype("int32"), T.IntegerType())
    hashed = sha256_text(F.col("text"))
    return located.select(
        stable_id("chk", F.col("document_id"), F.col("ordinal"), hashed, F.lit(config)).alias("chunk_id"),
        "document_id", "ordinal", "section_path",
        F.col("pages.page_start").alias("page_start"),
        F.col("pages.page_end").alias("page_end"),
        "char_start", "char_end", "text", "contextualized_text",
        counted(F.col("contextualized_text")).alias("token_count"),
        hashed.alias("content_hash"),
        quality_class(
            F.col("section_path"), F.col("text"), F.col("ordinal"), F.col("pages.page_start")
        ).alias("quality_class"),
    )


