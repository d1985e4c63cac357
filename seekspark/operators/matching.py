"""Which reference texts occur in which segments, as an equi-join.

Substrings of a text have a fingerprint that both sides compute alone: the smallest hash
of the short grams inside a window of the shortest overlap that counts. A text that
contains another contains the first window of it, and with it that window's smallest
gram; so the container offers the smallest gram of all its windows, a few per hundred
characters, and the contained text looks up one. Pairs that meet are compared in full.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.text import MIN_OVERLAP_CHARS
from seekspark.scale import cut_lineage

GRAM_CHARS = 16
WINDOW = MIN_OVERLAP_CHARS - GRAM_CHARS + 1
# What a key stands for: equal texts, a reference inside a segment, and the reverse.
EQUAL, REFERENCE_INSIDE, SEGMENT_INSIDE = 1, 2, 3
KEYS = T.ArrayType(T.LongType())
# White space of Unicode, as Java's (?U)\s; Python's \s has four separators more.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _normal_text(value: str | None) -> str | None:
    """Composed form, white space squeezed, case folded."""
    if value is None:
        return None
    return BLANKS.sub(" ", unicodedata.normalize("NFKC", value)).strip(" ").casefold()


# Nondeterministic in name only: a filter on the result, or one that Spark infers from an
# explode of it, would otherwise run each function a second time, in another Python worker.
@F.pandas_udf(T.StringType())
def _normal_texts(values: pd.Series) -> pd.Series:
    return values.map(_normal_text)


_normal_texts = _normal_texts.asNondeterministic()


def normal_form(value: Column) -> Column:
    return _normal_texts(value)


def _mixed(value: np.ndarray, tag: int) -> np.ndarray:
    value = value ^ np.uint64(tag * 0x9E3779B97F4A7C15 & (2**64 - 1))
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def _power_grams(text: str):
    """``(size, hashes)`` of all grams of 1, 2, 4, ... characters."""
    value = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    value, size = _mixed(value, 7), 1
    while len(value):
        yield size, value
        value = _mixed(value[:-size] * np.uint64(0xA24BAED4963EE407) + value[size:], 8)
        size *= 2


def _windows(text: str) -> np.ndarray:
    """The smallest gram hash of each window of the text."""
    value = next((v for size, v in _power_grams(text) if size == GRAM_CHARS), np.zeros(0, np.uint64))
    width = 1
    while 2 * width <= WINDOW and len(value):
        value, width = np.minimum(value[:-width], value[width:]), 2 * width
    rest = WINDOW - width
    return np.minimum(value[:-rest], value[rest:]) if rest and len(value) else value


def _whole(text: str) -> np.ndarray:
    digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
    return _mixed(np.frombuffer(digest, np.uint64), EQUAL)


def _segment_keys(text: str) -> np.ndarray:
    """Equal text, the windows it offers, and the one key it is looked up by."""
    windows = _windows(text)
    if len(windows):
        own = windows[:1]
    else:
        *_, (_, last) = _power_grams(text)
        own = last[:1]
    return np.concatenate([_whole(text), _mixed(np.unique(windows), REFERENCE_INSIDE), _mixed(own, SEGMENT_INSIDE)])


def _reference_keys(text: str) -> np.ndarray:
    """The counterpart; references below the shortest overlap can only be equal."""
    windows = _windows(text)
    if not len(windows):
        return _whole(text)
    grams = [np.unique(v) for size, v in _power_grams(text) if size < MIN_OVERLAP_CHARS]
    inside = np.unique(np.concatenate([windows, *grams]))
    return np.concatenate([_whole(text), _mixed(windows[:1], REFERENCE_INSIDE), _mixed(inside, SEGMENT_INSIDE)])


@F.pandas_udf(KEYS)
def segment_keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _segment_keys(t).view(np.int64))


segment_keys = segment_keys.asNondeterministic()


@F.pandas_udf(KEYS)
def reference_keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _reference_keys(t).view(np.int64))


reference_keys = reference_keys.asNondeterministic()


def _normal(rows: DataFrame, name: str) -> DataFrame:
    return cut_lineage(
        rows.select(name, normal_form(F.col("text")).alias("normal")).where(F.length("normal") > 0)
    )


def match_contexts(contexts: DataFrame, segments: DataFrame) -> DataFrame:
    """``context_id, segment_id, equal`` for contexts found in segments or the reverse.

    Equal texts win: other matches of the same context are dropped then. Containment
    needs a context of at least 80 characters.
    """
    contexts, segments = _normal(contexts, "context_id"), _normal(segments, "segment_id")
    offered = segments.select("segment_id", F.explode(segment_keys("normal")).alias("key"))
    asked = contexts.select("context_id", F.explode(reference_keys("normal")).alias("key"))
    pairs = asked.join(offered, "key").select("context_id", "segment_id").distinct()
    both = pairs.join(contexts.withColumnRenamed("normal", "context"), "context_id").join(
        segments.withColumnRenamed("normal", "segment"), "segment_id"
    )
    within = (F.length("context") >= MIN_OVERLAP_CHARS) & (
        F.contains("segment", "context") | F.contains("context", "segment")
    )
    found = cut_lineage(
        both.withColumn("equal", F.col("context") == F.col("segment"))
        .where(F.col("equal") | within)
        .select("context_id", "segment_id", "equal")
    )
    exact = found.groupBy("context_id").agg(F.max("equal").alias("has_equal"))
    return (
        found.join(exact, "context_id")
        .where(F.col("equal") | ~F.col("has_equal"))
        .select("context_id", "segment_id", "equal")
    )
