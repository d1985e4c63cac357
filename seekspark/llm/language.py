"""Language identification by bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of the n-grams that make up a fixed share of its
training text. The filters are stored bit-sliced: one row per bit position, holding a
mask of the languages that have the bit. Looking an n-gram up is the AND of a few rows
and returns all languages containing it at once. A text counts hits per language,
corrects them for the filter's false positives and takes the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import arrays
from seekspark.llm.frames import stored

GRAM_SIZES = (1, 2, 3)
# An n-gram belongs to a language when it makes up this share of its training n-grams,
# so a language has at most the inverse share of members.
MEMBER_SHARE = 5e-5
HASHES = 3
BITS_PER_MEMBER = 16
UNKNOWN = "und"


def grams(data: np.ndarray, at: np.ndarray):
    """All letter n-grams as (row, hash), and the number of letters of each row.

    Letters are lower-cased; all else becomes one word boundary. An n-gram has a
    letter at its second place (or is one letter), so runs of boundaries give none.
    """
    points, at = arrays.code_points(data, at)
    rows = len(at) - 1
    letter = arrays.class_table()[points] == 1
    value = np.where(letter, arrays.lower_table()[points], 32).astype(np.uint64)
    # One boundary before and after each row keeps n-grams inside it.
    padded = np.full(len(value) + 2 * rows, 32, np.uint64)
    row_of = np.repeat(np.arange(rows), np.diff(at))
    place = np.arange(len(value)) + 2 * row_of + 1
    padded[place] = value
    owner = np.repeat(np.arange(rows), np.diff(at) + 2)
    letters = np.bincount(row_of[letter], minlength=rows)
    found = []
    for size in GRAM_SIZES:
        n = len(padded) - size + 1
        if n <= 0:
            continue
        key = np.full(n, size, np.uint64)
        for k in range(size):
            key = key * np.uint64(arrays.BASE) + padded[k : k + n]
        good = (padded[min(1, size - 1) :][:n] != 32) & (owner[:n] == owner[size - 1 :][:n])
        found.append((owner[:n][good], arrays.mix(key[good])))
    row = np.concatenate([f[0] for f in found])
    key = np.concatenate([f[1] for f in found])
    return row, key, letters


def _positions(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each key in a filter of ``2**bits`` rows (double hashing)."""
    step = arrays.mix(key ^ np.uint64(arrays.BASE)) | np.uint64(1)
    return [(key + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """Bit-sliced filters: ``masks[position, word]``, one bit per language."""

    languages: list[str]
    bits: int
    masks: np.ndarray
    order: np.ndarray  # languages by training texts, most first; decides ties

    def false_positive_rates(self) -> np.ndarray:
        full = [
            ((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
            for i in range(len(self.languages))
        ]
        return np.minimum(np.array(full) ** HASHES, 0.999)

    def scores(self, row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
        """Corrected share of each row's n-grams that each language contains."""
        words = self.masks.shape[1]
        held = np.full((len(key), words), np.uint64(2**64 - 1))
        for position in _positions(key, self.bits):
            held &= self.masks[position]
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        rate = self.false_positive_rates()
        out = np.zeros((rows, len(self.languages)))
        for i in range(len(self.languages)):
            hit = ((held[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
            share = np.bincount(row[hit], minlength=rows) / total
            out[:, i] = np.clip((share - rate[i]) / (1 - rate[i]), 0, 1)
        return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences per (language, n-gram), summed over what one task reads."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            key = np.concatenate([p[0] for p in parts])
            weight = np.concatenate([p[1] for p in parts])
            key, at = np.unique(key, return_inverse=True)
            count = np.bincount(at, weights=weight).astype(np.int64)
            held[lang] = [(key, count)]

    for part in arrays.slices(batches):
        data, at = arrays.text_bytes(part.column(0))
        row, key, _ = grams(data, at)
        codes = part.column(1).dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)[row]
        for i, lang in enumerate(codes.dictionary.to_pylist()):
            at, one = pd.factorize(key[code == i])
            count = np.bincount(at, minlength=len(one))
            held.setdefault(lang, []).append((one, count))
            size += len(one)
        if size > 2_000_000:
            flush()
            size = sum(len(p[0][0]) for p in held.values()) // 2
    flush()
    for lang, [(key, count)] in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(count)],
            names=["lang", "gram", "n"],
        )


def train_filters(docs: DataFrame, member_share: float = MEMBER_SHARE) -> LanguageFilters:
    """Filters from the rows of ``docs(text, lang)`` whose language is known.

    A language has at most 1 / ``member_share`` members, so the filters' size depends on
    the languages and not on the number of texts.
    """
    known = docs.select("text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], 1, np.zeros((2, 1), np.uint64), np.zeros(0, int))
    code = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    counts = stored(
        known.mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg((F.sum("n") * member_share).alias("least"))
    members = (
        counts.join(F.broadcast(totals), "lang").where("n >= least")  # one row per language
        .select("gram", code[F.col("lang")].alias("code")).toPandas()
    )
    bits = max(6, int(np.ceil(np.log2(max(1, members.groupby("code").size().max() if len(members) else 1) * BITS_PER_MEMBER))))
    masks = np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64)
    key = members["gram"].to_numpy(np.int64).view(np.uint64)
    lang = members["code"].to_numpy()
    for position in _positions(key, bits):
        for i in range(len(languages)):
            masks[position[lang == i], i // 64] |= np.uint64(1) << np.uint64(i % 64)
    order = np.array(sorted(range(len(languages)), key=lambda i: (-sizes[languages[i]], languages[i])))
    return LanguageFilters(languages, bits, masks, order)


def identify_languages(docs: DataFrame, filters: LanguageFilters, *keep: str) -> DataFrame:
    """``lang_pred`` and ``score`` beside the ``keep`` columns of ``docs(text, ...)``.

    score is the winner's part of all languages' shares, 0 to 1. Null texts and texts
    without a letter give ``und`` with score 0; ties go to the language with more
    training texts, then by name; letters that no filter knows give that first language
    with score 0. Repeated rows get equal results. Nothing but the text is read for the
    prediction, whole texts of any length count, and other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages + [UNKNOWN], object)
        for part in arrays.slices(batches):
            row, key, letters = grams(*arrays.text_bytes(part.column(0)))
            rows = part.num_rows
            best, score = np.full(rows, len(names) - 1), np.zeros(rows)
            if model.languages:
                share = model.scores(row, key, rows)[:, model.order]
                top = share.argmax(1)
                total = share.sum(1)
                seen = letters > 0
                best[seen] = model.order[top[seen]]
                score = np.where(seen & (total > 0), share.max(1) / np.maximum(total, 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(names[best], pa.string()), pa.array(score)],
                names=[*part.schema.names[1:], "lang_pred", "score"],
            )

    return docs.select("text", *keep).mapInArrow(run, schema)
