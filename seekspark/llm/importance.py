"""Importance resampling towards a target text collection, over hashed 1- and 2-word runs.

Features are all single words and all pairs of neighbouring words of a text. A feature's
bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets. Bucket totals of the
documents and of the target give each bucket a gain; a document's weight is the floored
mean gain of its features, and Gumbel noise from a hash of its id turns the highest scores
into a weighted draw without replacement.

The vocabulary has a head and a tail. One pass finds frequent words and pairs by lossy
counting in bounded memory. The head is broadcast: the CRC state of each frequent word,
from which a pair continues, and the bucket of each frequent pair. Everything else is a
tail feature whose CRC is taken directly. Both give the same buckets, so the result never
depends on what is in the head, which only saves work.

Defined cases: a null text has no words; a document without words has weight 0. A null id
gives no hash, so score and rank are null and the row isn't among the documents drawn
from. Every row counts, also repeated ones, and each has its own rank; equal scores are
ordered by doc_id, and rows that still tie are equal in both. Empty documents give an
empty result, an empty target has totals of 0. Columns other than doc_id and text are
not read. A text is handled whole whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.arrays import slices, text_bytes
from seekspark.llm.frames import stored

BUCKETS = 10_000
SHARE_PERCENT = 25
LEAST_WORDS = 20
SEED = 7
# Words and pairs above this share of all words are in the head, so it has at most
# 2 / HEAD_SHARE of each kind whatever the size of the input.
HEAD_SHARE = 1e-5
# Lossy counting drops what has been rare after so many words; its error is one in so many.
COUNTING_WORDS = round(2 / HEAD_SHARE)
COUNTING_BYTES = 2 << 20

# A-Z to a-z, digits, a-z and everything beyond ASCII as they are, the rest to blanks.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)


@dataclass
class Head:
    """Frequent words with their CRC states; pairs as ``left * words + right``, sorted."""

    index: dict[bytes, int]
    words: list[bytes]
    states: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray


def build_head(words: list[bytes], pairs: list[bytes], buckets: int = BUCKETS) -> Head:
    words = sorted(words)
    index = {w: i for i, w in enumerate(words)}
    states = np.array([zlib.crc32(w) for w in words], np.int64)
    known = []
    for pair in pairs:
        left, right = pair.split(b" ")
        if left in index and right in index:
            crc = zlib.crc32(b" " + right, int(states[index[left]]))
            known.append((index[left] * len(words) + index[right], crc % buckets))
    known.sort()
    table = np.array(known, np.int64).reshape(-1, 2)
    return Head(index, words, states, table[:, 0].copy(), table[:, 1].astype(np.uint16))


def word_lists(text: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Words of all rows in one list, and where each row's words begin."""
    data, at = text_bytes(text)
    raw = data.tobytes().translate(WORD_BYTES)
    words: list[bytes] = []
    ends = [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        words += raw[a:b].split()
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def _codes(words: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """Head numbers, and from ``len(index)`` on numbers of the tail words, which are listed."""
    codes = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    tail: dict[bytes, int] = {}
    places = np.flatnonzero(codes < 0)
    first = len(index)
    codes[places] = [tail.setdefault(words[i], first + len(tail)) for i in places.tolist()]
    return codes, list(tail)


def _neighbours(ends: np.ndarray) -> np.ndarray:
    """Mask over word places: the word has a right neighbour in the same row."""
    inner = np.ones(int(ends[-1]), bool)
    inner[ends[1:][ends[1:] > 0] - 1] = False
    return inner


def feature_buckets(text: pa.Array, head: Head, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the word bounds of the rows.

    The feature of word ``i`` stands at ``2 i``, that of the pair from ``i`` at ``2 i + 1``;
    what stands between two rows belongs to none.
    """
    words, ends = word_lists(text)
    codes, tail = _codes(words, head.index)
    states = np.concatenate([head.states, np.array([zlib.crc32(w) for w in tail], np.int64)])
    found = np.zeros(2 * len(words), np.uint16)
    found[::2] = (states % buckets)[codes]
    left = np.flatnonzero(_neighbours(ends))
    if len(left):
        a, b = codes[left], codes[left + 1]
        known = len(head.words)
        out = np.zeros(len(left), np.uint16)
        rest = np.ones(len(left), bool)
        if len(head.pairs):
            key = np.where((a < known) & (b < known), a * known + b, -1)
            place = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            rest = head.pairs[place] != key
            out[~rest] = head.pair_buckets[place[~rest]]
        everything = len(states)
        keys, where = np.unique(a[rest] * everything + b[rest], return_inverse=True)
        lefts, rights = np.divmod(keys, everything)
        spaced = {r: b" " + (head.words[r] if r < known else tail[r - known]) for r in np.unique(rights).tolist()}
        crcs = [zlib.crc32(spaced[r], s) for r, s in zip(rights.tolist(), states[lefts].tolist())]
        out[rest] = (np.array(crcs, np.int64) % buckets)[where.ravel()]
        found[2 * left + 1] = out
    return found, ends


def frequent_features(texts: DataFrame, share: float = HEAD_SHARE) -> tuple[list[bytes], list[bytes]]:
    """Words and pairs that lossy counting in the tasks finds above ``share``.

    Pairs that occur once in a slice aren't counted, and what is rare is dropped now and
    then, so a feature near the bound may be missed; it is a tail feature then. At most
    ``2 / share`` of each kind come back, as each holds half of ``share`` or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict, dict] = ({}, {})
        total = since = 0
        for part in slices(batches, limit=COUNTING_BYTES):
            words, ends = word_lists(part.column(0))
            codes, names = _codes(words, {})
            left = np.flatnonzero(_neighbours(ends)) if words else np.zeros(0, np.int64)
            keys, n = np.unique(codes[left] * len(names) + codes[left + 1], return_counts=True)
            often = n > 1
            sizes = np.bincount(codes, minlength=len(names)).tolist()
            for word, count in zip(names, sizes):
                counts[0][word] = counts[0].get(word, 0) + count
            lefts, rights = np.divmod(keys[often], max(len(names), 1))
            for a, b, count in zip(lefts.tolist(), rights.tolist(), n[often].tolist()):
                pair = names[a] + b" " + names[b]
                counts[1][pair] = counts[1].get(pair, 0) + count
            total, since = total + len(words), since + len(words)
            if since >= COUNTING_WORDS:
                floor, since = total * share / 2, 0
                for kind in counts:
                    for feature in [f for f, c in kind.items() if c < floor]:
                        del kind[feature]
        for kind, found in enumerate(counts):
            kept = [(f, c) for f, c in found.items() if c > 1 and 2 * c >= total * share]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(kept), pa.int32()), pa.array([f for f, _ in kept], pa.binary()),
                 pa.array([c for _, c in kept], pa.int64()), pa.array([0] * len(kept), pa.int64())],
                names=["kind", "feature", "n", "words"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int32()), pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([total], pa.int64())],
            names=["kind", "feature", "n", "words"],
        )

    found = stored(
        texts.select("text").mapInArrow(run, "kind int, feature binary, n long, words long")
        .groupBy("kind", "feature").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    )
    total = found.agg(F.sum("words")).first()[0] or 0
    rows = found.where((F.col("kind") < 2) & (2 * F.col("n") >= total * share)).collect()
    return [bytes(r["feature"]) for r in rows if r["kind"] == 0], [bytes(r["feature"]) for r in rows if r["kind"] == 1]


def hashed_features(rows: DataFrame, head, buckets: int, *keep: str) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and the buckets as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = head.value
        for part in slices(batches):
            found, ends = feature_buckets(part.column(part.num_columns - 1), vocabulary, buckets)
            count = np.diff(ends)
            raw = [found[2 * a : max(2 * b - 1, 2 * a)].astype("<u2").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(count), pa.array(np.maximum(2 * count - 1, 0)), pa.array(raw, pa.binary())],
                names=[*keep, "n_words", "n_features", "buckets"],
            )

    frame = rows.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kept + ', ' if kept else ''}n_words long, n_features long, buckets binary")


def bucket_totals(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Exact number of features per bucket; a task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                view = raw.as_buffer()
                if view is not None and len(view):
                    sums += np.bincount(np.frombuffer(view, "<u2"), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(sums[met])], names=["bucket", "n"])

    totals = np.zeros(buckets, np.int64)
    met = hashed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in met.collect():
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of target and documents."""
    s_all, t_all, n = float(documents.sum()), float(target.sum()), len(documents)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
            for s, t in zip(documents.tolist(), target.tolist())
        ],
        np.int64,
    )


def _weights(hashed: DataFrame, gains) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        for batch in batches:
            sums = [
                int(table[np.frombuffer(raw.as_buffer(), "<u2")].sum()) // max(n, 1) if n else 0
                for raw, n in zip(batch.column(3), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    frame = hashed.select("doc_id", "n_words", "n_features", "buckets")
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``rank`` by falling score and doc_id; null beyond the drawn share.

    A range exchange puts the rows in order, each task numbers its own, and the sizes of
    the tasks before it are added: one row per task, broadcast. The row number in the order
    keeps many rows of one id from being one range.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("place"))
        .withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    starts = sizes.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.floor(F.sum("n").over(whole) * percent / 100).alias("drawn"),
    )
    rank = F.col("start") + F.col("place") + 1
    return placed.join(F.broadcast(starts), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank")
    )


def importance_draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = SHARE_PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    head_share: float = HEAD_SHARE,
) -> DataFrame:
    """Each document's n_features, weight, score and rank among the drawn (else null).

    Both frames have a ``text``; ``docs`` has a ``doc_id``. Drawn are the highest scores,
    ``percent`` of the documents with ``least_words`` words. ``buckets`` is at most 65 536.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")
    context = docs.sparkSession.sparkContext
    head = context.broadcast(build_head(*frequent_features(docs, head_share), buckets))
    hashed = stored(hashed_features(docs, head, buckets, "doc_id"))
    wanted = bucket_totals(hashed_features(target, head, buckets), buckets)
    gains = context.broadcast(bucket_gains(bucket_totals(hashed, buckets), wanted))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = stored(
        _weights(hashed, gains)
        .withColumn("score", F.col("weight") + noise)
        .withColumn("row", F.monotonically_increasing_id())
    )
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    rest = scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return _ranked(scored.where(able), percent).unionByName(rest)
