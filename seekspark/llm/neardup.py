"""Near-duplicate texts by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number.
Each of several hash functions takes the few smallest labelled shingles and keeps them in
text order, so equal sketches mean shared shingles in the same order. Texts with an equal
sketch are candidates. Their shingle sequences are aligned inside a band: shared shingles
in order, over all shingles of both, is the similarity, which is the Jaccard similarity
for texts whose order agrees and less for rearranged ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import arrays
from seekspark.llm.frames import stored
from seekspark.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
SKETCH_SIZE = 4
# Members of a group that one task compares with as many others.
CHUNK = 256


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all rows, and where each row begins.

    ASCII letters are lower-cased and white space only separates. A text of fewer words
    is one shingle; a text without words has none.
    """
    data, at = arrays.text_bytes(text)
    data = arrays.lower_ascii(data)
    start, end, row = arrays.words(data, at)
    word = arrays.span_hashes(data, start, end)
    count = np.bincount(row, minlength=len(at) - 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(number)])
    begin = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], number)
    stop = np.minimum(begin + SHINGLE, np.repeat(first[1:], number))
    return arrays.span_hashes(word, begin, stop), out


def _occurrences(value: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(value, kind="stable")
    held = value[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    start = np.flatnonzero(new)
    out = np.empty(len(value), np.int64)
    out[order] = np.arange(len(held)) - np.repeat(start, np.diff(np.append(start, len(held))))
    return out


def order_min_hashes(shingle: np.ndarray, sketches: int = SKETCHES, size: int = SKETCH_SIZE) -> np.ndarray:
    """One 64-bit key per sketch: its smallest labelled shingles, in text order."""
    label = arrays.mix(shingle + np.uint64(arrays.BASE) * _occurrences(shingle).astype(np.uint64))
    take = min(size, len(label))
    salt = arrays.mix(np.arange(1, sketches + 1, dtype=np.uint64))
    value = arrays.mix(label[None, :] ^ salt[:, None])
    if take < len(label):
        low = np.sort(np.argpartition(value, take - 1, axis=1)[:, :take], axis=1)
    else:
        low = np.broadcast_to(np.arange(take), (sketches, take))
    key = salt.copy()
    for place in range(take):
        key = key * np.uint64(arrays.BASE) + label[low[:, place]]
    return arrays.mix(key)


# Up to this many places, a value's bits are built each time it is met.
FEW_PLACES = 64


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence with matches at most ``band`` places apart.

    Bit-parallel: bit ``i`` of a window that slides along the diagonal stands for place
    ``j - band + i`` of ``a``; bits that leave the window are counted. Only places inside
    the window become bits. A value of many places keeps its bits, which slide along.
    """
    places: dict[int, list[int]] = {}
    for i, value in enumerate(a.tolist()):
        places.setdefault(value, []).append(i)
    kept: dict[int, tuple[int, int, int]] = {}  # bits, the place of bit 0, places taken in
    width = 2 * band + 1
    mask = (1 << width) - 1
    window, common = mask, 0
    for j, value in enumerate(b.tolist()):
        # Window covers places j - band .. j + band; places below 0 never match.
        if j:
            common += not window & 1
            window = (window >> 1) | (1 << (width - 1))
        found = places.get(value)
        if found is None:
            continue
        low, hit, taken = j - band, 0, 0
        if len(found) > FEW_PLACES:
            bits, before, taken = kept.get(value, (0, low, 0))
            hit = bits >> (low - before)
        while taken < len(found) and found[taken] <= j + band:
            if found[taken] >= low:
                hit |= 1 << (found[taken] - low)
            taken += 1
        if len(found) > FEW_PLACES:
            kept[value] = (hit, low, taken)
        both = window & hit
        window = ((window + both) | (window & ~hit)) & mask
    return common + width - bin(window).count("1")


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared shingles in order over all shingles; exact from ``least`` on, else below it."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    # least = L / (n + m - L) bounds the shingles outside the alignment, so the band.
    needed = least * (n + m) / (1 + least)
    common = banded_common(a, b, int(n + m - 2 * needed) + 1)
    return common / (n + m - common)


def _row_digests(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each row's sequence of shingles."""
    place = np.arange(len(shingle)) - np.repeat(at[:-1], np.diff(at))
    total = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mix(shingle + place.astype(np.uint64)))])
    return arrays.mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64))


def _sketched(sketches: int, size: int):
    """Id, digest, number of shingles and sketches of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches):
            shingle, at = shingles(part.column(1))
            digest = _row_digests(shingle, at)
            keys = [
                order_min_hashes(shingle[a:b], sketches, size) if b > a else np.zeros(0, np.uint64)
                for a, b in zip(at[:-1], at[1:])
            ]
            flat = np.concatenate(keys)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(digest.view(np.int64)), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                ],
                names=["doc_id", "digest", "n_shingles", "sketches"],
            )

    return run


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, digest and the shingles of each row, cut to 32 bits."""
    for part in arrays.slices(batches):
        shingle, at = shingles(part.column(1))
        digest = _row_digests(shingle, at)
        short = shingle.astype("<u4")
        held = [short[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(digest.view(np.int64)), pa.array(held, pa.binary())],
            names=["doc_id", "digest", "shingles"],
        )


def _sequence(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def _verified(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [
                similarity(_sequence(a), _sequence(b), least) >= least
                for a, b in zip(frame["left_shingles"], frame["right_shingles"])
            ]
            yield frame.loc[kept, ["src", "dst"]]

    return run


def group_links(ids: np.ndarray, classes: np.ndarray, texts: list[np.ndarray], across: np.ndarray | None, least: float) -> list[tuple]:
    """Links that join different classes of one group, at most one per pair of classes.

    Counts the shingles that a text shares with all others at once; only texts that share
    enough are aligned, and only while their classes are apart. With ``across`` only
    members with different marks are compared.
    """
    size = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    # Equal shingles of one text count as often as they occur in both.
    label = flat + arrays.mix(np.concatenate([_occurrences(t) for t in texts]).astype(np.uint64) + np.uint64(1))
    code, kinds = pd.factorize(label)
    begin = np.cumsum(size) - size
    flag = np.zeros(len(kinds), bool)
    parent = {int(c): int(c) for c in classes}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i in range(len(texts) - 1):
        flag[code[begin[i] : begin[i] + size[i]]] = True
        later = begin[i + 1]
        shared = np.add.reduceat(flag[code[later:]].astype(np.int64), begin[i + 1 :] - later)
        flag[code[begin[i] : begin[i] + size[i]]] = False
        union = size[i] + size[i + 1 :] - shared
        close = (shared >= least * union) & (classes[i + 1 :] != classes[i])
        if across is not None:
            close &= across[i + 1 :] != across[i]
        for j in (i + 1 + np.flatnonzero(close)).tolist():
            a, b = root(int(classes[i])), root(int(classes[j]))
            if a != b and similarity(texts[i], texts[j], least) >= least:
                parent[max(a, b)] = min(a, b)
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def _group_linker(least: float):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        same_chunk = key[1] == key[2]
        found = group_links(
            frame["doc_id"].to_numpy(), frame["class"].to_numpy(), [_sequence(x) for x in frame["shingles"]],
            None if same_chunk else frame["chunk"].to_numpy(), least,
        )
        return pd.DataFrame(found, columns=["src", "dst"])

    return run


def near_duplicate_classes(
    docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, size: int = SKETCH_SIZE
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept, one row per document.

    Texts with equal words are one text from the start. In each group of equal sketches
    all are aligned with one leader, the text whose sketches are shared most, so a group
    of n costs n alignments and most of a group of copies becomes one class. Groups that
    still hold several classes are compared across the classes in blocks, which return
    links and never pairs; so no link between classes of a group is lost to the leader.

    Null texts and texts without words are in no class but their own. Rows of one doc_id
    are one document with its smallest digest; a null doc_id cannot be told from another
    and is returned as it is, kept, without a class. Other columns are not read.
    """
    known = docs.select("doc_id", "text").where("doc_id is not null")
    schema = "doc_id long, digest long, n_shingles long, sketches array<bigint>"
    every = stored(
        known.mapInArrow(_sketched(sketches, size), schema)
        .groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "sketches")).alias("d"))
        .select("doc_id", "d.*")
    )
    same = stored(
        every.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("text_id"), F.first("sketches").alias("sketches"))
    )
    keys = same.select(F.col("text_id").alias("doc_id"), "digest", F.explode("sketches").alias("sketch"))
    shared = keys.groupBy("sketch").agg(F.count("*").alias("n")).where("n > 1")
    keys = stored(keys.join(shared, "sketch"))
    popularity = keys.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    leader = keys.join(popularity, "doc_id").groupBy("sketch").agg(
        F.max(F.struct("popularity", F.negative("doc_id").alias("minus"))).alias("top")
    ).select("sketch", F.negative("top.minus").alias("leader"))
    pairs = keys.join(leader, "sketch").where("doc_id <> leader").select(
        F.least("doc_id", "leader").alias("src"), F.greatest("doc_id", "leader").alias("dst")
    ).distinct()
    wanted = keys.select("doc_id", "digest").distinct()
    held = stored(
        known.mapInArrow(_with_shingles, "doc_id long, digest long, shingles binary")
        .join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).drop("digest")
    )
    both = pairs.join(held.select(F.col("doc_id").alias("src"), F.col("shingles").alias("left_shingles")), "src").join(
        held.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("right_shingles")), "dst"
    )
    links = stored(both.mapInPandas(_verified(least), "src long, dst long"))
    classes = stored(connected_components(links))
    more = stored(_across_classes(keys, classes, held, least))
    components = connected_components(links.unionByName(more))
    of_text = same.join(components, same["text_id"] == components["node"], "left").select(
        "digest", F.coalesce("component", "text_id").alias("class_id")
    )
    members = every.where("n_shingles > 0").join(of_text, "digest").select("doc_id", "class_id")
    single = every.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return members.unionByName(single).unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    )


def _across_classes(keys: DataFrame, classes: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Links between different classes that share a sketch.

    A group is dealt into chunks; each pair of chunks is a task, so no task holds more
    than two chunks of a group however large it is.
    """
    placed = keys.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "sketch", "n", "doc_id", F.coalesce("component", "doc_id").alias("class")
    )
    mixed = placed.groupBy("sketch").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    # Equal sets of members need one comparison, not one per sketch.
    alike = (
        placed.join(mixed.select("sketch"), "sketch", "left_semi").groupBy("sketch")
        .agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum"), F.max("n").alias("n"))
        .groupBy("sum", "n").agg(F.min("sketch").alias("sketch")).select("sketch")
    )
    placed = stored(placed.join(alike, "sketch", "left_semi"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    dealt = dealt.select(
        "sketch", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "doc_id", "class", "chunk",
    )
    return dealt.join(held, "doc_id").groupBy("sketch", "low", "high").applyInPandas(
        _group_linker(least), "src long, dst long"
    )
