"""Token packing by bounded-space online best fit.

Each task packs the pieces of its rows as they come. It keeps a fixed number of open
bins; an integer used as a bitset has bit ``f`` set while some open bin has ``f`` free
places, so the best fit is the lowest set bit at or above a piece's length. When a new
bin is needed and none may be opened, the fullest bin closes. Bins that are still open
at the end of a task are packed again, each as one item, by far fewer tasks.
"""

from __future__ import annotations

import array
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import arrays
from seekspark.llm.frames import doc_text, stored

SEQUENCE_TOKENS = 1024
END_ID = 2
OPEN_BINS = 512
# Text encoded at once; the arrays made of it take about fifty times as much.
SLICE_BYTES = 1 << 18
# One task of the second round packs the open bins of this many first-round tasks.
TASKS_PER_MERGE = 64
TASK_BITS = 33

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "bin long, at long, used long, closed boolean"
)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _merger(path: str):
    """Encoder of one pretoken's bytes, or None if the file's merges aren't in rank order.

    In a byte-level vocabulary whose ids are 256 plus the merge's rank, merging by lowest
    id equals merging by rank; the rank encoder is three times as fast on short strings.
    """
    import tiktoken

    model = json.loads(_tokenizer(path).to_str())["model"]
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)
    }
    encoding = tiktoken.Encoding(path, pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


class PieceCache:
    """Ids of pretokens by hash, as the bytes of 32-bit numbers, a third of a list's size.

    Emptied when full, which costs time and nothing else.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.path, self.most, self.known = path, most, {}

    def ids(self, keys: np.ndarray, text_of) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known, keys = self.known, keys.tolist()
        new = [i for i, key in enumerate(keys) if key not in known]
        merge = _merger(self.path)
        texts = [text_of(i) for i in new]
        if merge is not None:
            found = map(merge, texts)
        else:
            found = (e.ids for e in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False))
        for i, one in zip(new, found):
            known[keys[i]] = array.array("I", one).tobytes()
        return [known[key] for key in keys]


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def pretoken_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer begins a pretoken, for texts without apostrophes.

    Runs of letters, of numbers and of other visible characters, each with one blank
    before it; of a longer run of white space the last character stands apart if
    something visible follows.
    """
    kind = arrays.class_table()[points]
    space = kind == 3
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    first, last = edge[:-1], edge[1:]
    was_space, was_kind, was_blank = (np.zeros_like(space), np.zeros_like(kind), np.zeros_like(space))
    was_space[1:], was_kind[1:], was_blank[1:] = space[:-1], kind[:-1], points[:-1] == 32
    next_space = np.zeros_like(space)
    next_space[:-1] = space[1:]
    visible_next = ~last & ~next_space
    return np.flatnonzero(
        first
        | (space & ~was_space)
        | (~space & ~was_space & (kind != was_kind))
        | (~space & was_space & ~was_blank)
        | (space & was_space & visible_next)
    )


def encode_rows(text: pa.Array, path: str, cache: PieceCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows and where each row begins; every pretoken is encoded once."""
    data, at = arrays.text_bytes(text)
    rows = len(at) - 1
    specials = _specials(path)
    odd = np.zeros(rows, bool)  # rows the plain rule doesn't cover
    quote = np.flatnonzero(data == 39)
    odd[np.searchsorted(at, quote, "right") - 1] = True
    for mark in specials:
        whole, found = data.tobytes(), -1
        sign = mark.encode()
        while (found := whole.find(sign, found + 1)) >= 0:
            odd[int(np.searchsorted(at, found, "right")) - 1] = True
    points, at = arrays.code_points(data, at)
    start = pretoken_starts(points, at)
    end = np.append(start[1:], len(points))
    row = np.searchsorted(at, start, "right") - 1
    plain = ~odd[row]
    start, end, row = start[plain], end[plain], row[plain]
    code, keys = pd.factorize(arrays.span_hashes(points, start, end))
    fresh = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    begins, stops = start[fresh].tolist(), end[fresh].tolist()
    cache = cache or PieceCache(path)
    ids = cache.ids(keys, lambda i: whole[begins[i] : stops[i]])
    odd_rows = np.flatnonzero(odd)
    texts = [whole[at[r] : at[r + 1]] for r in odd_rows]
    encoded = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
    ids += [array.array("I", e.ids).tobytes() for e in encoded]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    # Units in row order: pretokens of plain rows, and each odd row as one unit.
    unit = np.concatenate([code, len(fresh) + np.arange(len(odd_rows))]).astype(np.int64)
    owner = np.concatenate([row, odd_rows])
    order = np.argsort(owner, kind="stable")
    unit, owner = unit[order], owner[order]
    begin = np.cumsum(size) - size
    length = size[unit]
    tokens = flat[
        np.repeat(begin[unit] - (np.cumsum(length) - length), length)
        + np.arange(int(length.sum()))
    ]
    total = np.bincount(owner, weights=length, minlength=rows).astype(np.int64)
    return tokens, np.concatenate([[0], np.cumsum(total)])


class OpenBins:
    """Open bins of ``capacity``; ``free`` is a bitset of the free places that occur."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.by_free: dict[int, list[int]] = {}
        self.used: dict[int, int] = {}
        self.next = 0

    def _enter(self, key: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(key)
        self.free |= 1 << free

    def _leave(self, free: int) -> int:
        keys = self.by_free[free]
        key = keys.pop()
        if not keys:
            self.free &= ~(1 << free)
        return key

    def put(self, length: int) -> tuple[int, int, list[int]]:
        """Bin and offset of an item, and the bins that closed meanwhile."""
        closed = []
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            key = self._leave(free)
        else:
            if len(self.used) >= self.most:
                fullest = self._leave((self.free & -self.free).bit_length() - 1)
                del self.used[fullest]
                closed.append(fullest)
            free, key = self.capacity, self.next
            self.next += 1
            self.used[key] = 0
        offset = self.used[key]
        self.used[key] = offset + length
        if free == length:
            del self.used[key]
            closed.append(key)
        else:
            self._enter(key, free - length)
        return key, offset, closed


def _pieces(tokens: np.ndarray, at: np.ndarray, capacity: int):
    """Row, number, start and end of each piece; the first of a row takes the remainder."""
    for row in range(len(at) - 1):
        begin, total = int(at[row]), int(at[row + 1] - at[row])
        first = (total - 1) % capacity + 1
        cuts = [0, *range(first, total, capacity), total]
        for number in range(len(cuts) - 1):
            yield row, number, begin, cuts[number], cuts[number + 1]


def _with_end(tokens: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(at) - 1
    out = np.empty(len(tokens) + rows, np.uint32)
    ends = at[1:] + np.arange(rows)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = tokens, end_id
    return out, np.concatenate([[0], ends + 1])


def _packer(path: str, capacity: int, end_id: int, open_bins: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32())]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "bin", "at", "used")]
        + [("closed", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << TASK_BITS
        bins = OpenBins(capacity, open_bins)
        waiting: dict[int, list] = {}
        done: list[tuple] = []
        cache = PieceCache(path)

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema
            )
            done.clear()
            return out

        def close(key: int, full: bool) -> None:
            held = waiting.pop(key)
            used = sum(x[3] for x in held)
            done.extend((*x, base + key, y, used, full) for *x, y in held)

        for part in arrays.slices(batches, limit=SLICE_BYTES):
            ids = part.column(0).to_pylist()
            tokens, at = _with_end(*encode_rows(part.column(1), path, cache), end_id)
            raw = tokens.astype("<u4")
            for row, number, begin, a, b in _pieces(tokens, at, capacity):
                key, offset, closed = bins.put(b - a)
                crc = zlib.crc32(raw[begin + a : begin + b].tobytes())
                waiting.setdefault(key, []).append((ids[row], number, a, b - a, crc, offset))
                for one in closed:
                    close(one, True)
            if len(done) >= 10_000:
                yield flush()
        for key in list(waiting):
            close(key, False)
        if done:
            yield flush()

    return run


def _repacker(capacity: int, open_bins: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (TaskContext.get().partitionId() << TASK_BITS) | (1 << (TASK_BITS - 1))
        bins = OpenBins(capacity, open_bins)
        for frame in frames:
            placed = [bins.put(int(n))[:2] for n in frame["used"]]
            yield pd.DataFrame(
                {
                    "bin": frame["bin"],
                    "sequence_id": [base + key for key, _ in placed],
                    "shift": [offset for _, offset in placed],
                }
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids are those of the tokenizer file without added special tokens, then
    ``end_id``. Longer texts are cut into pieces of ``capacity``; the first takes the
    remainder. A null or empty text is the end id alone; a null doc_id stays null and its
    pieces are packed like others; repeated rows are packed each; no rows give no rows.
    Pieces of one length are interchangeable, so ties need no rule: any placement is
    a valid result. Other columns of ``docs`` are not read.

    The tokenizer file must be readable on every worker under the same path.
    """
    spark = docs.sparkSession
    packed = stored(
        doc_text(docs).mapInArrow(_packer(tokenizer_path, capacity, end_id, open_bins), PIECES)
    )
    closed = packed.where("closed").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("bin").alias("sequence_id"), F.col("at").alias("offset"),
    )
    rest = packed.where("not closed")
    # Open bins are few per task and their number is known to be at most open_bins.
    tasks = packed.select(F.shiftright("bin", TASK_BITS).alias("task")).agg(F.max("task")).first()[0]
    merges = 1 if tasks is None else tasks // TASKS_PER_MERGE + 1
    group = F.floor(F.shiftright("bin", TASK_BITS) / TASKS_PER_MERGE).cast("int")
    open_rows = (
        rest.select("bin", "used").distinct()
        .repartition(merges, group)
        .sortWithinPartitions(F.desc("used"), "bin")
    )
    moved = stored(
        open_rows.mapInPandas(_repacker(capacity, open_bins), "bin long, sequence_id long, shift long")
    )
    reopened = rest.join(moved, "bin").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        (F.col("at") + F.col("shift")).alias("offset"),
    )
    return closed.unionByName(reopened)
