"""Array views of Arrow text columns: bytes, code points, words and their hashes.

Everything works on slices of a few megabytes, so a task's memory is bounded by its
longest single text and not by its number of rows.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

SLICE_BYTES = 1 << 20
# Odd multiplier of the rolling hash and the constants of the SplitMix64 finalizer.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK = (1 << 64) - 1
# Code points looked up at once; divides the number of surrogates and where they begin.
CLASS_BLOCK = 1 << 11


def release_memory() -> None:
    """Give back to the system what earlier tasks of this worker have freed.

    Python workers serve one task after another; without this the allocators keep the
    peak of every stage that ran before.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps its free memory
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    release_memory()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum(_lengths(text), out=size[1:])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(size, size[start] + limit, "right")) - 1
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(text: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(text)[1])


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and where each row begins; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = text.buffers()
    at = np.frombuffer(at, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and where each row begins."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == heads[-1]:
            return points, heads[at]
    except UnicodeDecodeError:
        pass
    rows = [
        np.frombuffer(
            data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32
        )
        for a, b in zip(at[:-1], at[1:])
    ]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), ends


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << bits
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    for out, base in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        out[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            np.multiply(out[:filled], step, out=out[filled : 2 * filled])
            filled *= 2
    return up, down


def mix(value: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(MIX[0])
    value ^= value >> np.uint64(27)
    value *= np.uint64(MIX[1])
    value ^= value >> np.uint64(31)
    return value


class SpanHashes:
    """64-bit hashes of any spans of ``values``, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(4, int(len(values)).bit_length()))
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHashes(values).of(start, end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = _space_table()


def words(data: np.ndarray, at: np.ndarray):
    """Runs of bytes that are no ASCII white space: start, end and row of each."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


@functools.cache
def class_table() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    table = np.zeros(0x110000, np.uint8)
    kinds = [(1, regex.compile(r"\p{L}+")), (2, regex.compile(r"\p{N}+")), (3, regex.compile(r"\p{White_Space}+"))]
    # Block by block, because a string of all code points takes a worker 100 MB for a moment.
    for begin in range(0, len(table), CLASS_BLOCK):
        if 0xD800 <= begin < 0xE000:
            continue
        every = "".join(map(chr, range(begin, begin + CLASS_BLOCK)))
        for code, pattern in kinds:
            for found in pattern.finditer(every):
                a, b = found.span()
                table[begin + a : begin + b] = code
    return table


@functools.cache
def lower_table() -> np.ndarray:
    """Simple lower case of every code point of the basic plane."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x10000):
        small = chr(point).lower()
        if len(small) == 1:
            table[point] = ord(small)
    return table
