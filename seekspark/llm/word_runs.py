"""Periodic runs of words by block convolution, and texts with the repeats folded away.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` words long,
that no neighbouring word extends with the same period.

Periods from L to 2 L - 1 are found at the dyadic scale L. A run of such a period holds two
or more whole blocks of L aligned words, each of which occurs again q words later. For a
block and the window of 2 L - 1 words that starts L words after the block, the sums of
squared differences of word numbers over all L shifts are block squares plus window
squares minus twice a correlation. The correlation is a number-theoretic transform modulo
a prime above every possible sum, so a sum is zero exactly where the block occurs. Word
numbers are cut into digits to keep the sums small; all digits share one inverse transform.
Neighbouring blocks with a common distance seed a stretch, which less than a block on
either side completes.

Work is saved only where nothing can be lost: a block takes part if each of its words
occurs again within 2 L - 1 words, as it must inside such a run. A block inside a known
run of a period up to L / 4 matches everywhere in it; a new run crosses one end of the
known run, so its distance leads from that end to the same end of another known run. This
leaves a fixed number of seeds per block, also in texts of one repeated word.

Defined cases: a null text has no words, no runs and an empty collapsed text. Rows are
independent of each other, so repeated rows and null ids are kept as they are; an empty
table gives an empty result; only the named columns are read. Texts are handled whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.arrays import slices, text_bytes
from seekspark.scale import let

# A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# A prime 15 * 2**27 + 1, of which 31 is a primitive root: transforms of up to 2**27.
PRIME, ROOT = 15 * 2**27 + 1, 31
# Numbers handled at once in one matrix.
CELLS = 1 << 19
FAR = 1 << 40
BLANKS = r"[\x20\x09-\x0D]+"


@functools.cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    step = pow(ROOT, (PRIME - 1) // size, PRIME)
    step = pow(step, PRIME - 2, PRIME) if inverse else step
    powers = np.ones(max(size // 2, 1), np.int64)
    done = 1
    while done < len(powers):
        powers[done : 2 * done] = powers[:done] * pow(step, done, PRIME) % PRIME
        done *= 2
    return powers


def _forward(values: np.ndarray) -> np.ndarray:
    """Transform of each row in place; the result is in bit-reversed order."""
    rows, size = values.shape
    while size > 1:
        half = size // 2
        v = values.reshape(rows, -1, size)
        low, high = v[:, :, :half], v[:, :, half:]
        turned = (low - high + PRIME) * _powers(size, False) % PRIME
        low += high
        low -= PRIME * (low >= PRIME)
        high[...] = turned
        size = half
    return values


def _backward(values: np.ndarray) -> np.ndarray:
    """Inverse of ``_forward`` in place."""
    rows, whole = values.shape
    size = 2
    while size <= whole:
        half = size // 2
        v = values.reshape(rows, -1, size)
        low, high = v[:, :, :half], v[:, :, half:]
        turned = high * _powers(size, True) % PRIME
        np.subtract(low, turned, out=high)
        high += PRIME * (high < 0)
        low += turned
        low -= PRIME * (low >= PRIME)
        size *= 2
    values *= pow(whole, PRIME - 2, PRIME)
    values %= PRIME
    return values


def _digit_bits(size: int, bits: int) -> int:
    """Widest digits for which a sum over ``size`` words stays below the prime."""
    for width in range(min(bits, 15), 0, -1):
        if -(-bits // width) * size * (2**width - 1) ** 2 < PRIME:
            return width
    raise ValueError("texts of over 2**27 words aren't supported")


def block_matches(blocks: np.ndarray, windows: np.ndarray, bits: int) -> np.ndarray:
    """Where row i of ``blocks`` (L numbers) occurs in row i of ``windows`` (2 L - 1)."""
    rows, size = blocks.shape
    width = _digit_bits(size, bits)
    squares = np.zeros((rows, size), np.int64)
    product = np.zeros((rows, 2 * size), np.int64)
    for shift in range(0, bits, width):
        block = (blocks >> shift) & ((1 << width) - 1)
        window = (windows >> shift) & ((1 << width) - 1)
        sums = np.zeros((rows, 2 * size), np.int64)
        np.cumsum(window * window, axis=1, out=sums[:, 1:])
        squares += sums[:, size:] - sums[:, :size] + (block * block).sum(axis=1, keepdims=True)
        turned = np.zeros((rows, 2 * size), np.int64)
        turned[:, 0] = block[:, 0]
        turned[:, size + 1 :] = block[:, :0:-1]
        padded = np.zeros((rows, 2 * size), np.int64)
        padded[:, :-1] = window
        product += _forward(turned) * _forward(padded) % PRIME
    product %= PRIME
    correlation = _backward(product)[:, :size]
    return (squares - 2 * correlation) % PRIME == 0


def _next_distance(codes: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """Words to the next occurrence of the same word in the row; FAR if there is none."""
    small = codes.astype(np.uint16) if len(codes) and codes.max() < 1 << 16 else codes
    order = np.argsort(small, kind="stable")
    here, there = order[:-1], order[1:]
    same = (codes[here] == codes[there]) & (there < row_end[here])
    distance = np.full(len(codes), FAR, np.int64)
    distance[here[same]] = there[same] - here[same]
    return distance


def word_runs(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, sorted by start and period.

    ``codes`` holds the word numbers of all rows, row r between ``ends[r]`` and
    ``ends[r + 1]``; starts are places in ``codes``.
    """
    runs = np.zeros((3, 0), np.int64)
    if not len(codes):
        return tuple(runs)
    sizes = np.diff(ends)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    bits = max(int(codes.max() + 1).bit_length(), 1)
    rows = np.flatnonzero(sizes >= LEAST_WORDS)
    # The farthest next occurrence within each block; two blocks make one of the next scale.
    farthest = _next_distance(codes, ends[1:][row_of])
    first, size = ends[:-1], 1
    while len(rows):
        count = sizes[rows] // size
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if size > 1:
            pair = np.repeat(first[rows], count) + 2 * within
            farthest = np.maximum(farthest[pair], farthest[pair + 1])
        else:
            farthest = farthest[np.repeat(first[rows], count) + within]
        first = np.zeros(len(sizes), np.int64)
        first[rows] = np.cumsum(count) - count
        starts = np.repeat(ends[rows], count) + size * within
        runs = _merged(runs, _runs_of_scale(codes, ends, row_of, bits, size, starts[farthest < 2 * size], runs))
        size *= 2
        rows = rows[sizes[rows] >= LEAST_PERIODS * size]
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def _merged(runs: np.ndarray, more: np.ndarray) -> np.ndarray:
    """All runs by start; of runs with one extent the one with the smallest period."""
    runs = np.concatenate([runs, more], axis=1)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return runs[:, new]


def _holder(known: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Number of the known run that holds ``size`` words from ``start``; -1 if none.

    Known runs of a quarter of the period overlap by less than half a block, so in the
    order of their starts their ends rise too.
    """
    place = np.searchsorted(known[0], start, "right") - 1
    inside = (place >= 0) & (known[0, place] + known[1, place] >= start + size) if known.shape[1] else place >= 0
    return np.where(inside, place, -1)


def _runs_of_scale(codes, ends, row_of, bits, size, starts, runs) -> np.ndarray:
    none = np.zeros((3, 0), np.int64)
    known = runs[:, (LEAST_PERIODS * runs[2] <= size) & (runs[1] >= size)]
    starts = starts[_holder(known, starts, 3 * size) < 0]
    # A run holds two neighbouring blocks.
    beside = np.zeros(len(starts), bool)
    beside[1:] |= starts[1:] - starts[:-1] == size
    beside[:-1] |= starts[1:] - starts[:-1] == size
    starts = starts[beside]
    if not len(starts):
        return none
    found = []
    chunk = max(CELLS // (2 * size), 1)
    for a in range(0, len(starts), chunk):
        part = starts[a : a + chunk]
        place = part[:, None] + size + np.arange(2 * size - 1)
        open_end = ends[1:][row_of[part]][:, None]
        window = np.where(place < open_end, codes[np.minimum(place, len(codes) - 1)], codes.max() + 1)
        block, shift = np.nonzero(block_matches(codes[part[:, None] + np.arange(size)], window, bits))
        found.append((part[block], shift + size))
    start = np.concatenate([s for s, _ in found])
    distance = np.concatenate([d for _, d in found])
    held, again = _holder(known, start, size), _holder(known, start + distance, size)
    both = (held >= 0) & (again >= 0)
    if both.any():
        low, high = known[0], known[0] + known[1]
        aligned = (high[again] - high[held] == distance) | (low[again] - low[held] == distance)
        fine = ~both | ((held != again) & aligned)
        start, distance = start[fine], distance[fine]
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    opens = np.ones(len(start), bool)
    opens[1:] = (distance[1:] != distance[:-1]) | (start[1:] - start[:-1] != size)
    heads = np.flatnonzero(opens)
    last = np.append(heads[1:], len(start)) - 1
    heads, last = heads[last > heads], last[last > heads]
    if not len(heads):
        return none
    period = distance[heads]
    row = row_of[start[heads]]
    left = start[heads] - _reach(codes, start[heads] - 1, -1, period, size, ends[row], ends[row + 1])
    right = start[last] + size
    right = right + _reach(codes, right, 1, period, size, ends[row], ends[row + 1])
    length = right - left + period
    whole = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.stack([left[whole], length[whole], period[whole]])


def _reach(codes, place, step, period, size, low, high) -> np.ndarray:
    """How many words from ``place`` on, in direction ``step``, equal those a period later."""
    out = np.zeros(len(place), np.int64)
    chunk = max(CELLS // size, 1)
    for a in range(0, len(place), chunk):
        part = slice(a, a + chunk)
        at = place[part, None] + step * np.arange(size)
        later = at + period[part, None]
        inside = (at >= low[part, None]) & (later < high[part, None])
        edge = len(codes) - 1
        same = inside & (codes[np.clip(at, 0, edge)] == codes[np.clip(later, 0, edge)])
        out[part] = np.where(same.all(axis=1), size, same.argmin(axis=1))
    return out


def _folded(words: list[bytes], start, length, period) -> bytes:
    """Words outside the repeats of the runs, joined by a blank."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for part in slices(batches):
        data, at = text_bytes(part.column(part.num_columns - 1))
        raw = data.tobytes()
        words: list[bytes] = []
        ends = [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            words += raw[a:b].split()
            ends.append(len(words))
        ends = np.array(ends, np.int64)
        index: dict[bytes, int] = {}
        codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        start, length, period = word_runs(codes, ends)
        bounds = np.searchsorted(start, ends)
        texts = []
        for r, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            x, y = bounds[r], bounds[r + 1]
            mine = words[a:b]
            texts.append(_folded(mine, start[x:y] - a, length[x:y], period[x:y]) if y > x else b" ".join(mine))
        local = start - np.repeat(ends[:-1], np.diff(bounds))
        runs = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], fields=list(run_type)),
        )
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array(np.diff(ends)), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=names
        )


def periodic_runs(docs: DataFrame, text: str | Column, *keep: str) -> DataFrame:
    """``keep`` columns, ``n_words``, all ``runs`` by start and period, and the text
    without what the runs repeat (``collapsed``, its words joined by one blank)."""
    frame = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]]
    added = ["n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]
    names = [*keep, "n_words", "runs", "collapsed"]
    return frame.mapInArrow(lambda batches: _rows(batches, names), ", ".join(kept + added))


def longest_run(runs: str) -> Column:
    """The longest run; of equally long ones the first, then that of the smallest period."""
    best = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_planted_period(text: str, key: Column) -> Column:
    """Text whose tail repeats for one key in ten, as ``key`` (a non-negative integer) says.

    With g = key div 10, the words from a = g % n on repeat the first
    p = 1 + (n - a) div (3 + g % 8) of them.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), lambda w: w != "")
    g = F.floor(key / 10)

    def planted(w: Column) -> Column:
        def tail(b: Column) -> Column:
            a, p = b["a"], b["p"]
            place = F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1)
            return F.array_join(
                F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "
            )

        a = g % F.size(w)
        bounds = F.struct(a.alias("a"), (1 + F.floor((F.size(w) - a) / (3 + g % 8))).alias("p"))
        return F.when(F.size(w) > 0, let(bounds, tail)).otherwise("")

    return F.when(key % 10 == 0, let(words, planted)).otherwise(F.col(text))
