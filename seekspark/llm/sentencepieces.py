"""SentencePiece encoding and decoding with a batched Viterbi search.

A text is cut before each word mark; every distinct word of a slice is encoded once, and
words of equal length advance through the lattice together. The hashes of all substrings
come from one prefix sum and probe the sorted piece keys; at each place a vectorised
maximum over the pieces that end there stores the back-pointers.

For unigram models the path maximises the sum of piece scores. A byte-pair model isn't
defined by a sum but by its merge order; there the lattice admits a piece only after a
predecessor beside which the merge order would leave it, which makes the path unique and
equal to the result of the merges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seekspark.llm import arrays

MARK = 0x2581
NONE = -1
# Bits of a hash that a table of seen values is indexed by; most probes end there.
SEEN_BITS = 21
CACHED_WORDS = 200_000
# Slices of a megabyte whose new words are encoded together.
GROUPED_SLICES = 4
MEMO_BITS = 20


def _seen(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << SEEN_BITS, bool)
    table[keys >> np.uint64(64 - SEEN_BITS)] = True
    return table


def _find(keys: np.ndarray, values: np.ndarray, seen: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Value of each probe in the sorted keys, or NONE."""
    out = np.full(len(probe), NONE)
    some = np.flatnonzero(seen[probe >> np.uint64(64 - SEEN_BITS)])
    if len(some):
        at = np.minimum(np.searchsorted(keys, probe[some]), len(keys) - 1)
        hit = keys[at] == probe[some]
        out[some[hit]] = values[at[hit]]
    return out


@dataclass
class PieceModel:
    """Arrays of a model's normal pieces, in the order of their scores, best first.

    Numbers below ``singles`` are pieces of one code point; ``singles`` itself stands for
    any code point without a piece; merged pieces follow in merge order.
    """

    merging: bool
    singles: int
    ids: np.ndarray  # model id of each number (NONE for the unknown)
    scores: np.ndarray
    keys: np.ndarray  # sorted hashes of the pieces, and their numbers
    numbers: np.ndarray
    sizes: np.ndarray  # code points of each number
    longest: int
    left: np.ndarray  # last merge of each number; itself if single
    right: np.ndarray
    pair_keys: np.ndarray  # sorted hashes of left * total + right, and what they merge to
    pair_merged: np.ndarray
    pairs: dict[int, int]
    seen_keys: np.ndarray
    seen_pairs: np.ndarray
    byte_ids: np.ndarray  # ids of the 256 byte pieces, or empty
    unknown_id: int
    prefix: bool
    output: np.ndarray  # bytes of all ids' texts, and where each begins
    output_at: np.ndarray

    @property
    def total(self) -> int:
        return len(self.ids)


def load_model(path: str) -> PieceModel:
    """Read a model file with the library; nothing is trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    merging = proto.trainer_spec.model_type == 2
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = proto.ModelProto.SentencePiece if hasattr(proto, "ModelProto") else type(proto.pieces[0])
    normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
    single = [x for x in normal if len(x[0]) == 1]
    merged = sorted((x for x in normal if len(x[0]) > 1), key=lambda x: (-x[1], x[2]))
    rows = [*single, ("", -1e6, NONE), *merged]
    number = {p: k for k, (p, _, _) in enumerate(rows) if p}
    points = [np.array([ord(c) for c in p], np.uint32) for p, _, _ in rows]
    size = np.array([len(p) for p in points])
    at = np.concatenate([[0], np.cumsum(size)])
    key = arrays.span_hashes(np.concatenate(points), at[:-1], at[1:])
    order = np.argsort(key)
    order = order[size[order] > 0]
    left, right = np.arange(len(rows)), np.arange(len(rows))
    pairs = {}
    for piece, _, _ in merged:
        for cut in range(1, len(piece)):
            a, b = number.get(piece[:cut]), number.get(piece[cut:])
            if a is not None and b is not None:
                pairs[a * len(rows) + b] = number[piece]
    if merging:
        for piece, _, _ in merged:
            cut = _last_merge([number.get(c, len(single)) for c in piece], pairs, len(rows))
            if cut:
                left[number[piece]], right[number[piece]] = cut
    pair_keys = arrays.mix(np.array(list(pairs), np.uint64))
    pair_merged = np.array(list(pairs.values()), np.int64)
    by_key = np.argsort(pair_keys)
    texts = []
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            texts.append(bytes([byte_ids.index(i)]))
        elif p.type == kinds.CONTROL:
            texts.append(b"")
        elif p.type == kinds.UNKNOWN:
            texts.append(proto.trainer_spec.unk_surface.encode())
        else:
            texts.append(p.piece.replace(chr(MARK), " ").encode())
    return PieceModel(
        merging, len(single), np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float),
        key[order], order, np.maximum(size, 1), int(size.max()), left, right, pair_keys[by_key],
        pair_merged[by_key], pairs, _seen(key[order]), _seen(pair_keys), np.array(byte_ids, np.int64),
        processor.unk_id(), proto.normalizer_spec.add_dummy_prefix,
        np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
    )


def _merge(parts: list[int], pairs: dict[int, int], total: int):
    """Merge the best pair, leftmost first, until none is left; yields each merge."""
    while len(parts) > 1:
        best = min(
            ((pairs[k], i) for i in range(len(parts) - 1) if (k := parts[i] * total + parts[i + 1]) in pairs),
            default=None,
        )
        if best is None:
            return
        merged, i = best
        pair = parts[i], parts[i + 1]
        parts[i : i + 2] = [merged]
        yield pair


def _last_merge(parts: list[int], pairs: dict[int, int], total: int):
    last = None
    for last in _merge(parts, pairs, total):
        pass
    return last if len(parts) == 1 else None


class PairMemo:
    """Answers about pairs, one per slot; a later pair replaces an earlier one."""

    def __init__(self):
        self.keys = np.full(1 << MEMO_BITS, NONE)
        self.good = np.zeros(1 << MEMO_BITS, bool)

    def ask(self, model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * model.total + b
        slot = ((key.astype(np.uint64) * np.uint64(arrays.BASE)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.good[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            out[new] = fresh = stands_beside(model, a[new], b[new])
            # Equal slots in one batch: the last write counts for both arrays alike.
            order = np.argsort(slot[new], kind="stable")
            at = slot[new][order]
            last = np.append(at[1:] != at[:-1], True)
            self.keys[at[last]], self.good[at[last]] = key[new][order][last], fresh[order][last]
        return out


def stands_beside(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging ``a`` and ``b`` together, from single code points, leaves both.

    Undoes the later of the two last merges again and again. At each step the parts that
    touch must not merge earlier than what was undone.
    """
    good = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(live):
        key = arrays.mix((a * model.total + b).astype(np.uint64))
        merged = _find(model.pair_keys, model.pair_merged, model.seen_pairs, key)
        bad = (merged != NONE) & (merged < limit)
        good[live[bad]] = False
        # The later last merge is undone; where it is a single piece, the other one.
        first = a > b
        a_whole, b_whole = model.right[a] == a, model.left[b] == b
        undo_a = np.where(first, ~a_whole, b_whole & ~a_whole)
        undo_b = ~undo_a & ~b_whole
        limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
        a, b = np.where(undo_a, model.right[a], a), np.where(undo_b, model.left[b], b)
        keep = ~bad & (undo_a | undo_b)
        live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
    return good


def viterbi(
    model: PieceModel, points: np.ndarray, start: np.ndarray, length: int, memo: PairMemo | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of words of one length: numbers word by word, and how many each has."""
    count = len(start)
    memo = memo or PairMemo()
    best = np.full((length + 1, count), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, count), np.int64)
    piece = np.full((length + 1, count), NONE)
    window = points[start[:, None] + np.arange(length)]
    hashes = arrays.SpanHashes(window.ravel())
    rows = np.arange(count) * length
    for end in range(1, length + 1):
        # With merge rules one piece at most fits; a word that has it is done here.
        rest = np.arange(count)
        for size in range(min(model.longest, end), 0, -1):
            begin = end - size
            number = _find(model.keys, model.numbers, model.seen_keys, hashes.of(rows[rest] + begin, rows[rest] + end))
            if size == 1:
                number[number == NONE] = model.singles
            some = np.flatnonzero((number != NONE) & np.isfinite(best[begin][rest]))
            if not len(some):
                continue
            word, chosen = rest[some], number[some]
            if model.merging and begin:
                fits = memo.ask(model, piece[begin][word], chosen)
                word, chosen, some = word[fits], chosen[fits], some[fits]
            score = best[begin][word] + model.scores[chosen]
            better = score > best[end][word]
            at, kept = word[better], chosen[better]
            best[end][at], piece[end][at], back[end][at] = score[better], kept, begin
            if model.merging and len(some):
                rest = np.delete(rest, some)
                if not len(rest):
                    break
    # Read the back-pointers of all words at once.
    steps, place = [], np.full(count, length)
    while place.any():
        here = np.where(place > 0, piece[place, np.arange(count)], NONE)
        steps.append(here)
        place = np.where(place > 0, back[place, np.arange(count)], 0)
    table = np.stack(steps[::-1], axis=1) if steps else np.zeros((count, 0), np.int64)
    used = table != NONE
    return table[used], used.sum(1)


def _encode_words(
    model: PieceModel, points: np.ndarray, begin: np.ndarray, end: np.ndarray, memo: PairMemo
) -> list[bytes]:
    """Ids of each word ``points[begin:end]``, as bytes of 32-bit numbers."""
    length = end - begin
    # Runs of word marks may all merge with equal rank, which only the merges decide.
    run = np.zeros(len(begin), bool)
    if model.merging and len(begin):
        mark = points == MARK
        double = np.concatenate([[0], np.cumsum(mark[1:] & mark[:-1]), [0]])
        double[-1] = double[-2] if len(points) else 0
        run = double[end - 1] - double[begin] > 0
    ids = [b""] * len(begin)
    for size in np.unique(length[~run]):
        group = np.flatnonzero((length == size) & ~run)
        for a in range(0, len(group), 1 << 14):
            part = group[a : a + (1 << 14)]
            numbers, count = viterbi(model, points, begin[part], int(size), memo)
            stop = np.cumsum(count)
            odd = np.add.reduceat(numbers == model.singles, stop - count) > 0
            plain = model.ids[numbers].astype(np.int32).tobytes()
            for word, x, y, unknown in zip(part.tolist(), (stop - count).tolist(), stop.tolist(), odd.tolist()):
                ids[word] = _to_ids(model, numbers[x:y].tolist(), points, int(begin[word])) if unknown else plain[4 * x : 4 * y]
    if run.any():
        number = {int(k): int(n) for k, n in zip(model.keys, model.numbers)}
        for word in np.flatnonzero(run).tolist():
            span = np.arange(begin[word], end[word])
            parts = [number.get(int(k), model.singles) for k in arrays.span_hashes(points, span, span + 1)]
            ids[word] = _to_ids(model, _merge_long(parts, model.pairs, model.total), points, int(begin[word]))
    return ids


class WordCache:
    """Ids of words seen before, in two generations: when the young one is full, the old
    one goes, and a word that is asked for again is young again."""

    def __init__(self, most: int = CACHED_WORDS) -> None:
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: int) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.pop(key, None)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: int, ids: bytes) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = ids


@dataclass
class _WordTable:
    """The words of some rows: distinct ``keys``, the word and row of each place."""

    keys: list[int]
    code: np.ndarray
    row: np.ndarray
    rows: int
    ids: list[bytes | None]
    new: list[int]
    points: np.ndarray  # those of the new words, one after the other
    lengths: np.ndarray


def _word_table(model: PieceModel, text: pa.Array, cache: WordCache) -> _WordTable:
    data, at = arrays.text_bytes(text)
    points, at = arrays.code_points(data, at)
    rows, size = len(at) - 1, np.diff(at)
    points = np.where(points == 32, MARK, points).astype(np.uint32)
    if model.prefix:
        line = np.full(len(points) + int((size > 0).sum()), MARK, np.uint32)
        shift = np.cumsum(size > 0)
        line[np.arange(len(points)) + np.repeat(shift, size)] = points
        points, at = line, at + np.concatenate([[0], shift])
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    mark = points == MARK
    before = np.concatenate([[False], mark[:-1]]) if len(mark) else mark
    start = np.flatnonzero(edge[:-1] | (mark & ~before))
    end = np.append(start[1:], len(points))
    row = np.searchsorted(at, start, "right") - 1
    code, keys = pd.factorize(arrays.span_hashes(points, start, end))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
    keys = keys.tolist()
    ids = [cache.get(k) for k in keys]
    new = [i for i, known in enumerate(ids) if known is None]
    a, length = start[first[new]], (end - start)[first[new]] if len(code) else np.zeros(0, np.int64)
    where = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return _WordTable(keys, code, row, rows, ids, new, points[where], length)


def encode_groups(
    model: PieceModel, texts: list[pa.Array], cache: WordCache | None = None, memo: PairMemo | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece ids of all rows and where each row begins, for each of ``texts``.

    The new words of all texts are grouped by length together, so that the arrays of one
    length are long; only those words are held, not the texts' code points.
    """
    cache = WordCache() if cache is None else cache
    tables = [_word_table(model, text, cache) for text in texts]
    keys = np.array([t.keys[i] for t in tables for i in t.new], np.uint64)
    points = np.concatenate([t.points for t in tables])
    lengths = np.concatenate([t.lengths for t in tables])
    end = np.cumsum(lengths)
    code, _ = pd.factorize(keys)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
    found = _encode_words(model, points, (end - lengths)[first], end[first], memo or PairMemo())
    for key, ids in zip(keys[first].tolist(), found):
        cache.put(key, ids)
    place = 0
    for table in tables:
        for i, c in zip(table.new, code[place : place + len(table.new)].tolist()):
            table.ids[i] = found[c]
        place += len(table.new)
        yield _joined(table)


def _joined(table: _WordTable) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, table.ids), np.int64, len(table.ids)) // 4
    flat = np.frombuffer(b"".join(table.ids), np.int32)
    code, out = table.code, flat
    length = np.zeros(0, np.int64)
    if len(code):
        length = count[code]
        offset = np.cumsum(count) - count
        out = flat[np.repeat(offset[code] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    total = np.bincount(table.row, weights=length, minlength=table.rows).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(total)])


def encode_rows(
    model: PieceModel, text: pa.Array, cache: WordCache | None = None, memo: PairMemo | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows and where each row begins."""
    return next(encode_groups(model, [text], cache, memo))


def _merge_long(parts: list[int], pairs: dict[int, int], total: int) -> list[int]:
    """Merges of a long word with a heap over linked parts."""
    import heapq

    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    alive = [True] * len(parts)
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < len(parts):
            merged = pairs.get(parts[i] * total + parts[j])
            if merged is not None:
                heapq.heappush(heap, (merged, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        push(i)
    while heap:
        merged, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = merged, False
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [p for p, ok in zip(parts, alive) if ok]


def _to_ids(model: PieceModel, numbers: list[int], points: np.ndarray, begin: int) -> bytes:
    if model.singles not in numbers:
        return model.ids[numbers].astype(np.int32).tobytes()
    out, place = [], begin
    for number in numbers:
        if number != model.singles:
            out.append(int(model.ids[number]))
            place += int(model.sizes[number])
            continue
        if len(model.byte_ids):
            out += model.byte_ids[list(chr(int(points[place])).encode("utf-8", "replace"))].tolist()
        elif not out or out[-1] != model.unknown_id:
            out.append(model.unknown_id)
        place += 1
    return np.array(out, np.int32).tobytes()


def _encoded_parts(model: PieceModel, batches: Iterator[pa.RecordBatch]):
    """``slice, ids, bounds`` of the texts in the first column, in order."""
    cache, memo, group = WordCache(), PairMemo(), []

    def encoded():
        for part, (ids, at) in zip(group, encode_groups(model, [p.column(0) for p in group], cache, memo)):
            yield part, ids, at

    for part in arrays.slices(batches, "encoded_text"):
        group.append(part)
        if len(group) == GROUPED_SLICES:
            yield from encoded()
            group = []
    if group:
        yield from encoded()


def encode_texts(docs: DataFrame, model_path: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every row of ``docs(text)``.

    Null and empty texts have no ids. Ids equal those of the library for the same file;
    whole texts are encoded, equal pieces by equal scores are settled leftmost, repeated
    rows are encoded each, and only ``text`` is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in _encoded_parts(shared.value, batches):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[*part.schema.names[1:], "ids"])

    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(docs["text"].alias("encoded_text"), *keep).mapInArrow(run, schema)


def decode_rows(model: PieceModel, flat: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[int]]:
    """Texts of rows of ids, and the checksum of each row's ids."""
    size = np.diff(model.output_at)
    texts, crcs = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        ids = flat[a:b]
        length = size[ids]
        where = np.repeat(model.output_at[ids] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        text = model.output[where].tobytes().decode("utf-8", "replace")
        texts.append(text[1:] if model.prefix and text.startswith(" ") else text)
        crcs.append(zlib.crc32(ids.astype("<i4").tobytes()))
    return texts, crcs


def decode_ids(rows: DataFrame, model_path: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``decoded`` and ``ids_crc32`` of every row of ``rows(ids)``.

    The inverse of encoding: byte pieces join to characters (broken ones become U+FFFD),
    word marks become blanks and the blank put before the text goes. Null ids decode to
    an empty text. ids_crc32 is over the ids as little-endian 32-bit numbers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            column = part.column(0)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            count = np.array([len(x) if x.is_valid else 0 for x in column]) if column.null_count else np.diff(column.offsets.to_numpy())
            texts, crcs = decode_rows(shared.value, flat, np.concatenate([[0], np.cumsum(count)]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(texts, pa.string()), pa.array(crcs, pa.int64())],
                names=[*part.schema.names[1:], "decoded", "ids_crc32"],
            )

    schema = rows.select(*keep).schema.add("decoded", "string").add("ids_crc32", "long")
    return rows.select("ids", *keep).mapInArrow(run, schema)


def round_trips(docs: DataFrame, model_path: str, *keep: str) -> DataFrame:
    """``keep`` columns, n_ids, ids_crc32 and whether the text came back (``round_trip``).

    Encodes and decodes each row of ``docs(text)`` in one pass, as ``encode_texts`` and
    ``decode_ids`` do; a null text counts as an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in _encoded_parts(shared.value, batches):
            texts, crcs = decode_rows(shared.value, ids, at)
            same = pc.equal(pa.array(texts, pa.string()), pc.fill_null(part.column(0).cast(pa.string()), ""))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(np.diff(at)), pa.array(crcs, pa.int64()), same],
                names=[*part.schema.names[1:], "n_ids", "ids_crc32", "round_trip"],
            )

    schema = docs.select(*keep).schema.add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    return docs.select(docs["text"].alias("encoded_text"), *keep).mapInArrow(run, schema)
