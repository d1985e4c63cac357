import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seekspark.llm import queries, word_runs
from seekspark.llm.word_runs import block_matches, periodic_runs

SCHEMA = "doc_id long, text string, runs string, start int, n_words string"


def _brute(words):
    """Every run by its definition: maximal stretches per period, smallest period only."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                part = words[i : i + length]
                if all(part[r:] != part[:-r] for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _row(count, draw):
    kind = draw.random()
    if kind < 0.25:
        return [draw.randrange(2) for _ in range(draw.randrange(count))]
    if kind < 0.7:
        base = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(1, 12))]
        for _ in range(draw.randrange(1, 4)):
            base = (base * draw.randrange(2, 8))[draw.randrange(3) :] + [draw.randrange(3)] * draw.randrange(9)
            base = [draw.randrange(50) for _ in range(draw.randrange(6))] + base[:300]
        return base
    block = [draw.randrange(5000) for _ in range(draw.randrange(1, 70))]
    around = [[draw.randrange(5000) for _ in range(draw.randrange(30))] for _ in range(2)]
    return around[0] + (block * 8)[: draw.randrange(1, 500)] + around[1]


@pytest.mark.parametrize("cells", [1 << 19, 8])
def test_runs_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(word_runs, "CELLS", cells)
    draw = random.Random(cells)
    rows = [_row(120, draw) for _ in range(400 if cells > 8 else 60)]
    ends = np.cumsum([0] + [len(r) for r in rows])
    start, length, period = word_runs.word_runs(np.array(sum(rows, []), np.int64), ends)
    expected = [(s + ends[i], n, q) for i, r in enumerate(rows) for s, n, q in _brute(r)]
    assert list(zip(start, length, period)) == expected
    assert len(expected) > 100


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_block_matches_are_exact(size):
    rng = np.random.default_rng(size)
    for bits in (1, 7, 17, 27):
        blocks = rng.integers(0, 1 << min(bits, 3), (20, size)) * (1 << max(bits - 3, 0))
        windows = rng.integers(0, 1 << min(bits, 3), (20, 2 * size - 1)) * (1 << max(bits - 3, 0))
        windows[::2, size // 2 : size // 2 + size] = blocks[::2]
        expected = [[bool((w[j : j + size] == b).all()) for j in range(size)] for b, w in zip(blocks, windows)]
        assert block_matches(blocks, windows, bits).tolist() == expected


def test_long_texts_take_few_steps():
    ones = word_runs.word_runs(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert [list(map(int, c)) for c in ones] == [[0], [300_000], [1]]
    long = np.tile(np.random.default_rng(0).integers(0, 9000, 30_000), 5)
    assert [int(c[0]) for c in word_runs.word_runs(long, np.array([0, len(long)]))] == [0, 150_000, 30_000]
    mixed = np.tile([0] * 50 + [1], 3000)
    start, length, period = word_runs.word_runs(mixed, np.array([0, len(mixed)]))
    assert len(start) == 3001 and (153_000, 51) in set(zip(length.tolist(), period.tolist()))


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))

    def digest(value):
        return hashlib.sha256(value.encode()).hexdigest()

    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_equals_brute_force(spark):
    draw = random.Random(5)
    odd = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "x\x0by\x0cz\r" * 9, "É     " * 12, "ab " * 3000]
    texts = odd + [draw.choice([" ", "\n", " \t "]).join(f"w{c}" for c in _row(120, draw)) for _ in range(300)]
    rows = [(i - 3, t, "x", 1, None) for i, t in enumerate(texts)]
    rows += [rows[40]] * 20 + [(rows[41][0], "other other other other other other", "x", 1, None), (None, "a b " * 6, "x", 1, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in _query(spark, frame)]
    assert sorted(found, key=repr) == sorted((_expected(r[0], r[1]) for r in rows), key=repr)
    assert any(r[1] for r in found if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def _query(spark, frame):
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-")
    frame.write.parquet(f"{folder}/documents.parquet")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    result = queries.QUERIES["op13_periodic_runs"](spark, folder)
    assert {f.dataType.simpleString() for f in result.schema.fields[:6]} == {"bigint"}
    return result.select(*columns).collect()


def test_empty_table_and_general_interface(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert _query(spark, frame) == []
    frame = spark.createDataFrame([(1, "go a b a b  a b a b stop", "x", 1, None)], SCHEMA)
    row = periodic_runs(frame, "text", "doc_id").first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (10, [(1, 8, 2)], "go a b stop")
