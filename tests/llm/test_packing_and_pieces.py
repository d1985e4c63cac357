import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seekspark.llm.packing import OpenBins, encode_rows, pack_documents
from seekspark.llm.sentencepieces import decode_ids, encode_texts, load_model
from seekspark.llm import sentencepieces

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, sequence_id string, offset string"


def _texts(count, seed):
    draw = random.Random(seed)
    letters = "ab1 \n\té½中'<|>!.　\x1c\x85​sre▁\U0001F600Ⅷ"
    odd = [None, "", "<|endoftext|>", "a <|endoftext|> b", "it's  we'll", " ", "  a", "x" + " " * 70 + "y"]
    return odd + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(count)]


def test_token_ids_equal_the_tokenizers():
    texts = _texts(800, 1)
    ids, at = encode_rows(pa.array(texts, pa.string()), BYTE_BPE)
    whole = Tokenizer.from_file(BYTE_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, expected in enumerate(whole):
        assert ids[at[i] : at[i + 1]].tolist() == expected.ids, texts[i]


def test_open_bins_place_best_fit_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert bins.put(6)[:2] == (0, 0)
    assert bins.put(7)[:2] == (1, 0)
    assert bins.put(3)[:2] == (1, 7)  # three free places fit exactly
    key, offset, closed = bins.put(5)
    assert (offset, closed) == (0, [])
    assert bins.put(8)[2] == [0]  # no bin may open: the fullest closes


def _valid(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        place = 0
        for r in held:
            assert r["offset"] == place
            place += r["length"]
        assert place <= capacity
    return len(by_sequence)


def test_packing_is_whole_gapless_and_tight(spark):
    draw = random.Random(5)
    texts = [None, "", "word"] + [" ".join(draw.choice("alpha beta gamma delta".split()) for _ in range(draw.randint(1, 90))) for _ in range(300)]
    rows = [(i, t, "other", "clash") for i, t in enumerate(texts)] + [(5, texts[5], "again", None), (None, "no id", None, None)]
    found = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), BYTE_BPE, capacity=64, open_bins=16).collect()
    sequences = _valid(found, 64)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    expected = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=key) == sorted(expected, key=key)
    total = sum(r["length"] for r in found)
    assert sequences <= 1.1 * total / 64 + 1


def test_packing_of_nothing(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), BYTE_BPE).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def test_piece_ids_equal_the_library(library):
    texts = _texts(800, 2)
    ids, at = sentencepieces.encode_rows(load_model(PIECE_BPE), pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or ""), text


def test_unigram_path_has_the_largest_sum():
    """The lattice without merge rules against all segmentations of short words."""
    from dataclasses import replace

    model = replace(load_model(PIECE_BPE), merging=False)
    score = {}
    draw = random.Random(3)
    words = ["".join(draw.choice("theinrs") for _ in range(draw.randint(1, 7))) for _ in range(60)]

    def piece_score(text):
        if text not in score:
            points = np.array([ord(c) for c in text], np.uint32)
            key = sentencepieces.arrays.span_hashes(points, np.array([0]), np.array([len(points)]))
            number = sentencepieces._find(model.keys, model.numbers, model.seen_keys, key)[0]
            if number == sentencepieces.NONE and len(text) == 1:
                number = model.singles
            score[text] = (-np.inf if number == sentencepieces.NONE else model.scores[number], int(number))
        return score[text]

    def best(text):
        if not text:
            return 0.0
        return max(piece_score(text[:k])[0] + best(text[k:]) for k in range(1, len(text) + 1))

    for word in words:
        points = np.array([ord(c) for c in word], np.uint32)
        numbers, _ = sentencepieces.viterbi(model, points, np.array([0]), len(word))
        assert np.isclose(model.scores[numbers].sum(), best(word))


def test_encode_and_decode_round_trip(spark):
    texts = _texts(60, 4) + ["a" * 5000]
    rows = [(i, t, str(i), "x") for i, t in enumerate(texts)] + [(0, texts[0], "0", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    encoded = encode_texts(docs, PIECE_BPE, "doc_id")
    back = decode_ids(encoded, PIECE_BPE, "doc_id").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r["decoded"] == (texts[r["doc_id"]] or "").replace("▁", " ")
    assert encode_texts(docs.limit(0), PIECE_BPE, "doc_id").count() == 0


def test_grouped_slices_and_small_caches_give_the_same_ids(spark, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "GROUPED_SLICES", 3)
    monkeypatch.setattr(sentencepieces.arrays, "SLICE_BYTES", 200)
    monkeypatch.setattr(sentencepieces, "CACHED_WORDS", 10)
    texts = _texts(200, 6)
    parts = [pa.array(texts[a : a + 30], pa.string()) for a in range(0, len(texts), 30)]
    cache = sentencepieces.WordCache(10)
    found = []
    for ids, at in sentencepieces.encode_groups(load_model(PIECE_BPE), parts, cache):
        found += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
    assert found == [library.encode(t or "") for t in texts]
    assert len(cache.young) <= 5 and len(cache.old) <= 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = sentencepieces.round_trips(docs, PIECE_BPE, "doc_id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text)
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert r["round_trip"] == (text == text.replace("▁", " "))
    assert sentencepieces.round_trips(docs.limit(0), PIECE_BPE, "doc_id").count() == 0


def test_character_classes_need_little_memory():
    import tracemalloc

    import regex

    from seekspark.llm import arrays

    tracemalloc.start()
    table = arrays.class_table.__wrapped__()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000
    for code in (0x41, 0x39, 0x20, 0x2E, 0x7FF, 0x800, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0x4E00, 0xFFFF, 0x10000, 0x1F600, 0x2F800, 0x10FFFF):
        kinds = [k for k, p in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}")) if regex.fullmatch(p, chr(code))]
        assert table[code] == (kinds[0] if kinds and not 0xD800 <= code < 0xE000 else 0)


def test_the_pipeline_packs_small_batches(spark):
    import corpus_pipeline

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 1 << 26)
        docs = spark.createDataFrame([(1, "one 'two'"), (2, None), (3, "")], "doc_id long, text string")
        pieces = corpus_pipeline.packing(spark, docs, "").collect()
        assert sorted((p["doc_id"], p["length"]) for p in pieces)[1:] == [(2, 1), (3, 1)]
        assert int(spark.conf.get(setting)) <= 1 << 22
    finally:
        spark.conf.set(setting, before)
