import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from seekspark.llm.neardup import (
    banded_common, group_links, near_duplicate_classes, order_min_hashes, shingles, similarity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, sketch int"


def test_banded_alignment_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b, band = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 25)), int(rng.integers(0, 9))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                match = a[i - 1] == b[j - 1] and abs(i - j) <= band
                d[i, j] = max(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1] + match)
        assert banded_common(a, b, band) == d[-1, -1]


def test_order_decides_the_sketch():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    assert (order_min_hashes(a) == order_min_hashes(a.copy())).all()
    assert (order_min_hashes(a) == order_min_hashes(a[::-1].copy())).mean() < 0.3
    assert similarity(a, a[::-1].copy()) < 0.8 <= similarity(a, a[2:])


def test_shingles_of_short_and_empty_rows():
    value, at = shingles(pa.array(["a b c d e f", "A  b", None, " ", "a b"]))
    assert at.tolist() == [0, 2, 3, 3, 3, 4] and value[2] == value[3]


def _brute(texts, least=0.8):
    """Classes by ordered five-word shingle similarity of all pairs."""
    def parts(t):
        w = (t or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    ids = sorted(texts)
    held = {i: parts(texts[i]) for i in ids}
    label = {i: i for i in ids}
    for x in ids:
        for y in ids:
            a, b = held[x], held[y]
            if x < y and a and b and label[x] != label[y]:
                # Only pairs with shared shingles need the table.
                if len(set(a) & set(b)) < 0.4 * max(len(set(a)), len(set(b))):
                    continue
                d = np.zeros((len(a) + 1, len(b) + 1), int)
                for i in range(len(a)):
                    for j in range(len(b)):
                        d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
                common = d[-1, -1]
                if common / (len(a) + len(b) - common) >= least:
                    low, high = sorted((label[x], label[y]))
                    label = {k: low if v == high else v for k, v in label.items()}
    return label


def _corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = {}
    for base in range(12):
        words = [word() for _ in range(draw.randint(30, 60))]
        for copy in range(draw.randint(1, 8)):
            own = list(words)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own)
    passage = " ".join(word() for _ in range(20))
    for _ in range(10):
        texts[len(texts)] = passage + " " + " ".join(word() for _ in range(30))
    for t in (None, "", " ", "two words", "Two  words", texts[0], texts[0].upper()):
        texts[len(texts)] = t
    return texts


def test_classes_equal_brute_force(spark):
    texts = _corpus(3)
    rows = [(i, t, "l", "s", 1, "clash", 2) for i, t in texts.items()] + [(0, texts[0], "l", "s", 1, "", 0), (None, texts[0], "l", "s", 1, "", 0)]
    found = near_duplicate_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = _brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert len(found) == len(texts) + 1 and got == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in found)
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_a_group_join_classes_once():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 31, 50).astype(np.uint32)
    far = rng.integers(0, 1 << 31, 50).astype(np.uint32)
    texts = [base, base[1:], far, base[2:], far[1:]]
    ids, classes = np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 2, 5])
    links = group_links(ids, classes, texts, None, 0.8)
    assert links == [(1, 2), (3, 5)]
    assert group_links(ids, classes, texts, np.array([0, 0, 0, 0, 1]), 0.8) == [(3, 5)]


def test_pipeline_applies_every_stage(spark, tmp_path):
    draw = random.Random(7)
    voice = "shu mako teri ponda kilo vash renu okto pira lumo".split()
    rows, labels = [], []
    for i in range(300):
        words = [draw.choice(voice) + draw.choice("aeiou") for _ in range(draw.randint(20, 60))]
        toxic, junk = i % 6 == 1, i % 6 == 2
        if toxic:
            words[5] = "grobian" + draw.choice("aeiou")
        if junk:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "xx", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(400, rows[0][1], "xx", "s", 1), (401, rows[3][1] + " makoa", None, None, None), (402, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert everything - kept[0] == {i for i in range(300) if i % 6 == 1}
    junk = {i for i in range(300) if i % 6 == 2}
    assert junk <= kept[0] - kept[1] and len(kept[0] - kept[1] - junk) <= 3
    assert {3, 401} <= kept[1]
    assert kept[1] - kept[2] == {400, 401}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept[2]


def test_long_pairs_are_aligned_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 40, 40_000)
    b = np.delete(a, rng.choice(len(a), 1500, replace=False))
    tracemalloc.start()
    found = similarity(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(b) / len(a) and peak < 30 << 20
    same = np.zeros(20_000, np.int64)
    assert similarity(same, same[:19_000]) == 0.95
    from seekspark.llm import neardup

    for few in (0, 2, 64):
        monkeypatch.setattr(neardup, "FEW_PLACES", few)
        mixed, other = rng.integers(0, 4, 300), rng.integers(0, 4, 280)
        for band in (0, 3, 40, 300):
            d = np.zeros((len(mixed) + 1, len(other) + 1), int)
            for i in range(len(mixed)):
                for j in range(len(other)):
                    hit = d[i, j] + 1 if mixed[i] == other[j] and abs(i - j) <= band else 0
                    d[i + 1, j + 1] = max(d[i, j + 1], d[i + 1, j], hit)
            assert banded_common(mixed, other, band) == d[-1, -1], (few, band)


def test_stages_define_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns and empty tables in every stage."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"word{i}" for i in range(30))
    rows = [
        (1, text, "en", "s", 9, "x"), (1, text, "en", "s", 9, "x"), (2, text, None, None, None, "x"), (None, text, "en", "s", 9, "x"),
        (None, None, None, None, None, "x"), (3, "", "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (5, None, "en", "s", 0, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sketches string")
    expected = {"toxicity": len(rows), "quality": len(rows), "near_duplicates": len(rows) - 1, "packing": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert found.count() == expected[name], name
        if name != "packing":
            assert tuple(found.columns) == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in kept) == [0, 0, 1, 1, 3, 4, 5]
