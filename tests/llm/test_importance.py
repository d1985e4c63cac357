import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from seekspark.llm import importance
from seekspark.llm.importance import build_head, feature_buckets, importance_draw

SCHEMA = "doc_id long, text string, score string, rank int, part string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _brute(docs, target, percent=25, least_words=20, seed=7, buckets=10_000):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = Counter(), Counter()
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            counts.update(bucket(f) for f in _features(text)[1])
    ns, nt = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        n_words, found = _features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, n_words))
    able = sorted((r for r in rows if r[4] >= least_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = percent * len(able) // 100
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return ranked + [(*r[:4], None) for r in rows if r[4] < least_words or r[0] is None]


def _texts(count, seed, longest=60):
    draw = random.Random(seed)
    pool = ["The", "the", "of", "Ärger", "x1", "naïve", "日本", "\U0001F600", "b2b", "it's", "É", "ﬁ"] + [f"w{i}" for i in range(40)]
    return [draw.choice([" ", "-", "\n", "\x00"]).join(draw.choice(pool[:8] if draw.random() < 0.5 else pool) for _ in range(draw.randint(0, longest))) for _ in range(count)]


def _same(spark, docs, target, **more):
    frame = spark.createDataFrame([(i, t, "x", 5, "y") for i, t in docs], SCHEMA).repartition(3)
    wanted = spark.createDataFrame([(t,) for _, t in target], "text string")
    found = [tuple(r) for r in importance_draw(frame, wanted, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    more.pop("head_share", None)
    key = repr
    assert sorted(found, key=key) == sorted(_brute(docs, target, **more), key=key)


@pytest.mark.parametrize("head_share", [1e-5, 0.02, 1.0])
def test_draw_equals_brute_force_whatever_the_head(spark, head_share):
    docs = list(enumerate(_texts(150, 1)))
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, " ".join(f"v{i % 3000}" for i in range(40_000))), (None, "a b " * 30), (-5, "x " * 25)]
    docs += [(7, docs[7][1])] * 60 + [(8, "other words " * 12)]
    _same(spark, docs, [(0, t) for t in _texts(20, 2)] + [(1, None)], head_share=head_share)


def test_other_parameters_and_empty_tables(spark):
    docs = list(enumerate(_texts(40, 3)))
    _same(spark, docs, [], percent=100, least_words=1, seed=9, buckets=97)
    _same(spark, [], [(0, "a b")])
    _same(spark, [(1, ""), (2, None)], [(0, "a b")])


def test_frequent_features_are_bounded_and_counted_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(importance, "COUNTING_WORDS", 50)
    monkeypatch.setattr(importance, "COUNTING_BYTES", 400)
    texts = ["alpha beta " * 20 + " ".join(f"r{i}x{j}" for j in range(20)) for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    words, pairs = importance.frequent_features(frame, 0.05)
    assert sorted(words) == [b"alpha", b"beta"]
    assert sorted(pairs) == [b"alpha beta", b"beta alpha"]


def test_head_and_tail_buckets_agree():
    text = pa.array(_texts(50, 4) + [None], pa.string())
    bare = feature_buckets(text, build_head([], []), 5000)
    words = [b"the", b"of", b"x1", "日本".encode(), b"unseen"]
    pairs = [a + b" " + b for a in words for b in words] + [b"not known"]
    full = feature_buckets(text, build_head(words, pairs, 5000), 5000)
    assert bare[0].tolist() == full[0].tolist() and bare[1].tolist() == full[1].tolist()
