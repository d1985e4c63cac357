"""The stored inverted index against the full scan."""

import random

import pytest

from seekspark.operators import blockmax, lexical


def _frames(spark, docs, asked):
    corpus = spark.createDataFrame(docs, "object_id string, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, text string")
    return corpus, queries


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["object_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("named, documents, first", [(1000, 4, 1), (2, 7, 3)])
def test_search_equals_the_full_scan(spark, tmp_path, monkeypatch, named, documents, first):
    monkeypatch.setattr(blockmax, "NAMED_TERMS", named)
    draw = random.Random(documents)
    words = ["rag", "graph", "图谱", "query", "Index", "x1"] + [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(draw.choice(words[: draw.choice([3, 12, 36])]) for _ in range(draw.randrange(25)))) for i in range(150)]
    docs += [("tie-b", "graph index"), ("tie-a", "graph index"), ("none", ""), ("null", None)]
    asked = [("q1", "graph index"), ("q2", "w1 w2 w3 rag"), ("q3", "unknown words"), ("q4", ""), ("q5", "图谱 x1 w9 w9")]
    corpus, queries = _frames(spark, docs, asked)
    index = blockmax.build_index(corpus, str(tmp_path / "i"), documents=documents)
    for k in (1, 5, 40):
        found = blockmax.search(index, queries, k, first_ranges=first)
        assert _rows(found.hits) == _rows(lexical.bm25_top_k(corpus, queries, k))
    again = blockmax.open_index(spark, str(tmp_path / "i"))
    assert _rows(blockmax.search(again, queries, 3, 0.9, 0.0).hits) == _rows(lexical.bm25_top_k(corpus, queries, 3, 0.9, 0.0))
    assert blockmax.search(index, queries, 0).hits.count() == 0
    with pytest.raises(ValueError):
        blockmax.search(index, queries, 3, k1=0.0)
    with pytest.raises(ValueError):
        blockmax.search(index, queries, -1)


def test_blocks_that_cannot_reach_the_threshold_are_skipped(spark, tmp_path):
    docs = [(f"a{i:04d}", "common " + ("target " * 3 if i < 8 else "common filler words ")) for i in range(400)]
    corpus, queries = _frames(spark, docs, [("q", "common target")])
    index = blockmax.build_index(corpus, str(tmp_path / "i"), documents=8)
    found = blockmax.search(index, queries, 5, first_ranges=1)
    assert _rows(found.hits) == _rows(lexical.bm25_top_k(corpus, queries, 5))
    row = found.blocks.first()
    assert row["blocks"] > 45 and row["blocks_read"] == 2


def test_an_empty_corpus_has_no_hits(spark, tmp_path):
    corpus, queries = _frames(spark, [], [("q", "any")])
    index = blockmax.build_index(corpus, str(tmp_path / "i"))
    assert blockmax.search(index, queries, 5).hits.count() == 0
