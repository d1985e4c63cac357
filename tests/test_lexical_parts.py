"""BM25 partitions follow the number of scores, not the bytes of postings."""

from __future__ import annotations

from seekspark.operators import lexical


def test_bm25_partitions_follow_the_scores(spark, monkeypatch):
    corpus = spark.createDataFrame([(str(i), f"river town {i % 5}") for i in range(40)], "object_id string, text string")
    queries = spark.createDataFrame([("a", "river 1"), ("b", "town 2")], "query_id string, text string")
    plain = {tuple(r) for r in lexical.bm25_scores(corpus, queries).collect()}
    monkeypatch.setattr(lexical, "PAIRS_PER_PART", 4)
    for index in (None, lexical.postings(corpus)):
        scores = lexical.bm25_scores(corpus, queries, index=index)
        assert scores.rdd.getNumPartitions() == 20
        assert {(q, o, round(s, 9)) for q, o, s in scores.collect()} == {(q, o, round(s, 9)) for q, o, s in plain}
