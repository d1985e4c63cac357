"""Hand-computed values for tokens, BM25, vectors, fusion and budgets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.functions import text, vectors
from seekspark.operators import dense, fusion, lexical
from seekspark.plans.options import RetrievalOptions, active_routes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens_mix_words_and_han(spark):
    got = value(spark, text.lexical_tokens(F.lit("SearchLab uses 图谱检索 in 2025")))
    assert got == [
        "word:searchlab", "word:uses", "cjk:图", "cjk:谱", "cjk:检", "cjk:索",
        "cjk2:图谱", "cjk2:谱检", "cjk2:检索", "word:in", "word:2025",
    ]
    assert value(spark, text.lexical_tokens(F.lit("abc图谱 Straße"))) == ["word:abc图谱", "word:strasse"]


def test_run_lengths_count_every_token(spark):
    got = value(spark, text.run_lengths(F.array(*[F.lit(x) for x in "b a b c b a".split()])))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "object_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")


def bm25_plain(docs, query, k1=1.2, b=0.75):
    tokens = {d: t.lower().split() for d, t in docs}
    average = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for d, words in tokens.items():
        score = 0.0
        for term in dict.fromkeys(query.lower().split()):
            tf, df = words.count(term), sum(term in w for w in tokens.values())
            if tf:
                idf = math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5))
                score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / average))
        if score > 0:
            out[d] = score
    return out


def test_bm25_prefers_short_documents_and_matches_the_formula(spark):
    docs = [("long", "searchlab retrieval" + " background" * 30), ("short", "searchlab retrieval"), ("other", "unrelated words")]
    got = lexical.bm25_top_k(corpus(spark, docs), asked(spark, "searchlab retrieval"), 8).orderBy("rank").collect()
    assert [r["object_id"] for r in got] == ["short", "long"]
    plain = bm25_plain(docs, "searchlab retrieval")
    assert all(r["score"] == pytest.approx(plain[r["object_id"]]) for r in got)


def test_bm25_edges(spark):
    docs = corpus(spark, [("z", "图谱检索"), ("a", "图谱检索"), ("m", "图谱 其他")])
    got = lexical.bm25_top_k(docs, asked(spark, "图谱检索"), 8).orderBy("rank").collect()
    assert [r["object_id"] for r in got] == ["a", "z", "m"]
    assert lexical.bm25_top_k(docs, asked(spark, "", "unknown"), 8).count() == 0
    assert lexical.bm25_top_k(docs, asked(spark, "图谱"), 0).count() == 0
    for k1, b in [(0, 0.5), (-1, 0.5), (math.inf, 0.5), (1.2, -0.1), (1.2, 1.1), (1.2, math.nan)]:
        with pytest.raises(ValueError):
            lexical.check_parameters(k1, b)


def test_bm25_reads_a_stored_index(spark):
    docs = corpus(spark, [("a", "red blue"), ("b", "blue green green")])
    stored = lexical.postings(docs)
    plain = lexical.bm25_scores(docs, asked(spark, "blue green")).orderBy("object_id").collect()
    again = lexical.bm25_scores(docs, asked(spark, "blue green"), index=stored).orderBy("object_id").collect()
    assert plain == again


def test_bm25_tokenizes_the_corpus_once(spark, tmp_path):
    corpus(spark, [("a", "red blue")]).write.parquet(str(tmp_path / "c"))
    frame = spark.read.parquet(str(tmp_path / "c"))
    found = lexical.bm25_top_k(frame, asked(spark, "blue"), 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "WindowGroupLimit" in final


def test_hash_embedding(spark):
    model = vectors.HashEmbedder(128)
    first, again, han, empty = model.embed(["graph retrieval", "graph retrieval", "图谱检索", ""]).tolist()
    assert first == again and math.isclose(sum(v * v for v in first), 1.0)
    assert any(han) and not any(empty)
    frame = spark.createDataFrame([("graph retrieval",), (None,)], "t string")
    rows = frame.select(vectors.embed_column(model, F.col("t")).alias("e")).collect()
    assert rows[0]["e"] == pytest.approx(first) and not any(rows[1]["e"])


def test_cosine_and_sigmoid(spark):
    def cos(a, b):
        arrays = [F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>") for v in (a, b)]
        return value(spark, vectors.cosine(*arrays))

    assert cos((1, 0), (3, 0)) == 1.0 and cos((0, 0), (1, 0)) == 0.0 and cos((), ()) == 0.0
    with pytest.raises(Exception, match="dimensions differ"):
        cos((1,), (1, 2))
    assert value(spark, vectors.sigmoid(F.lit(-800.0))) == pytest.approx(0.0)
    assert value(spark, vectors.sigmoid(F.lit(2.0))) == pytest.approx(1 / (1 + math.exp(-2)))


def test_dense_paths_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    rows = [(i, [float(x) for x in base[i % 25]]) for i in range(40)]  # copies tie
    objects = spark.createDataFrame(rows, "object_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=6)]) for q in range(5)], "query_id long, embedding array<double>")
    expected = {}
    for q in queries.collect():
        v = np.array(q["embedding"])
        scored = [(-round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 12), i) for i, e in rows]
        expected[q["query_id"]] = [i for _, i in sorted(scored)[:7]]

    def ranks(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["object_id"])
        return out

    assert ranks(dense.dense_top_k(objects, queries, 7, 6)) == expected
    monkeypatch.setattr(dense, "MAX_QUERY_VALUES", 6)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 9)
    assert ranks(dense.dense_top_k(objects, queries, 7, 6)) == expected


def scores(spark, rows, name):
    return spark.createDataFrame(rows, f"query_id string, {name} string, object_id string, score double")


def test_additive_fusion(spark):
    rows = [
        ("q", "hybrid", "a", 0.1), ("q", "hybrid", "b", 0.9), ("q", "local", "a", 3.0), ("q", "local", "c", 5.0),
        ("q", "global", "b", 1.0), ("q", "global", "c", 1.0),
    ]
    fused = fusion.weighted_fusion(scores(spark, rows, "route"), {"hybrid": 2.0, "local": 1.0, "global": 0.5})
    got = {r["object_id"]: (r["rank"], r["score"]) for r in fusion.top_k(fused, 3, ["query_id"]).collect()}
    assert got == {"b": (1, 2.5), "c": (2, 1.5), "a": (3, 0.0)}


def test_average_fusion_ignores_an_empty_scorer(spark):
    rows = [("q", "dense", "a", 0.1), ("q", "dense", "b", 0.9), ("q", "bm25", "b", 2.0), ("q", "bm25", "c", 4.0), ("p", "dense", "a", 0.3)]
    fused = fusion.weighted_average_fusion(scores(spark, rows, "scorer"), {"dense": 0.25, "bm25": 0.75})
    got = {(r["query_id"], r["object_id"]): r["score"] for r in fused.collect()}
    assert got == {("q", "a"): 0.0, ("q", "b"): 0.25, ("q", "c"): 0.75, ("p", "a"): 1.0}


def test_budget_skips_what_does_not_fit(spark):
    rows = [("q", "b", 1, 4), ("q", "c", 2, 5), ("q", "a", 3, 2)]
    ranked = spark.createDataFrame(rows, "query_id string, object_id string, rank int, tokens int")
    got = fusion.select_within_budget(ranked, 6).orderBy("position").collect()
    assert [r["object_id"] for r in got] == ["b", "a"]


def test_path_injection_matches_the_sequential_rule(spark):
    import random

    random.seed(5)
    paths, chunks = [], []
    for q in range(6):
        for p in range(random.randint(1, 6)):
            rel = [f"r{p}", f"r{p}x"]
            paths.append((str(q), [f"n{p}", "m", f"o{p}"], rel, random.choice([0.2, 0.4, 0.6])))
            chunks += [(str(q), rel, f"c{c:02d}") for c in random.sample(range(30), random.randint(1, 25))]
    limit, expected = 7, {}
    for q in range(6):
        taken = {}
        own = sorted([p for p in paths if p[0] == str(q)], key=lambda p: (-p[3], p[1], p[2]))
        for path in own:
            for c in sorted(x[2] for x in chunks if x[0] == str(q) and x[1] == path[2]):
                if c not in taken and len(taken) < limit:
                    taken[c] = path[3]
        expected.update({(str(q), c): s for c, s in taken.items()})
    p = spark.createDataFrame(paths, "query_id string, node_ids array<string>, relation_ids array<string>, score double")
    c = spark.createDataFrame(chunks, "query_id string, relation_ids array<string>, object_id string")
    got = {(r["query_id"], r["object_id"]): r["score"] for r in fusion.inject_paths(p, c, limit).collect()}
    assert got == expected


def test_document_anchors_cover_distinct_documents(spark):
    rows = [("q", 0, 1, "a", "d1", 0.9), ("q", 0, 2, "b", "d2", 0.8), ("q", 1, 1, "c", "d1", 0.95), ("q", 1, 2, "e", "d3", 0.1)]
    frame = spark.createDataFrame(rows, "query_id string, part int, part_rank int, object_id string, document_id string, score double")
    got = fusion.document_anchors(frame, 8).orderBy("anchor_rank").collect()
    assert [r["object_id"] for r in got] == ["a", "e"]


def test_comparison_split(spark):
    def split(q):
        return value(spark, text.comparison_subqueries(F.lit(q)))

    assert split("Compare GraphX and FlatY in recall on long texts?") == ["GraphX recall on long texts?".replace("recall", "in recall"), "FlatY in recall on long texts?"]
    assert split("Salt and pepper") == []
    assert split("比较BM25和Dense在召回上的差异") == ["BM25 在召回上的差异", "Dense 在召回上的差异"]
    assert split("比较甲和乙在召回上的差异") == []


def test_clean_text(spark):
    raw = "Café multi-\n  line text\nwrapped\r\n\r\n\r\n\r\nnext­ part  end \n"
    assert value(spark, text.clean_text(F.lit(raw))) == "Café multi-line text wrapped\n\nnext part end"


def test_clip_and_units(spark):
    assert value(spark, text.clip_to_budget(F.lit("one two  three four"), F.lit(3))) == "one two  three…"
    body = ("word " * 150 + ". ") * 3
    units = value(spark, text.evidence_units(F.lit(body)))
    assert all(len(u) <= 700 and u in body for u in units) and len(units) > 2


def test_options_and_modes():
    assert RetrievalOptions().route_limit == 32 and RetrievalOptions().path_limit == 16
    assert active_routes("mix", RetrievalOptions(hybrid_weight=0)) == ("graph_local", "graph_global")
    with pytest.raises(ValueError):
        active_routes("graph_hybrid", RetrievalOptions(graph_local_weight=0, graph_global_weight=0))
    for bad in ({"top_k": 0}, {"graph_max_hops": 5}, {"graph_path_weight": 1.5}, {"bm25_k1": 0}, {"hybrid_weight": -1}):
        with pytest.raises(ValueError):
            RetrievalOptions(**bad)
    assert RetrievalOptions().config_hash != RetrievalOptions(top_k=9).config_hash
