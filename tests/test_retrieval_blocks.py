"""Retrieval scores chunks in blocks: no row per question and chunk is made or exchanged."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from seekspark.catalog.retrieval import document_index
from seekspark.functions import text as texts
from seekspark.operators import fusion, lexical, linked
from seekspark.plans import retrieval as plan
from seekspark.plans.options import RetrievalOptions

WORDS = [f"word{i}" for i in range(40)]


@pytest.fixture(scope="module")
def index(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices(WORDS, k=8)), f"src{draw.randrange(4)}", draw.choice(["en", "de"])) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string").cache()
    return document_index(SimpleNamespace(documents=documents))


@pytest.fixture(scope="module")
def asked(spark):
    draw = random.Random(6)
    rows = [(f"q{i}", f"Compare {' '.join(draw.choices(WORDS, k=2))} and {' '.join(draw.choices(WORDS, k=2))} in src1") for i in range(5)]
    return spark.createDataFrame([*rows, ("plain", "word3 word4")], "query_id string, text string")


def _hits(found):
    return {(r["query_id"], r["rank"], r["object_id"], round(r["score"], 9), round(r["raw_score"], 9)) for r in found.hits.collect()}


def test_mix_makes_few_rows_and_the_same_hits(index, asked, monkeypatch):
    sizes, routes = [], []
    fuse, chunk_route = plan.fuse, plan.chunk_route

    def counted(*args):
        fused = fuse(*args)
        sizes.append(fused.count())
        return fused

    monkeypatch.setattr(plan, "fuse", counted)
    monkeypatch.setattr(plan, "chunk_route", lambda *args: routes.append(args) or chunk_route(*args))
    few = plan.retrieve(index, asked, "mix")
    assert len(routes) == 1  # 2 when sub-questions were asked apart
    assert sizes[0] < 6 * 300 * 0.8  # 6 x 300 when every linked chunk was a row
    monkeypatch.undo()
    monkeypatch.setattr(plan, "linked_scores", lambda *args: None)
    whole = plan.retrieve(index, asked, "mix")
    assert _hits(few) == _hits(whole)
    marks = [{tuple(r) for r in found.anchors.collect()} for found in (few, whole)]
    assert marks[0] == marks[1] and marks[0]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_linked_scores_are_maxima_over_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(linked, "BLOCK_LINKS", block)
    draw = random.Random(7)
    links = [(draw.choice(["entity", "relation"]), f"o{draw.randrange(9)}", f"c{draw.randrange(50)}") for _ in range(200)] + [("entity", "o1", None)]
    scored = {n: [(f"q{draw.randrange(4)}", k, f"o{draw.randrange(9)}", draw.random() - 0.3) for k in ("entity", "relation") for _ in range(20)] for n in ("a", "b")}
    schema = "query_id string, kind string, object_id string, score double"
    found = linked.linked_scores(
        spark.createDataFrame(links, "kind string, object_id string, chunk_id string"),
        {n: spark.createDataFrame(rows, schema) for n, rows in scored.items()},
    )
    best = {}
    for name, rows in scored.items():
        for q, kind, o, score in rows:
            for k, l, chunk in links:
                if (k, l) == (kind, o):
                    best[q, name, chunk] = max(score, best.get((q, name, chunk), -9))
    bounds = {(r["query_id"], r["component"]): (r["lo"], r["hi"]) for r in found.bounds.collect()}
    for q, name in bounds:
        own = [v for (a, b, _), v in best.items() if (a, b) == (q, name)]
        assert bounds[q, name] == (min(own), max(own))
    pairs = spark.createDataFrame([(f"q{i}", c) for i in range(4) for c in [*(f"c{j}" for j in range(50)), None]], "query_id string, object_id string")
    got = {(r["query_id"], r["component"], r["object_id"]): r["score"] for r in found.of(pairs).collect()}
    assert got == best
    top = {}
    for (q, name, chunk), score in best.items():
        lo, hi = bounds[q, name]
        top[q, chunk] = top.get((q, chunk), 0) + (score - lo) / (hi - lo) * {"a": 1.0, "b": 0.5}[name]
    wanted = {q: {c for c in sorted((c for a, c in top if a == q), key=lambda c: (-round(top[q, c], 12), c or ""))[:7]} for q, _ in top}
    chosen = found.best({"a": 1.0, "b": 0.5}, 7).collect()
    assert {q: {r["object_id"] for r in chosen if r["query_id"] == q} for q in wanted} == wanted


def test_bm25_blocks_equal_the_general_scores(spark, monkeypatch):
    draw = random.Random(8)
    docs = [(f"d{draw.randrange(150)}", " ".join(draw.choices([*WORDS, "图谱", "ß"], k=draw.randrange(12))) if draw.random() > 0.05 else None) for _ in range(250)]
    corpus = spark.createDataFrame(docs, "object_id string, text string")  # ids repeat
    queries = spark.createDataFrame(
        [(f"q{i // 2}", " ".join(draw.choices(WORDS, k=4)) + " 图谱") for i in range(10)] + [("e", ""), (None, "word1")], "query_id string, text string"
    )

    def rows(df):
        return sorted(((str(q), o, round(s, 9), n) for q, o, s, n in df.select("query_id", "object_id", "score", "rank").collect()), key=lambda r: (r[0], r[3]))

    wanted = rows(fusion.top_k(lexical.bm25_scores(corpus, queries), 6, ["query_id"]))
    monkeypatch.setattr(lexical, "bm25_scores", lambda *args: pytest.fail("one row per question and document"))
    for values in (lexical.BLOCK_VALUES, 30):
        monkeypatch.setattr(lexical, "BLOCK_VALUES", values)
        assert rows(lexical.bm25_top_k(corpus, queries, 6, blocks=True)) == wanted


def test_plain_tokens_equal_the_column_function(spark):
    draw = random.Random(9)
    letters = "abcßſςΣσµﬁﬂﬀﬃ图谱检索㐀龥_-' .\nÉéİı ٣²½Ⅷ〇𝔄𐐀á१"
    values = ["".join(draw.choices(letters, k=draw.randrange(50))) for _ in range(400)] + [""]
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    rows = frame.select("t", texts.lexical_tokens(F.col("t")).alias("tokens")).collect()
    known = {token: n for n, token in enumerate(sorted({token for r in rows for token in r["tokens"]})) if n % 3}
    count = texts.token_counter(known)
    for r in rows:
        size, numbers = count(r["t"])
        assert size == len(r["tokens"])
        assert sorted(numbers) == sorted(known[token] for token in r["tokens"] if token in known)


def test_path_chunks_are_cut_per_relation(index, asked):
    options = RetrievalOptions(top_k=2)
    found = plan.retrieve(index, asked, "mix", options)
    scores = plan.path_scores(index, found.paths, options)
    steps = found.paths.where(F.size("relation_ids") >= 2).select("query_id", "relation_ids", F.explode("relation_ids").alias("object_id"))
    every = index.links.where("kind = 'relation'").join(steps, "object_id").select("query_id", "relation_ids", F.col("chunk_id").alias("object_id")).distinct()
    assert {tuple(r) for r in scores.collect()} == {tuple(r) for r in fusion.inject_paths(found.paths, every, options.path_limit).collect()}


def test_modes_that_share_questions_count_the_corpus_once(index, asked, monkeypatch):
    counted, top = [], plan.bm25_top_k
    monkeypatch.setattr(plan, "bm25_top_k", lambda *args, **more: counted.append(args) or top(*args, **more))
    shared = plan._Asked(index, plan.prepare_questions(asked))
    both = [_hits(plan.retrieve(index, asked, mode, asked=shared)) for mode in ("bm25", "hybrid")]
    assert len(counted) == 1
    assert both == [_hits(plan.retrieve(index, asked, mode)) for mode in ("bm25", "hybrid")]


def test_evaluated_modes_match_the_gold_once(spark, monkeypatch):
    from seekspark.catalog import runs

    draw = random.Random(11)
    rows = [(i, " ".join(draw.choices(WORDS, k=20)), "s", "en") for i in range(20)]
    documents = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    benchmark = spark.createDataFrame([(i, rows[i][1]) for i in range(3)], "item_id int, text string")
    stored, keep = [], runs.cut_lineage
    monkeypatch.setattr(runs, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    found = runs.evaluated_modes(SimpleNamespace(documents=documents, benchmark=benchmark)).collect()
    assert stored == [["case_id", "identity"]]
    assert {(r["mode"], r["scope"], r["hit_at_k"]) for r in found} == {(m, s, 1.0) for m in ("bm25", "hybrid") for s in ("hits", "context")}
