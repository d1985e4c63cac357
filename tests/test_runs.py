"""Evaluation formulas, job rules, ingestion, index, traces, agent and streams."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seekspark.operators import jobs, matching, metrics
from seekspark.plans import agent
from seekspark.plans.engine import Engine
from seekspark.plans.options import RetrievalOptions
from seekspark.sources import files, layout
from seekspark.streaming import files as stream


def test_registry_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_scores_count_only_new_identities(spark):
    cases = spark.createDataFrame([("c",), ("none",)], "case_id string")
    ranked = spark.createDataFrame([("c", 1, "x"), ("c", 2, "a"), ("c", 3, "a"), ("c", 4, "b"), ("c", 9, "d")], "case_id string, rank int, identity string")
    gold = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d")], "case_id string, identity string")
    rows = {r["case_id"]: r for r in metrics.retrieval_scores(cases, ranked, gold, 8).collect()}
    got, import_math = rows["c"], __import__("math")
    gain = lambda r: 1 / import_math.log2(r + 1)
    assert (got["matched_count"], got["relevant_count"], got["retrieved_count"]) == (2, 3, 4)
    assert got["recall_at_k"] == pytest.approx(2 / 3) and got["mrr"] == 0.5
    assert got["ndcg_at_k"] == pytest.approx((gain(2) + gain(4)) / (gain(1) + gain(2) + gain(3)))
    assert rows["none"]["applicable"] is False and rows["none"]["mrr"] is None


def test_text_fallback_uses_each_context_once(spark):
    long = "w" * 90
    row = spark.createDataFrame([(["other", long, long + " tail", "short"], [long, "short"])], "items array<string>, contexts array<string>")
    flags = row.select(metrics.greedy_text_relevance(F.col("items"), F.col("contexts"))).first()[0]
    assert flags == [False, True, False, True]


def test_bootstrap_is_seeded_by_label_and_case_order(spark):
    values = [0.5, -0.25, 0.0, 1.0, 0.125]
    frame = spark.createDataFrame([(i, "mrr", v) for i, v in enumerate(values)], "case_id int, label string, delta double")
    row = metrics.bootstrap_means(frame.orderBy(F.desc("case_id")), 500).first()
    assert (row["ci_low"], row["ci_high"]) == metrics.bootstrap_interval(values, "mrr", 500)
    ordered = list(range(20000))
    assert metrics.nearest_rank(ordered, (1 - 0.95) / 2) == 500 and metrics.nearest_rank(ordered, 1 - (1 - 0.95) / 2) == 19499


def test_misaligned_pairs_are_an_error(spark):
    frame = spark.createDataFrame([("a", True, 1.0)], "case_id string, applicable boolean, mrr double")
    other = spark.createDataFrame([("b", True, 1.0)], frame.schema)
    with pytest.raises(Exception, match="misaligned"):
        metrics.paired_deltas(frame, other, ["mrr"]).collect()


def test_context_matching_equals_brute_force(spark):
    random.seed(3)
    base = [" ".join(random.choice(["ab", "Cd", "ef", "gh"]) for _ in range(40)) for _ in range(4)]
    contexts = base + ["tiny", base[0][10:60], base[1].upper()]
    segments = [base[0], "x " + base[1] + " y", base[2][:95], "tiny", "tiny more", base[3] + base[2], "  ", base[0][20:30]]

    def norm(v):
        return " ".join(v.split()).casefold()

    expected = set()
    for i, c in enumerate(contexts):
        hits = {j for j, s in enumerate(segments) if norm(s) == norm(c)}
        if not hits and len(norm(c)) >= 80:
            hits = {j for j, s in enumerate(segments) if norm(s) and (norm(c) in norm(s) or norm(s) in norm(c))}
        expected |= {(i, j) for j in hits}
    c = spark.createDataFrame(list(enumerate(contexts)), "context_id int, text string")
    s = spark.createDataFrame(list(enumerate(segments)), "segment_id int, text string")
    got = {(r["context_id"], r["segment_id"]) for r in matching.match_contexts(c, s).collect()}
    assert got == expected


def test_claims_respect_both_budgets(spark):
    now = "TIMESTAMP'2024-01-01 00:00:00'"
    open_jobs = spark.sql(f"SELECT * FROM VALUES ('a','pending',NULL,NULL), ('b','running',NULL,{now}), ('c','succeeded',NULL,NULL), ('d','pending',NULL,NULL) AS t(extraction_id,status,next_attempt_at,lease_expires_at)")
    open_jobs = open_jobs.selectExpr("extraction_id", "status", "cast(next_attempt_at as timestamp) next_attempt_at", "cast(lease_expires_at as timestamp) lease_expires_at")
    tried = spark.createDataFrame([("d", "extract"), ("d", "repair")], "extraction_id string, stage string")
    got = jobs.claim_jobs(open_jobs, tried, "extract", F.expr(now), 60, 3, 1).orderBy("extraction_id").collect()
    assert [(r["extraction_id"], r["ordinal"]) for r in got] == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        jobs.claim_jobs(open_jobs, tried, "other", F.expr(now), 60, 3, 1)


def test_layout_headings_sections_and_tables(spark):
    def line(page, no, text, size=10.0, bold=False, y=None, x=10.0, table=False):
        top = 100.0 + 20 * no if y is None else y
        return ("d", page, no, 1000.0, text, x, top, x + 80, top + 12, size, bold, table)

    rows = [
        line(1, 0, "Journal 12", y=10.0), line(1, 1, "1.2"), line(1, 2, "Deep Method", 14.0, True), line(1, 3, "Body text of the paper goes here."),
        line(1, 4, "more body"), line(2, 0, "Journal 13", y=10.0), line(2, 1, "carried over"), line(2, 2, "Table 1: Scores"),
        line(2, 3, "model", x=10.0), line(2, 4, "0.9", x=120.0, y=160.0), line(2, 5, "References", 10.0), line(2, 6, "[1] A paper"),
    ]
    schema = "document_id string, page int, line_no int, page_height double, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, in_table boolean"
    frame = spark.createDataFrame(rows, schema)
    lines = layout.merge_number_lines(layout.drop_margins(frame)).cache()
    texts = [r["text"] for r in lines.orderBy("page", "line_no").collect()]
    assert "Journal 12" not in texts and "1.2 Deep Method" in texts
    visual = layout.visual_headings(lines)
    headings = layout.choose_headings(visual.where("false"), visual.where("false"), visual, lines).cache()
    assert {(r["text"], r["level"]) for r in headings.collect()} == {("1.2 Deep Method", 2), ("References", 1)}
    merged = layout.merge_tables(lines, headings)
    found = layout.layout_segments(merged, headings).orderBy("page", "heading_no").collect()
    assert [(r["page"], r["section_path"], r["text"]) for r in found] == [
        (1, ["1.2 Deep Method"], "Body text of the paper goes here.\nmore body"),
        (2, ["1.2 Deep Method"], "carried over\nTable 1: Scores\nmodel | 0.9"),
        (2, ["References"], "[1] A paper"),
    ]


def write(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_engine_end_to_end(spark, tmp_path):
    folder = tmp_path / "corpus"
    write(folder, "a.md", "# Atlas\n\nAtlas connects Beacon through the graph.\n\n## More\n\nBeacon feeds Comet every day.")
    write(folder, "sub/b.txt", "﻿Plain first.\n\nPlain second about retrieval.")
    write(folder, "bad.txt", b"\xff\xfe\xfa")
    engine = Engine(spark, str(tmp_path / "store"))
    first = engine.ingest(str(folder))
    assert {r["action"] for r in first.actions.collect()} == {"insert"} and first.failures.count() == 1
    assert {tuple(r["section_path"]) for r in engine.chunks().collect()} == {("Atlas",), ("Atlas", "More"), ()}
    texts = engine.chunks().where("size(section_path) > 0").select("chunk_id", "text").collect()
    import json

    def completion(text):
        names = [n for n in ("Atlas", "Beacon", "Comet") if n in text]
        return json.dumps({
            "entities": [{"ref": f"e{i + 1}", "name": n, "entity_type": "node", "description": n, "evidence_quotes": [n]} for i, n in enumerate(names)],
            "relations": [{"source_ref": "e1", "target_ref": "e2", "predicate": "LINKS", "description": "link", "evidence_quotes": [names[1]]}],
        })

    rows = [(f"x{i}", r["chunk_id"], r["text"], completion(r["text"]), "stop") for i, r in enumerate(texts)]
    built = engine.build_graph(spark.createDataFrame(rows, "extraction_id string, chunk_id string, chunk_text string, content string, finish_reason string"))
    assert built.entities.count() == 3 and built.relations.count() == 2
    index = engine.build_index(built)
    assert engine.build_index(built).metadata["version"] == index.metadata["version"]
    asked = spark.createDataFrame([("q", "How does Atlas connect to Comet?")], "query_id string, text string")
    for mode in ("bm25", "dense", "hybrid", "graph_local", "graph_global", "graph_hybrid", "mix"):
        found = engine.retrieve(asked, mode)
        hits = found.hits.orderBy("rank").collect()
        assert hits and [h["rank"] for h in hits] == list(range(1, len(hits) + 1)), mode
        assert found.context.agg(F.sum("token_count")).first()[0] <= 2400
    path = [r for r in engine.retrieve(asked, "mix").paths.collect() if len(r["relation_ids"]) == 2]
    assert path
    small = engine.retrieve(asked, "hybrid", RetrievalOptions(context_token_budget=9)).context.collect()
    assert sum(r["token_count"] for r in small) <= 9
    answers, trace = engine.ask(asked, "hybrid")
    row = answers.first()
    assert row["citations"] and not row["insufficient_evidence"]
    assert engine.traces.replay(trace).count() > 0
    with pytest.raises(ValueError):
        engine.traces.replay("rtr_missing").count()
    log = engine.agent_run(asked)
    assert [r["event"] for r in log.orderBy("position").collect()][-2:] == ["answer", "completed"]
    again = engine.ingest(str(folder))
    assert {r["action"] for r in again.actions.collect()} == {"skip"}
    write(folder, "sub/b.txt", "Changed text.")
    changed = engine.ingest(str(folder))
    assert sorted(r["action"] for r in changed.actions.collect()) == ["skip", "update"] and changed.replaced.count() == 1
    with pytest.raises(ValueError):
        engine.retrieve(asked, "bm25")


def test_agent_budgets():
    s = agent.Session("r", "q", agent.Budget(max_reads=1, evidence_token_budget=128))
    runner = agent.AgentRunner.__new__(agent.AgentRunner)
    s.found = {c: {"chunk_id": c, "text": c, "tokens": n} for c, n in [("a", 100), ("b", 50), ("c", 20)]}
    assert not runner._read(s, {"chunk_ids": ["zz"]})["ok"]
    assert runner._read(s, {"chunk_ids": ["a", "b", "c"]})["read"] == ["a", "c"]
    assert not runner._read(s, {"chunk_ids": ["b"]})["ok"]
    assert not runner._answer(s, {"chunk_ids": ["b"]})["ok"] and runner._answer(s, {})["citations"] == ["a"]
    call = {"action": "search_chunks", "args": {"query": "q"}}
    assert s.claim(call) and not s.claim(dict(call)) and s.claim({"action": "expand_graph"}) and s.claim({"action": "expand_graph"})


def test_markdown_segments():
    texts = ["intro\n# T #\n\na\nb\n\n### deep\nc\n## two\nd\n# other\ne", "", "## only\n#### low\nx\n\n y "]
    titles, found = files.markdown_blocks(texts)
    got = [[(s["section_path"], s["text"]) for s in one] for one in found]
    assert titles == ["T", None, None]
    assert got[0] == [([], "intro"), (["T"], "a\nb"), (["T", "deep"], "c"), (["T", "two"], "d"), (["other"], "e")]
    assert got[1] == [] and got[2] == [(["only", "low"], "x"), (["only", "low"], "y")]


def test_chunk_spans_have_no_white_space_at_their_ends():
    from seekspark.operators.chunking import _Splitter, count_whitespace

    for text in ("第一段文字。\n\n第二段文字。\n\n第三段文字。\n\n第四段。", "one two three four\n\nfive\n\nsix seven\n\neight", "word"):
        spans = _Splitter(count_whitespace, 4, 2).spans(text, [(0, len(text), ())])
        assert spans and all(text[a:b] == text[a:b].strip() != "" for a, b, _ in spans)
        assert not set(range(len(text))) - {i for a, b, _ in spans for i in range(a, b)} - {i for i, c in enumerate(text) if c.isspace()}


def test_given_keywords_are_cleaned(spark):
    from seekspark.plans.retrieval import prepare_questions

    words = [" Graph ", "graph", ""] + [f"w{i}" for i in range(20)]
    rows = spark.createDataFrame([("1", "what", words), ("2", "why", None)], "query_id string, text string, keywords array<string>")
    got = {r["query_id"]: r["text"] for r in prepare_questions(rows).collect()}
    assert got == {"1": "what\nKeywords: Graph, " + ", ".join(f"w{i}" for i in range(11)), "2": "why"}


def test_stream_ingest_keeps_the_newest_version(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.txt", "one")
    for text in (None, "two, longer"):
        if text:
            write(folder, "b.txt", text)
        stream.start_ingest(stream.watch_files(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = stream.current_documents(spark, str(tmp_path / "out"))
    assert sorted(r["title"] for r in found.collect()) == ["a", "b"]
