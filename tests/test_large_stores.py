"""Queries that stored or exchanged far more than their tables hold."""

from __future__ import annotations

from types import SimpleNamespace

from seekspark import scale
from seekspark.catalog import graphs
from seekspark.operators import extraction, graph


def test_only_shared_lines_reach_the_component_search(spark, monkeypatch):
    texts = {i: f"own {i} a\nown {i} b\nown {i} c" for i in range(20)}
    texts |= {30: "x\ny", 31: "y\nz\nz", 32: "z", 33: "\n\n", 34: None, 4: "x"}
    documents = spark.createDataFrame([*texts.items(), (None, "x"), (30, "x\ny")], "doc_id int, text string")
    seen = []
    search = graphs.graph.connected_components
    monkeypatch.setattr(graphs.graph, "connected_components", lambda edges: seen.append(edges.count()) or search(edges))
    found = {r["node"]: r["component"] for r in graphs.shared_line_components(SimpleNamespace(documents=documents)).collect()}
    wanted = {f"d{i}": f"d{i}" for i in range(20)} | {"d30": "d30", "d31": "d30", "d32": "d30", "d4": "d30"}
    assert found == wanted
    assert seen[0] <= 3  # 64 when every line was a node


def test_checked_records_do_not_carry_the_text(spark):
    entity = '{"ref":"%s","name":"%s","entity_type":"other","description":"d","aliases":[],"evidence_quotes":["%s"]}'
    relation = '{"source_ref":"e1","target_ref":"e2","predicate":"LINKS","description":"d","evidence_quotes":["beta"]}'
    content = '{"entities":[%s,%s],"relations":[%s]}' % (entity % ("e1", "a", "alpha"), entity % ("e2", "b", "absent"), relation)
    content = content.replace("absent", "beta")
    rows = [("x1", "c1", "alpha beta " + "long " * 100, content, "stop"), ("x2", "c2", "alpha only", content, "stop")]
    usable = extraction.classify_completions(
        spark.createDataFrame(rows, "extraction_id string, chunk_id string, chunk_text string, content string, finish_reason string")
    ).where("failure IS NULL")
    entities = extraction.validate_entities(usable)
    relations = extraction.validate_relations(usable, entities)
    for checked in (entities, relations):
        assert "chunk_text" not in checked.columns
    spans = {(r["extraction_id"], r["ref"]): tuple(r["span"]) for r in extraction.accepted_mentions(entities).collect()}
    assert spans == {("x1", "e1"): (0, 5), ("x1", "e2"): (6, 10), ("x2", "e1"): (0, 5)}
    assert [(r["extraction_id"], tuple(r["span"])) for r in extraction.accepted_mentions(relations).collect()] == [("x1", (6, 10))]
    reasons = {(r["extraction_id"], r["index"]): r["reason"] for r in relations.collect()}
    assert reasons == {("x1", 0): None, ("x2", 0): "missing_endpoint"}


def test_path_search_stores_each_linked_pair_once(spark, monkeypatch):
    edges = [(f"a{i}", f"b{j}") for i in range(6) for j in range(6)] + [("b3", "a2"), ("a1", "a1")]
    relations = spark.createDataFrame(
        [(f"{x}>{y}#{n}", x, y) for x, y in edges for n in range(3)], "relation_id string, source_entity_id string, target_entity_id string"
    )
    stored, keep = [], graph.compact
    monkeypatch.setattr(graph, "compact", lambda df: stored.append(df.count()) or keep(df))
    pairs = spark.createDataFrame([("a0", "b0"), ("a0", "a5"), ("b1", "b2")], "source string, target string")
    found = {(r["source"], r["target"]): (r["node_ids"], r["relation_ids"]) for r in graph.shortest_paths(pairs, relations, 3).collect()}
    assert found == {
        ("a0", "b0"): (["a0", "b0"], ["a0>b0#0"]),
        ("a0", "a5"): (["a0", "b0", "a5"], ["a0>b0#0", "a5>b0#0"]),
        ("b1", "b2"): (["b1", "a0", "b2"], ["a0>b1#0", "a0>b2#0"]),
    }
    assert stored[0] == 36  # 72 when both directions were stored


def test_path_search_with_many_ends(spark, monkeypatch):
    edges = {(f"a{i}", f"b{(i * k) % 20}") for i in range(20) for k in (1, 7)}
    relations = spark.createDataFrame(
        [(f"{a}>{b}", a, b) for a, b in edges], "relation_id string, source_entity_id string, target_entity_id string"
    )
    pairs = spark.createDataFrame([(f"a{i}", f"{x}{j}") for i in range(0, 20, 3) for j in range(20) for x in "ab"], "source string, target string")

    def rows():
        return {(r["source"], r["target"], *r["node_ids"], *r["relation_ids"]) for r in graph.shortest_paths(pairs, relations, 3).collect()}

    few = rows()
    monkeypatch.setattr(graph, "NARROW_ROWS", 3)
    monkeypatch.setattr(graph, "small_side", lambda df, most=2: scale.small_side(df, 2))
    assert rows() == few and few
