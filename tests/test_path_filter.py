"""The last hop of a path search keeps only nodes where both ends can meet."""

from __future__ import annotations

from seekspark.operators import graph


def test_last_hop_stores_only_nodes_a_partner_has_reached(spark, monkeypatch):
    # s0 - m0..m39 - 60 far nodes each; the target hangs on one of them.
    edges = [("s0", f"m{i:02d}") for i in range(40)]
    edges += [(f"m{i:02d}", f"f{i:02d}_{j:02d}") for i in range(40) for j in range(60)]
    edges += [("f07_09", "t0"), ("f03_01", "t0")]
    relations = spark.createDataFrame(
        [(f"{a}>{b}", a, b) for a, b in edges], "relation_id string, source_entity_id string, target_entity_id string"
    )
    pairs = spark.createDataFrame([("s0", "t0")], "source string, target string")
    stored = []
    keep = graph.cut_lineage

    def counted(df):
        kept = keep(df)
        if kept.columns == ["end", "node", "path"]:
            stored.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "cut_lineage", counted)
    rows = graph.shortest_paths(pairs, relations, 3).collect()
    assert [(r["node_ids"], r["relation_ids"]) for r in rows] == [
        (["s0", "m03", "f03_01", "t0"], ["s0>m03", "m03>f03_01", "f03_01>t0"])
    ]
    assert stored[-1] < 100  # 2 400 without the filter


def test_crowded_filter_changes_no_path(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_FILTER_BITS", 64)
    monkeypatch.setattr(graph, "BLOCK_WORDS", 1)
    edges = [(f"a{i}", f"b{(i * k) % 30}") for i in range(30) for k in (1, 7, 11)]
    relations = spark.createDataFrame(
        [(f"{a}>{b}", a, b) for a, b in set(edges)], "relation_id string, source_entity_id string, target_entity_id string"
    )
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(0, 30, 3) for j in range(30)], "source string, target string")
    crowded = {tuple(r) for r in graph.shortest_paths(pairs, relations, 3).selectExpr("source", "target", "array_join(node_ids, '>')").collect()}
    monkeypatch.undo()
    whole = {tuple(r) for r in graph.shortest_paths(pairs, relations, 4).selectExpr("source", "target", "array_join(node_ids, '>')").collect()}
    assert crowded == {r for r in whole if r[2].count(">") <= 3} and crowded
