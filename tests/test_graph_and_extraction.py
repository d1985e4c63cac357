"""Graph, resolution, extraction and chunking against plain formulas."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seekspark.operators import chunking, extraction, graph, resolution
from seekspark.operators.quality import quality_class


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark, monkeypatch):
    random.seed(1)
    edges = [(f"n{random.randint(0, 60):02d}", f"n{random.randint(0, 60):02d}") for _ in range(45)]
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]  # a long chain
    edges += [("hub", f"z{i}") for i in range(40)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    expected = plain_components(edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(frame).collect()}
    assert got == expected
    monkeypatch.setattr(graph, "HOT_NODE_ROWS", 10)  # the hub takes the broadcast branch
    got = {r["node"]: r["component"] for r in graph.connected_components(frame).collect()}
    assert got == expected


def relations(spark, rows):
    return spark.createDataFrame(rows, "relation_id string, source_entity_id string, target_entity_id string, predicate string")


def test_summary_counts_isolates(spark):
    entities = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "entity_id string, canonical_name string")
    edges = relations(spark, [("r1", "A", "B", "P"), ("r2", "B", "A", "P")])
    row = graph.graph_summary(entities, edges).first()
    assert (row["nodes"], row["edges"], row["components"], row["largest_component"], row["isolated_nodes"]) == (3, 2, 2, 2, 1)
    top = graph.top_entities(entities, edges, 2).collect()
    assert [(r["entity_id"], r["degree"]) for r in top] == [("A", 2), ("B", 2)]


def test_shortest_paths_match_search(spark):
    random.seed(4)
    nodes = [f"n{i:02d}" for i in range(18)]
    rows = [(f"r{i:03d}", *random.sample(nodes, 2), "P") for i in range(26)]
    near = {}
    for r, a, b, _ in rows:
        near.setdefault(a, {}).setdefault(b, []).append(r)
        near.setdefault(b, {}).setdefault(a, []).append(r)
    pairs = [tuple(random.sample(nodes, 2)) for _ in range(30)]

    def search(a, b, hops):
        layer = [[a]]
        for _ in range(hops):
            layer = [p + [n] for p in layer for n in near.get(p[-1], {})]
            done = sorted(p for p in layer if p[-1] == b)
            if done:
                return done[0]

    for hops in (1, 2, 4):
        expected = {}
        for a, b in set(pairs):
            path = search(a, b, hops)
            if path:
                expected[a, b] = (path, [min(near[x][y]) for x, y in zip(path, path[1:])])
        frame = spark.createDataFrame(pairs, "source string, target string")
        got = {(r["source"], r["target"]): (r["node_ids"], r["relation_ids"]) for r in graph.shortest_paths(frame, relations(spark, rows), hops).collect()}
        assert got == expected


def test_expansion_takes_each_relation_once(spark):
    edges = relations(spark, [("r1", "A", "B", "P"), ("r2", "B", "C", "P"), ("r3", "A", "C", "P")])
    seeds = spark.createDataFrame([("s", "A"), ("s", "B")], "session_id string, entity_id string")
    walked = spark.createDataFrame([("s", "r3")], "session_id string, relation_id string")
    chosen, done = graph.expand_one_hop(seeds, graph.adjacency(edges), walked, 1)
    assert [(r["seed_entity_id"], r["relation_id"], r["neighbor_id"]) for r in chosen.collect()] == [("A", "r1", "B")]
    assert [r["entity_id"] for r in done.collect()] == ["A"]


def test_resolution_is_transitive_over_aliases(spark):
    rows = [
        ("m1", "Neural Net", "METHOD", "short", ["NN"]), ("m2", "nn", "METHOD", "a longer text", []),
        ("m3", "“Neural  net”", "TOPIC", "short", ["connectionist model"]), ("m4", "Connectionist Model", "METHOD", "x", []),
        ("m5", "Alone", "PLACE", "y", []),
    ]
    frame = spark.createDataFrame(rows, "mention_id string, name string, entity_type string, description string, aliases array<string>")
    entities, assignment, aliases = resolution.resolve_entities(frame)
    by_id = {r["entity_id"]: r for r in entities.collect()}
    owner = {r["mention_id"]: r["entity_id"] for r in assignment.collect()}
    assert len(by_id) == 2 and len({owner[m] for m in ("m1", "m2", "m3", "m4")}) == 1
    merged = by_id[owner["m1"]]
    assert (merged["normalized_name"], merged["canonical_name"], merged["entity_type"]) == ("neural net", "Neural Net", "METHOD")
    assert merged["description"] == "a longer text\nshort\nx"
    names = {r["alias"] for r in aliases.collect() if r["entity_id"] == owner["m1"]}
    assert names == {"NN", "nn", "“Neural  net”", "connectionist model", "Connectionist Model"}


def test_descriptions_stay_exact_within_the_bound(spark):
    random.seed(2)
    values = ["x" * random.choice([1, 2, 700, 1500, 3999]) + str(i % 40) for i in range(200)]
    kept, used = [], 0
    for v in sorted(set(values), key=lambda v: (-len(v), v.lower(), v)):
        if used + bool(kept) + len(v) <= 4000:
            used += bool(kept) + len(v)
            kept.append(v)
    frame = spark.createDataFrame([("k", v) for v in values], "key string, description string")
    assert resolution.merge_descriptions(frame, "key").first()["description"] == "\n".join(kept)


def test_relations_merge_and_reject_unknown_ends(spark):
    owner = spark.createDataFrame([("a", "E1"), ("b", "E2"), ("c", "E1")], "mention_id string, entity_id string")
    rows = [("a", "b", "uses", "d1"), ("c", "b", "USES", "d2"), ("b", "a", "uses", "d3")]
    schema = "source_mention_id string, target_mention_id string, predicate string, description string"
    got = resolution.merge_relations(spark.createDataFrame(rows, schema), owner).collect()
    assert sorted((r["source_entity_id"], r["predicate"], r["mentions"]) for r in got) == [("E1", "USES", 2), ("E2", "USES", 1)]
    with pytest.raises(Exception, match="unknown entity mention"):
        resolution.merge_relations(spark.createDataFrame([("a", "zz", "p", "d")], schema), owner).collect()


TEXT = "Atlas connects Beacon through the graph."


def completion(entities, relations=()):
    return json.dumps({"entities": entities, "relations": list(relations)})


def entity(ref, name, quote=TEXT, **more):
    return {"ref": ref, "name": name, "entity_type": "graphNode", "description": "d", "evidence_quotes": [quote], **more}


def relation(a, b, **more):
    return {"source_ref": a, "target_ref": b, "predicate": "CONNECTS", "description": "d", "evidence_quotes": [TEXT], **more}


def checked(spark, *contents):
    rows = [(f"x{i}", "c", TEXT, c, "stop") for i, c in enumerate(contents)]
    frame = spark.createDataFrame(rows, "extraction_id string, chunk_id string, chunk_text string, content string, finish_reason string")
    classified = extraction.classify_completions(frame)
    usable = classified.where("failure is null")
    e = extraction.validate_entities(usable)
    return classified, e, extraction.validate_relations(usable, e)


def reasons(df):
    return [r["reason"] for r in df.orderBy("extraction_id", "index").collect()]


def test_extraction_salvages_valid_records(spark):
    good = completion(
        [entity("e1", "Atlas", aliases=["A"]), entity("e1", "Twin"), entity("e2", "Beacon"), entity("e3", "Ghost", "not there"),
         entity("bad", "Ref"), entity("e4", "Extra", other=1), entity("e5", 7), entity("e6", "Dup", aliases=["a", "A"])],
        [relation("e1", "e2", aliases=[]), relation("e1", "e1"), relation("e1", "e3"), relation("e1", "e2"), relation("e2", "e1", predicate="lower")],
    )
    _, e, r = checked(spark, good, "{}")
    assert reasons(e) == [None, "duplicate_ref", None, "not_verbatim", "schema", "schema", "schema", "schema"]
    assert reasons(r) == [None, "self_relation", "missing_endpoint", "duplicate_relation", "schema"]
    row = extraction.extraction_quality(e, r).first()
    assert (row["accepted_entities"], row["dropped_entities"], row["accepted_relations"], row["sanitized_relation_records"]) == (2, 6, 1, 1)
    span = extraction.accepted_mentions(e).orderBy("index").first()
    assert (span["span"]["char_start"], span["span"]["char_end"], span["entity_type"]) == (0, len(TEXT), "GRAPH_NODE")


def test_quotes_are_limited_in_length(spark):
    body = "x" * (extraction.MAX_QUOTE + 1)
    frame = spark.createDataFrame(
        [("x", "c", body, completion([entity("e1", "Long", body), entity("e2", "Fits", body[1:])]), "stop")],
        "extraction_id string, chunk_id string, chunk_text string, content string, finish_reason string",
    )
    usable = extraction.classify_completions(frame).where("failure is null")
    assert reasons(extraction.validate_entities(usable)) == ["schema", None]


def test_completion_failures(spark):
    fenced = "```json\n" + completion([entity("e1", "Atlas")]) + "\n```"
    classified, e, _ = checked(spark, fenced, "", "[1]", "oops")
    got = [r["failure"] for r in classified.orderBy("extraction_id").collect()]
    assert got == [None, "empty_content", "schema_invalid", "invalid_json"]
    assert reasons(e) == [None]




def test_chunks_respect_budget_sections_and_offsets(spark):
    random.seed(9)

    def words(n):
        return " ".join(random.choice(["alpha", "beta,", "gamma.", "delta;"]) for _ in range(n))

    segments = [(words(random.choice([3, 20, 70, 150])), [f"S{i // 4}"], i + 1, i + 1) for i in range(12)]
    rows = [("d1", segments), ("d2", segments[:1]), ("d3", [])]
    frame = spark.createDataFrame(rows, "document_id string, segments array<struct<text:string,section_path:array<string>,page_start:int,page_end:int>>")
    made = chunking.chunk_documents(frame, 40, 8).orderBy("document_id", "ordinal").collect()
    again = chunking.chunk_documents(frame.repartition(3), 40, 8).collect()
    assert {r["chunk_id"] for r in made} == {r["chunk_id"] for r in again} and len(made) == len({r["chunk_id"] for r in made})
    body = "\n\n".join(s[0] for s in segments)
    covered = set()
    for r in [r for r in made if r["document_id"] == "d1"]:
        assert r["token_count"] == len(r["contextualized_text"].split()) <= 40
        assert body[r["char_start"]:r["char_end"]] == r["text"] == r["text"].strip()
        covered |= set(range(r["char_start"], r["char_end"]))
        assert r["page_start"] <= r["page_end"] and r["section_path"] == [f"S{(r['page_start'] - 1) // 4}"]
    assert all(body[i].isspace() for i in set(range(len(body))) - covered)


def test_one_long_segment_cuts_at_sentences_with_overlap(spark):
    text = "One two three four. Five six seven eight. Nine ten eleven twelve."
    frame = spark.createDataFrame([("d", [(text, [], None, None)])], "document_id string, segments array<struct<text:string,section_path:array<string>,page_start:int,page_end:int>>")
    made = chunking.chunk_documents(frame, 9, 0).orderBy("ordinal").collect()
    assert [r["text"] for r in made] == ["One two three four. Five six seven eight.", "Nine ten eleven twelve."]
    with pytest.raises(Exception, match="entire chunk token budget"):
        bad = spark.createDataFrame([("d", [(text, ["a b c d e f g h i"], None, None)])], frame.schema)
        chunking.chunk_documents(bad, 9, 0).collect()


def test_quality_rules(spark):
    cases = [
        (["2 References"], "x", 5, 3, "references"), (["致谢"], "x", 5, 3, "acknowledgements"),
        (["Attention Visualizations"], "x", 5, 3, "visualization_label"),
        ([], "[1] Abc\n[2] Def\n[3] Ghi", 5, 3, "references"), ([], "All Rights Reserved.", 5, 3, "copyright"),
        ([], "a CVPR paper, Open Access version by Computer Vision Foundation", 5, 3, "copyright"),
        ([], "University of X, a@b.org", 0, 1, "author_affiliation"), ([], "University of X, a@b.org", 2, 1, "normal"),
        ([], "<eos> <pad>", 5, 3, "visualization_label"), (["Intro"], "plain", 0, None, "normal"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, path array<string>, text string, ordinal int, page int, want string")
    got = frame.withColumn("got", quality_class(F.col("path"), F.col("text"), F.col("ordinal"), F.col("page"))).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
