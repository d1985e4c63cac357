"""Set-similarity joins, cited evidence, order statistics, paths and digest trees."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from seekspark.operators import citations, digests, graph, metrics, quantiles, setjoin


def _terms(spark, sets):
    rows = [(g, i, t) for (g, i), terms in sets.items() for t in terms]
    return spark.createDataFrame(rows, "group_id int, id string, term string").repartition(3)


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _random_sets(draw, name, count):
    out = {}
    for i in range(count):
        size = draw.randrange(1, 12)
        pool = 8 if draw.random() < 0.5 else 60
        out[(draw.randrange(2), f"{name}{i:02d}")] = {f"t{min(int(draw.expovariate(6 / pool)), pool)}" for _ in range(size)}
    return out


def test_set_joins_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT_TERM_ROWS", 5)
    draw = random.Random(4)
    left, right = _random_sets(draw, "l", 40), _random_sets(draw, "r", 60)
    left[(0, "alone")] = {"nowhere", "else"}
    left[(3, "no group")] = {"t0"}
    right[(0, "twin-b")] = right[(0, "twin-a")] = {"t1", "t2", "t3"}
    left[(0, "tie")] = {"t1", "t2", "t3"}
    a, b = _terms(spark, left), _terms(spark, right)
    pairs = {(x, y): _jaccard(left[x], right[y]) for x, y in itertools.product(left, right) if x[0] == y[0]}
    for threshold in (0.2, 0.5, 1.0):
        found = {((r["group_id"], r["left_id"]), (r["group_id"], r["right_id"])): r["jaccard"] for r in setjoin.similar_sets(a, b, threshold).collect()}
        assert found == pytest.approx({p: j for p, j in pairs.items() if j >= threshold - 1e-12})
    for first in (1, 6):
        found = {(r["group_id"], r["left_id"]): (r["right_id"], round(r["jaccard"], 9)) for r in setjoin.most_similar(a, b, first).collect()}
        best = {}
        for (x, y), j in pairs.items():
            if j > 0:
                best[x] = min(best.get(x, (0, "~")), (-round(j, 9), y[1]))
        assert found == {x: (y, -j) for x, (j, y) in best.items()}
    with pytest.raises(ValueError):
        setjoin.similar_sets(a, b, 0.0)
    related = {r["id"]: (r["related_id"], r["jaccard"]) for r in metrics.related_context(a, b).collect()}
    assert related["alone"] == (min(y[1] for y in right if y[0] == 0), 0.0) and related["no group"] == (None, 0.0)
    assert related["tie"] == ("twin-a", 1.0)


def _expected_scores(items, gold, contexts, k):
    """Item by item, as the definition says: ids when there are any, else texts."""
    seen, flags, matched = set(), [], set()
    relevant = set(gold) if gold is not None else {" ".join(c.split()).lower() for c in contexts if c.strip()}
    for text, identities in items:
        if gold is not None:
            hit = (set(identities) & relevant) - seen
            flags.append(bool(hit))
            matched |= hit
            seen |= set(identities)
            continue
        own = " ".join(text.split()).lower()
        fits = [c for c in sorted(relevant - seen) if own == c or (min(len(own), len(c)) >= 80 and (own in c or c in own))]
        flags.append(bool(fits))
        matched |= set(fits[:1])
        seen |= {own, *fits[:1]}
    gains = [1 / math.log2(i + 2) for i, f in enumerate(flags) if f]
    n, m = len(relevant), len(matched) if gold is not None else sum(flags)
    if not n:
        return (False, 0, len(items), 0, None, None, None, None)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(n, k)))
    first = next((i + 1 for i, f in enumerate(flags) if f), None)
    return (True, n, len(items), m, float(first is not None), m / n, 1 / first if first else 0.0, sum(gains) / ideal)


def test_cited_evidence_equals_the_definition(spark):
    draw = random.Random(8)
    base = [" ".join(draw.choice(["ab", "Cd", "ef"]) for _ in range(40)) for _ in range(4)]
    cases, evidence, cited, gold, texts, expected = [], [], [], [], [], {}
    for n in range(24):
        case, by_text = f"c{n}", n % 2 == 1
        cases.append((case, by_text))
        pool = [draw.choice([base[0], "x " + base[1], base[1].upper(), base[2][:90], base[2], "tiny", "", base[3][5:]]) for _ in range(6)]
        ids = [[draw.choice("abcdef") for _ in range(draw.randrange(3))] for _ in pool]
        evidence += [(case, f"e{i}", t, ids[i]) for i, t in enumerate(pool)]
        order = [draw.choice([*range(6), 9]) for _ in range(draw.randrange(8))]
        cited += [(case, p, f"e{i}") for p, i in enumerate(order)]
        wanted = draw.sample("abcdef", draw.randrange(4))
        own_texts = draw.sample([*base, "tiny", " "], draw.randrange(5))
        gold += [(case, w) for w in wanted]
        texts += [(case, t) for t in own_texts]
        items = [(pool[i], ids[i]) for i in order if i < 6]
        expected[case] = _expected_scores(items, None if by_text else wanted, own_texts, max(3, len(items)))
    items = citations.cited_items(
        spark.createDataFrame(evidence, "case_id string, citation_id string, text string, identities array<string>"),
        spark.createDataFrame(cited, "case_id string, position int, citation_id string"),
    )
    frames = (
        spark.createDataFrame(cases, "case_id string, by_text boolean"), items,
        spark.createDataFrame(gold, "case_id string, identity string"), spark.createDataFrame(texts, "case_id string, text string"),
    )
    rows = citations.evidence_scores(*frames, 3, whole=True).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert tuple(r)[2:] == pytest.approx(expected[r["case_id"]]), r
        assert r["matching_method"] == ("normalized_context_overlap" if int(r["case_id"][1:]) % 2 else "evidence_id")
    with pytest.raises(ValueError):
        citations.evidence_scores(*frames, 0)


def test_nearest_ranks_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 4)
    monkeypatch.setattr(quantiles, "FEW_ROWS", 3)
    draw = random.Random(2)
    values = {
        "even": [draw.uniform(-5, 5) for _ in range(200)], "ties": [draw.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(100)],
        "steep": [10.0 ** draw.randrange(-200, 300) for _ in range(60)], "one": [3.5], "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-300],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("nothing", None)]
    frame = spark.createDataFrame(rows, "key string, v double").repartition(3)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = {(r["key"], r["share"]): r["result"] for r in quantiles.nearest_ranks(frame, "v", ["key"], shares).collect()}
    assert found == {(k, s): sorted(vs)[max(math.ceil(s * len(vs)), 1) - 1] for k, vs in values.items() for s in shares}
    whole = sorted(v for _, v in rows if v is not None)
    overall = {r["share"]: r["result"] for r in quantiles.nearest_ranks(frame, "v", [], [0.5, 0.95]).collect()}
    assert overall == {s: whole[math.ceil(s * len(whole)) - 1] for s in (0.5, 0.95)}
    summary = {r["key"]: r for r in metrics.latency_summary(frame, "v", "key").collect()}
    assert summary["nothing"]["latency_p50"] is None and summary["ties"]["latency_p95"] == 2.0
    assert quantiles.nearest_ranks(frame.where("false"), "v", ["key"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.nearest_ranks(frame, "v", ["key"], [1.5])


def test_paths_prefer_fewer_hops_then_smaller_nodes(spark):
    draw = random.Random(6)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(f"r{i:03d}", draw.choice(names), draw.choice(names)) for i in range(36)] + [(f"h{n}", "n00", n) for n in names[:15]]
    relations = spark.createDataFrame(edges, "relation_id string, source_entity_id string, target_entity_id string")
    pairs = [(a, b) for a in names[::3] for b in names[::2]]
    around = {}
    for r, a, b in edges:
        if a != b:
            around.setdefault(a, {}).setdefault(b, []).append(r)
            around.setdefault(b, {}).setdefault(a, []).append(r)
    for hops in (1, 2, 3, 4):
        expected = {}
        for a, b in pairs:
            level = [[a]]
            for _ in range(hops):
                level = [p + [n] for p in level for n in around.get(p[-1], {})]
                ends = [p for p in level if p[-1] == b]
                if ends and a != b:
                    path = min(ends)
                    expected[(a, b)] = (path, [min(around[x][y]) for x, y in zip(path, path[1:])])
                    break
        found = graph.shortest_paths(spark.createDataFrame(pairs, "source string, target string"), relations, hops).collect()
        assert {(r["source"], r["target"]): (r["node_ids"], r["relation_ids"]) for r in found} == expected


def test_digest_trees_compare_and_update(spark):
    schema = "id string, hash string"
    rows = [(f"k{i}", f"h{i}") for i in range(300)] + [(None, "x"), ("k7", "second row")]
    old = spark.createDataFrame(rows, schema).repartition(3)
    changed = [("k3", "other"), ("fresh", "h")]
    new_rows = [r for r in rows if r[0] not in ("k3", "k200")] + changed
    new = spark.createDataFrame(new_rows, schema)
    depth = 2
    a, b = (digests.digest_tree(f, "id", "hash", depth) for f in (old, new))
    nodes = {(r["level"], r["prefix"]): (r["digest"], r["n"]) for r in b.collect()}
    assert nodes[(0, "")][1] == 301 and len([k for k in nodes if k[0] == depth]) > 100
    leaves = digests.differing_leaves(a, b, depth)
    keys = spark.createDataFrame([("k3",), ("fresh",), ("k200",)], "id string")
    assert {r["prefix"] for r in leaves.collect()} == {r[0] for r in keys.select(digests.leaf_of("id", depth)).collect()}
    found = digests.changed_rows(old, new, leaves, "id", "hash", depth)
    assert {(r["id"], r["change"]) for r in found.collect() if r["id"] != "k7"} == {("k3", "changed"), ("fresh", "added"), ("k200", "removed")}
    again = digests.updated_tree(a, new, keys, "id", "hash", depth)
    assert {(r["level"], r["prefix"]): (r["digest"], r["n"]) for r in again.collect()} == nodes
    assert digests.differing_leaves(b, again, depth).isEmpty()
    assert digests.digest_tree(old.where("false"), "id", "hash", 3).isEmpty()
    gone = digests.updated_tree(a, new.where("false"), old.select("id"), "id", "hash", depth)
    assert gone.isEmpty()
    assert [digests.depth_for(n) for n in (0, 4096, 4097, 10**9)] == [1, 1, 2, 6]
    with pytest.raises(ValueError):
        digests.digest_tree(old, "id", "hash", 0)
