import numpy as np
from pyspark.sql import functions as F

from seekspark.llm.neighbours import build_tree, nearest_neighbours, search_tree
from seekspark.llm import similarity_join
from seekspark.llm.similarity_join import linked_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, raw int"


def _rows(count, width, seed, hot=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(count, width)) * rng.uniform(0.5, 2, (count, 1))
    vectors[count // 2 :] = vectors[: count - count // 2] + rng.normal(size=(count - count // 2, width)) * 0.15
    if hot:
        vectors[:hot] = vectors[0]
    vectors = vectors.astype(np.float32)
    rows = [(i, v.tolist(), i % 3, "x", 0) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), [1.0]]
    rows += [(10_000 + i, v, 0, "x", 0) for i, v in enumerate(odd)] + [(None, [1.0] * width, 0, "x", 0)]
    return vectors.astype(float), rows


def test_neighbours_equal_brute_force_at_factor_one(spark):
    vectors, rows = _rows(400, 12, 1, hot=60)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = nearest_neighbours(frame, "vec_id", "embedding", F.col("id") % 20 == 0, k=7, factor=1.0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert sorted(by_query) == list(range(0, 400, 20))
    for q, got in by_query.items():
        score = (vectors * vectors[q]).sum(1)
        order = [i for i in sorted(range(400), key=lambda i: (-score[i], i)) if i != q][:7]
        assert got == [(i, round(score[i], 9)) for i in order]


def test_pruned_search_keeps_recall():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 32))
    queries = vectors[::30] + 0.1 * rng.normal(size=(100, 32))
    tree = build_tree(vectors, [np.array([i]) for i in range(3000)], float((vectors**2).sum(1).max()))
    truth = np.sort(queries @ vectors.T, axis=1)[:, -10:]
    for factor, least in ((1.0, 1.0), (2.0, 0.95)):
        row, column = search_tree(tree, queries, 10, factor)
        score = (queries[row] * tree.vectors[column]).sum(1)
        assert (score >= truth[row, 0] - 1e-9).sum() >= least * 1000


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (1, [2.0, 0.0], 0, "", 0)], SCHEMA)
    found = nearest_neighbours(frame, "vec_id", "embedding", F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 2.0)]
    assert nearest_neighbours(frame.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    assert linked_vectors(frame.limit(0), "vec_id", "embedding").count() == 0


def test_links_equal_brute_force(spark):
    vectors, rows = _rows(500, 20, 2, hot=90)
    rows.append(rows[7])
    found = linked_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding").collect()
    unit = vectors / np.sqrt((vectors**2).sum(1))[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(500)
    while True:
        low = np.array([min([label[i], *label[linked[i]]]) for i in range(500)])
        if (low == label).all():
            break
        label = low
    got = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    assert len(found) == 500 + 7 + 1 and linked.sum() > 500
    for i in range(500):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[i].sum(), label[i], label[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(10_000, 10_007))


def test_several_strips_find_the_same_links(spark, monkeypatch):
    from seekspark.llm import similarity_join

    _, rows = _rows(600, 20, 4)
    frame = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, linked_vectors(frame, "vec_id", "embedding").where("vec_id is not null").collect()))
    monkeypatch.setattr(similarity_join, "STRIP_VECTORS", 100)
    monkeypatch.setattr(similarity_join, "GUEST_VECTORS", 50)
    assert sorted(map(tuple, linked_vectors(frame, "vec_id", "embedding").where("vec_id is not null").collect())) == one


def test_links_at_the_limit_are_kept(spark):
    """Pairs whose cosine is the limit, or a last bit beside it, in few and many dimensions."""
    rng = np.random.default_rng(11)
    for width in (2, 8, 64):
        base = rng.normal(size=(150, width))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        vectors = np.concatenate([base, 0.95 * base + np.sqrt(1 - 0.95**2) * side])
        unit = similarity_join._unit(vectors)
        close = np.array([(unit[i] * unit).sum(1) >= 0.95 for i in range(len(unit))])
        np.fill_diagonal(close, False)
        assert 0 < sum(close[i, i + 150] for i in range(150)) < 150
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found = {r["vec_id"]: r["n_links"] for r in linked_vectors(frame, "vec_id", "embedding").collect()}
        assert found == dict(enumerate(close.sum(1).tolist())), width


def test_tiles_are_small_and_strips_compare_near_ones_only(monkeypatch):
    from seekspark.llm import similarity_join

    made = np.random.default_rng(5)
    points = made.normal(size=(1000, 8))
    members = np.arange(0, 1000, 3)
    monkeypatch.setattr(similarity_join, "TILE", 20)
    tiles = similarity_join._tiles(points, members)
    assert sorted(np.concatenate(tiles)) == members.tolist() and max(map(len, tiles)) <= 20
    assert similarity_join._tiles(points, members[:0]) == []

    base = made.normal(size=(60, 16))
    vectors = np.concatenate([base + 0.08 * made.normal(size=base.shape) for _ in range(8)])
    turned = similarity_join._unit(vectors) @ similarity_join.rotation(16)
    ids, copies = made.permutation(len(vectors)), made.integers(1, 4, len(vectors))
    unit = similarity_join._unit(vectors)
    linked = unit @ unit.T >= 0.95
    budgets = similarity_join._budgets(16, 0.95)
    parts = similarity_join._blocks(16)
    gaps = [((turned[:, None, p] - turned[None, :, p]) ** 2).sum(2) <= b + similarity_join.ROUNDING for p, b in zip(parts, budgets)]
    home = turned[:, 0] > np.median(turned[:, 0])
    for pair_homes in (True, False):
        for block, mine in ((0, gaps[0]), (1, gaps[1] & ~gaps[0])):
            pairs = linked & mine & (home[:, None] | home[None, :]) & ~np.eye(len(ids), dtype=bool)
            if not pair_homes:
                pairs &= home[:, None] != home[None, :]
            found = similarity_join.strip_links(vectors, ids, copies, home, block, 0.95, pair_homes).set_index("id")["links"]
            expected = (pairs * copies[None, :]).sum(1)
            assert found.to_dict() == {int(i): int(n) for i, n in zip(ids, expected) if n}
    assert linked.sum() > 2 * len(ids)
