"""Inspection by id or prefix over clustered tables."""

import pytest

from seekspark.operators.lookup import ObjectTables


def _store(spark, root):
    store = ObjectTables(spark, root)
    entities = [(f"ent_{i:04d}", f"name {i}") for i in range(400)]
    relations = [(f"rel_{i:04d}", f"ent_{i % 50:04d}", f"ent_{(i * 7) % 400:04d}", "USES") for i in range(600)]
    r = spark.createDataFrame(relations, "relation_id string, source_entity_id string, target_entity_id string, predicate string")
    store.save("entity", spark.createDataFrame(entities, "entity_id string, name string"), "entity_id", 4)
    store.save("outgoing", r, "source_entity_id")
    store.save("incoming", r, "target_entity_id")
    attempts = [("xtr_a", n, f"o{n}") for n in (3, 1, 2)] + [("xtr_b", 1, "o")]
    store.save("chunk_extraction", spark.createDataFrame([("xtr_a", "c1"), ("xtr_b", "c2"), ("xtr_c", "c3")], "extraction_id string, chunk_id string"), "extraction_id")
    store.save("attempts", spark.createDataFrame(attempts, "extraction_id string, ordinal int, outcome string"), "extraction_id")
    return store, relations


def test_prefixes_reach_whole_objects_with_their_parts(spark, tmp_path):
    store, relations = _store(spark, str(tmp_path))
    rows = {r["entity_id"]: r for r in store.inspect("ent_000").collect()}
    assert sorted(rows) == [f"ent_{i:04d}" for i in range(10)]
    for name, row in rows.items():
        assert row["kind"] == "entity" and "entity_evidence" not in row
        assert [r["relation_id"] for r in row["outgoing"]] == [r[0] for r in relations if r[1] == name]
        assert [(r["relation_id"], r["source_entity_id"]) for r in row["incoming"]] == [(r[0], r[1]) for r in relations if r[2] == name]
    found = {r["extraction_id"]: [(a["ordinal"], a["outcome"]) for a in r["attempts"]] for r in store.inspect("xtr_").collect()}
    assert found == {"xtr_a": [(1, "o1"), (2, "o2"), (3, "o3")], "xtr_b": [(1, "o")], "xtr_c": []}
    assert store.parts("ent_0001", "outgoing").count() == 12 and store.inspect("ent_9").count() == 0
    for prefix in ("other_1", "en", ""):
        with pytest.raises(ValueError, match="no kind"):
            store.inspect(prefix)
    with pytest.raises(ValueError, match="no table of relation"):
        store.inspect("rel_1")


def test_a_prefix_is_a_pushed_down_range(spark, tmp_path):
    store, _ = _store(spark, str(tmp_path))
    plan = store.objects("ent_00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(entity_id,ent_00)" in plan and "LessThan(entity_id,ent_01)" in plan
    # Neighbouring ids share a file, so all others are skipped by their row group ranges.
    files = store.objects("ent_00").select("_metadata.file_name").distinct().count()
    everything = spark.read.parquet(f"{tmp_path}/entity").select("_metadata.file_name").distinct().count()
    assert everything == 4 and files <= 2
