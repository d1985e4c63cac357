"""Copy-on-write store, invalidation closure, resumable runs, streaming upserts."""

import json

import pytest
from pyspark.sql import functions as F

from seekspark.plans.engine import Engine
from seekspark.storage import snapshots
from seekspark.storage.closure import DependencyStore, edges, invalidation_closure
from seekspark.storage.files import SharedFiles
from seekspark.storage.snapshots import CommitConflict, SnapshotStore
from seekspark.storage.stages import RunStore, stage_listing

SCHEMAS = {"docs": "id string, v int", "parts": "id string, n int"}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id string, v int")


def _state(store, name="docs", version=None):
    return sorted(tuple(r)[:2] for r in store.table(name, version).collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), SCHEMAS, "id", 16)
    assert store.version() == 0 and _state(store) == []
    rows = [(f"k{i}", i) for i in range(200)]
    parts = spark.createDataFrame([(k, n) for k, _ in rows for n in range(2)], SCHEMAS["parts"])
    assert store.replace(_docs(spark, rows), {"docs": _docs(spark, rows), "parts": parts}) == 1
    before = store.manifest()["tables"]["docs"]
    change = _docs(spark, [("k3", -1), ("new", 7)])
    assert store.replace(change, {"docs": change}) == 2
    touched = store.touched(change)
    after = store.manifest()["tables"]["docs"]
    assert store.changed_buckets("docs", 1, 2) == touched and 1 <= len(touched) <= 2
    assert all(after[b] == c for b, c in before.items() if int(b) not in touched)
    assert _state(store) == sorted([(k, v) for k, v in rows if k != "k3"] + [("k3", -1), ("new", 7)])
    assert store.table("parts").where("id = 'k3'").count() == 0 and store.table("parts").count() == 398
    assert _state(store, version=1) == sorted(rows)
    store.replace(_docs(spark, [("new", 0)]), {})
    assert store.table("docs").where("id = 'new'").isEmpty() and store.version() == 3
    assert store.replace(_docs(spark, []), {}) == 3
    assert SnapshotStore(spark, str(tmp_path / "s"), SCHEMAS, "id", 99).buckets == 16


def test_expired_versions_leave_the_rest_readable(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), SCHEMAS, "id", 4)
    for n in range(4):
        rows = _docs(spark, [(f"k{n}", n), ("k0", n)])
        store.replace(rows, {"docs": rows})
    assert store.expire(2) == [1, 2] and store.versions() == [0, 3, 4]
    assert _state(store, version=3) == [("k0", 2), ("k1", 1), ("k2", 2)]
    assert _state(store) == [("k0", 3), ("k1", 1), ("k2", 2), ("k3", 3)]
    with pytest.raises(ValueError, match="version 1"):
        store.table("docs", 1)


def test_rival_commits_conflict(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    mine, rival = (SnapshotStore(spark, root, SCHEMAS, "id", 4) for _ in range(2))
    start = _docs(spark, [("a", 1)])
    mine.replace(start, {"docs": start})
    real = SnapshotStore.touched

    def slow(self, rows):
        if self is mine:
            monkeypatch.setattr(snapshots.SnapshotStore, "touched", real)
            rival.replace(start, {"docs": _docs(spark, [("a", 2)])})
        return real(self, rows)

    monkeypatch.setattr(snapshots.SnapshotStore, "touched", slow)
    with pytest.raises(CommitConflict):
        mine.replace(start, {"docs": _docs(spark, [("a", 3)])})
    assert _state(mine) == [("a", 2)]


def test_files_are_created_once(spark, tmp_path):
    files = SharedFiles(spark)
    path = str(tmp_path / "m")
    assert files.create(path, "one") and not files.create(path, "two") and files.read(path) == "one"
    files.write(path, "drei ü")
    assert files.read(path) == "drei ü" and files.names(str(tmp_path)) == ["m"] and files.read(path + "x") is None


def test_closure_reaches_a_fixed_point_over_cycles(spark, tmp_path):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "a"), ("d", None)]
    rows = spark.createDataFrame(pairs, "u string, i string")
    deps = edges(rows, "n", "u", "n", "i")
    changed = spark.createDataFrame([("n", "a"), ("n", None), ("other", "x")], "kind string, id string")
    found = {(r["kind"], r["id"]): r["depth"] for r in invalidation_closure(deps, changed).collect()}
    assert found == {("n", "a"): 0, ("other", "x"): 0, ("n", "b"): 1, ("n", "c"): 2, ("n", "d"): 3}
    assert invalidation_closure(deps, changed.where("false")).count() == 0
    store = DependencyStore(spark, str(tmp_path / "d"))
    assert store.edges().count() == 0
    store.record("one", deps)
    store.record("two", edges(rows.where("u = 'x'"), "n", "u", "m", "i"))
    store.record("one", deps.where("upstream_id = 'a'"))
    assert sorted((r["upstream_id"], r["kind"], r["id"]) for r in store.edges().collect()) == [("a", "n", "b"), ("x", "m", "y")]
    store.forget("one")
    assert store.owners() == ["two"]


def test_stages_and_items_are_computed_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "r"))
    calls = []

    def build(name, rows, fail=False):
        def run():
            calls.append(name)
            if fail:
                raise RuntimeError(name)
            return {name: spark.createDataFrame([(i,) for i in range(rows)], "i int")}

        return run

    store.run("one").stage("first", build("first", 3))
    with pytest.raises(RuntimeError):
        store.run("one").stage("second", build("second", 2, fail=True))
    again = store.run("one")
    assert again.stage("first", build("first", 9))["first"].count() == 3
    assert again.stage("second", build("second", 0))["second"].count() == 0
    assert calls == ["first", "second", "second"]
    listed = {(r["stage"], r["rows"]) for r in stage_listing(spark, f"{store.root}/runs").collect()}
    assert listed == {("first", 3), ("second", 0)}

    offered = []

    def model(limit):
        def run(items):
            if len(offered) >= limit:
                raise RuntimeError("stopped")
            offered.append([r["id"] for r in items.collect()])
            return items.select("id", F.upper("id").alias("answer"))

        return run

    items = spark.createDataFrame([(f"c{i}",) for i in range(20)], "id string")
    with pytest.raises(RuntimeError):
        store.run("two").items("ask", items, "id", model(2), parts=4)
    more = items.unionByName(spark.createDataFrame([("late",)], "id string"))
    whole = store.run("two").items("ask", more, "id", model(99), parts=4)
    assert sorted(sum(offered, [])) == sorted([f"c{i}" for i in range(20)] + ["late"])
    assert sorted(r["answer"] for r in whole.collect()) == sorted(i.upper() for i in sum(offered, []))


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)


def _completer(asked):
    def run(chunks):
        rows = [(r["chunk_id"], r["text"]) for r in chunks.collect()]
        asked.extend(c for c, _ in rows)
        made = []
        for chunk, text in rows:
            names = [n for n in ("Atlas", "Beacon", "Comet") if n in text]
            entities = [
                {"ref": f"e{i + 1}", "name": n, "entity_type": "node", "description": n, "evidence_quotes": [n]}
                for i, n in enumerate(names)
            ]
            made.append(("x" + chunk, chunk, text, json.dumps({"entities": entities, "relations": []}), "stop"))
        schema = "extraction_id string, chunk_id string, chunk_text string, content string, finish_reason string"
        return chunks.sparkSession.createDataFrame(made, schema)

    return run


def test_stopped_graph_builds_go_on_and_changes_make_them_stale(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    _write(folder, "a.txt", "Atlas meets Beacon.")
    _write(folder, "b.txt", "Comet alone.")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.ingest(str(folder)).version == 1
    asked = []
    from seekspark.plans import engine as module

    for failing in ("validate_relations", "extraction_quality"):
        with monkeypatch.context() as patch:
            patch.setattr(module.extraction, failing, lambda *a: (_ for _ in ()).throw(RuntimeError(failing)))
            with pytest.raises(RuntimeError):
                engine.build_graph(_completer(asked), run_id="g")
        with pytest.raises(ValueError, match="no ready"):
            engine.graph()
    with monkeypatch.context() as patch:
        patch.setattr(module.extraction, "validate_entities", lambda *a: pytest.fail("computed again"))
        graph = engine.build_graph(_completer(asked), run_id="g")
    assert sorted(r["canonical_name"] for r in graph.entities.collect()) == ["Atlas", "Beacon", "Comet"]
    assert len(asked) == len(set(asked)) == 2 and engine.graphs.active() == "g"
    assert engine.graphs.state("g")["nodes"] == 3
    index = engine.build_index(graph)

    assert engine.ingest(str(folder)).stale.count() == 0 and engine.graph().run_id == "g"
    _write(folder, "b.txt", "Comet has changed.")
    result = engine.ingest(str(folder))
    kinds = {(r["kind"], r["depth"]) for r in result.stale.collect()}
    assert kinds == {("document", 0), ("chunk", 1), ("entity", 2), ("run", 2), ("profile", 2)}
    assert engine.graphs.state("g")["status"] == "stale" and engine.graphs.active() is None
    assert engine.indexes.manifest(index.profile_id)["status"] == "failed"
    with pytest.raises(ValueError, match="no ready"):
        engine.graph()
    again = engine.build_graph(_completer(asked), run_id="h")
    assert again.run_id == "h" and len(asked) == 4


def test_stream_upserts_are_idempotent_and_keep_bad_files(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.txt", "one\n\nmore")
    _write(folder, "bad.txt", b"\xff\xfe\xfa")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.watch(str(folder), str(tmp_path / "cp")).awaitTermination()
    assert engine.corpus.version() == 1 and engine.documents().count() == 1
    assert [r["error"] for r in engine.dead_letters().collect()] == ["not valid UTF-8"]
    _write(folder, "b.txt", "two")
    engine.watch(str(folder), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["title"] for r in engine.documents().collect()) == ["a", "b"]
    first = engine.corpus.manifest(1)["tables"]["documents"]
    now = engine.corpus.manifest()["tables"]["documents"]
    assert all(now[b] == c for b, c in first.items())
    # The same batches again, as after a crash before their checkpoint: nothing changes.
    engine.watch(str(folder), str(tmp_path / "cp2")).awaitTermination()
    assert engine.corpus.version() == 2 and engine.documents().count() == 2
    gone = engine.remove_documents(engine.documents().where("title = 'a'").select("document_id"))
    assert {r["kind"] for r in gone.collect()} == {"document", "chunk"}
    assert [r["title"] for r in engine.documents().collect()] == ["b"] and engine.chunks().count() == 1
