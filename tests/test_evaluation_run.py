"""A whole evaluation over a stored test set, with ids and without."""

import json

import pytest

from seekspark.plans.engine import Engine
from seekspark.plans.options import RetrievalOptions
from seekspark.functions.ids import evidence_ids
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("evaluation")
    folder = root / "corpus"
    folder.mkdir()
    (folder / "atlas.txt").write_text("Atlas connects Beacon through the graph and " + "keeps many long stories about it. " * 4)
    (folder / "comet.txt").write_text("Comet passes the harbour every winter night. " + "Sailors wait for the light. " * 4)
    engine = Engine(spark, str(root / "store"))
    engine.ingest(str(folder))
    engine.build_index()
    return engine


def _cases(engine, with_ids):
    place = [F.col(c) for c in ("document_id", "page_start", "page_end", "section_path")]
    rows = {
        r["document_title"]: r
        for r in engine.indexes.load(engine.embedder).chunks.select("*", evidence_ids(*place).alias("ids")).collect()
    }
    out = []
    for title, question in (("atlas", "What connects Atlas and Beacon?"), ("comet", "When does Comet pass the harbour?"), (None, "Who is nobody?")):
        row = rows.get(title)
        case = {"user_input": question, "reference": "r", "reference_contexts": [row["text"]] if row else []}
        if with_ids:
            case |= {
                "evidence_ids": list(row["ids"]) if row else [], "context_evidence_ids": [], "document_ids": [row["document_id"]] if row else [],
                "question_type": "single_hop" if row else "unanswerable", "answerable": row is not None, "evidence_quotes": [],
                "generator_model": "m", "prompt_version": "p", "review_status": "approved",
            }
        out.append(case)
    return out


def _write(engine, tmp_path, version, cases, corpus=None):
    found = corpus or engine.indexes.manifest(engine.indexes.active())["fingerprint"]
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"schema_version": version, "corpus_content_hash": found, "cases": cases}))
    return str(path)


@pytest.mark.parametrize("version", ["1", "2"])
def test_evaluation_covers_every_scope(engine, tmp_path, version):
    path = _write(engine, tmp_path, version, _cases(engine, version == "2"))
    result = engine.evaluate_testset(path, ("bm25",), RetrievalOptions(top_k=1))
    evidence = {(r["scope"], r["case_id"]): r for r in result.evidence.collect()}
    assert sorted(evidence) == [(s, c) for s in ("context", "hits") for c in "123"]
    for scope in ("hits", "context"):
        assert [evidence[(scope, c)]["recall_at_k"] for c in "12"] == [1.0, 1.0]
        assert evidence[(scope, "3")]["applicable"] is False
        assert evidence[(scope, "1")]["matching_method"] == ("evidence_id" if version == "2" else "normalized_context_overlap")
    cited = {r["case_id"]: r for r in result.cited.collect()}
    assert cited["1"]["recall_at_k"] == 1.0 and cited["1"]["retrieved_count"] == 1
    documents = {(r["scope"], r["case_id"]): r["recall_at_k"] for r in result.documents.collect()}
    assert documents[("hits", "2")] == (1.0 if version == "2" else None)
    semantic = {(r["scope"], r["case_id"]): r["mean_max_similarity"] for r in result.semantic.collect()}
    assert set(semantic) == {(s, c) for s in ("hits", "context") for c in "12"} and semantic[("context", "1")] > 0.5
    coverage = {(r["scope"], r["case_id"]): r["complete_chain"] for r in result.coverage.collect()}
    assert coverage[("hits", "1")] == (1.0 if version == "2" else None)
    means = {(r["kind"], r["scope"]): (r["eligible_cases"], r["recall_at_k"]) for r in result.means().collect()}
    assert means[("evidence", "hits")] == (2, 1.0) and means[("cited", "context")] == (2, 1.0)
    behaviour = result.behavior().first()
    assert behaviour["total_cases"] == 3 and behaviour["tp"] >= 2
    assert result.profile_id == engine.indexes.active()


def test_sets_of_other_corpora_are_refused(engine, tmp_path):
    with pytest.raises(ValueError, match="another corpus"):
        engine.evaluate_testset(_write(engine, tmp_path, "2", _cases(engine, True), "0" * 64), ("bm25",))
