"""Test-set source and sink: round trips, versions and rejections."""

import json

import pytest

from seekspark.sources.testsets import read_testset, write_testset

HASH = "ab" * 32
CASE = {
    "user_input": "What is it?", "reference": "This.", "reference_contexts": ["a text"], "evidence_ids": ["d:1"],
    "context_evidence_ids": [], "document_ids": ["d"], "question_type": "single_hop", "answerable": True,
    "evidence_quotes": ["a"], "generator_model": "m", "prompt_version": "p", "review_status": "approved",
}
SOURCE = {
    "source_uri": "u", "filename": "f", "title": "t", "authors": ["x"], "venue": "v", "year": 2020, "pages": "1-2",
    "official_url": "https://example.org", "rights_notice": "r",
}


def _file(tmp_path, value):
    path = tmp_path / "set.json"
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1, ensure_ascii=False), encoding="utf-8")
    return str(path)


def _envelope(*cases, **more):
    return {"schema_version": "2", "corpus_content_hash": HASH, "cases": list(cases), **more}


def test_documents_of_both_versions_are_read(spark, tmp_path):
    found = read_testset(spark, _file(tmp_path, _envelope(CASE, {**CASE, "user_input": "Zweite Frage?"}, sources=[SOURCE])), corpus_hash=HASH)
    rows = found.cases.orderBy("case_index").collect()
    assert [(r["case_index"], r["user_input"], r["answerable"], r["context_evidence_ids"]) for r in rows] == [
        (1, "What is it?", True, []), (2, "Zweite Frage?", True, [])]
    assert found.schema_version == "2" and found.sources == [SOURCE] and len(found.file_sha256) == 64
    old = {k: CASE[k] for k in ("user_input", "reference", "reference_contexts")}
    path = _file(tmp_path, {**_envelope(old), "schema_version": "1"})
    assert read_testset(spark, path).cases.columns == ["case_index", "user_input", "reference", "reference_contexts"]
    with pytest.raises(ValueError, match="schema_version '1'"):
        read_testset(spark, path, versions=("2",))


@pytest.mark.parametrize("value, message", [
    ([CASE], "bare JSON arrays"), ("{broken", "unable to read"), ("3", "object envelope"),
    ({**_envelope(CASE), "schema_version": "3"}, "schema_version '3'"), ({**_envelope(CASE), "corpus_content_hash": "AB" * 32}, "hexadecimal digest"),
    (_envelope(), "non-empty"), ({**_envelope(), "cases": {}}, "non-empty"), (_envelope(CASE, sources=[]), "non-empty JSON array"),
    (_envelope(CASE, sources=[{**SOURCE, "year": True}]), "year"), (_envelope(CASE, sources=[SOURCE, SOURCE]), "repeats"),
    (_envelope(CASE, sources=[{**SOURCE, "authors": [""]}]), "lacks"), (_envelope(CASE, sources=[{**SOURCE, "official_url": "http://x"}]), "HTTPS"),
])
def test_bad_envelopes_are_rejected(spark, tmp_path, value, message):
    with pytest.raises(ValueError, match=message):
        read_testset(spark, _file(tmp_path, value))


@pytest.mark.parametrize("change, message", [
    ({"user_input": " "}, "item 2 has no user_input"), ({"reference": 5}, "has no reference"), ({"answerable": "true"}, "answerable"),
    ({"evidence_ids": "d"}, "evidence_ids"), ({"evidence_ids": ["d", None]}, "evidence_ids"), ({"document_ids": [1]}, "document_ids"),
    ({"question_type": None}, "question_type"),
])
def test_bad_cases_stop_the_reader(spark, tmp_path, change, message):
    found = read_testset(spark, _file(tmp_path, _envelope(CASE, {**CASE, **change})))
    with pytest.raises(Exception, match=message):
        found.cases.collect()
    with pytest.raises(Exception, match="must be an object"):
        read_testset(spark, _file(tmp_path, _envelope(CASE, "text"))).cases.collect()


def test_written_sets_round_trip_and_appear_at_once(spark, tmp_path):
    found = read_testset(spark, _file(tmp_path, _envelope(CASE, {**CASE, "answerable": False})))
    folder = str(tmp_path / "out")
    digest = write_testset(found.cases, folder, HASH, sources=[SOURCE])
    back = read_testset(spark, folder, corpus_hash=HASH)
    assert back.file_sha256 == digest and back.sources == [SOURCE]
    assert sorted(map(tuple, back.cases.collect())) == sorted(map(tuple, found.cases.collect()))
    with pytest.raises(ValueError, match="another corpus"):
        read_testset(spark, folder, corpus_hash="cd" * 32)
    with pytest.raises(FileExistsError):
        write_testset(found.cases, folder, HASH)
    bad = found.cases.replace("What is it?", "  ", "user_input")
    with pytest.raises(Exception, match="user_input"):
        write_testset(bad, folder, HASH, overwrite=True)
    with pytest.raises(ValueError, match="at least one case"):
        write_testset(found.cases.where("false"), folder, HASH, overwrite=True)
    assert read_testset(spark, folder).cases.count() == 2
    write_testset(found.cases.where("answerable"), folder, "cd" * 32, overwrite=True)
    assert read_testset(spark, folder, corpus_hash="cd" * 32).cases.count() == 1
