"""The quality model and its limits rest on all trusted texts."""

from __future__ import annotations

from seekspark.llm import quality


def test_all_trusted_texts_are_fitted_and_set_the_limits(spark, monkeypatch):
    texts = [f"the river number {i % 7} flows by town {chr(97 + i % 20)}" for i in range(60)]
    rows = [(i, t, "xx" if i % 3 else "yy") for i, t in enumerate(texts)] + [(90, "%%## &&", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    fitted, judged = [], []
    fit, judge = quality._fitted, quality.perplexities

    def counted(alphabet, table, total):
        fitted.append((table.groupBy().sum("n").first()[0], total))
        return fit(alphabet, table, total)

    def listed(part, model, *keep):
        judged.append((sorted(r["doc_id"] for r in part.select("doc_id").collect()), model.total))
        return judge(part, model, *keep)

    monkeypatch.setattr(quality, "_fitted", counted)
    monkeypatch.setattr(quality, "perplexities", listed)
    found = quality.quality_scores(docs, labels).collect()
    everything = sum(len(t) + 1 for t in texts)
    assert max(n for n, _ in fitted) == everything and sorted(n for n, _ in fitted)[:2] != [0, 0]
    assert sum(sorted(n for n, _ in fitted)[:2]) == everything  # the halves
    assert judged[0][0] == [90] and sorted(judged[1][0] + judged[2][0]) == list(range(60))
    assert len(found) == 61 and sum(r["kept"] for r in found if r["doc_id"] < 60) == 60
