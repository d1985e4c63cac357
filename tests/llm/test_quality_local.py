"""N-grams that every task can hold are scored in place, however rare they are."""

from __future__ import annotations

from seekspark.llm import quality


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_rare_ngrams_are_local_while_there_is_room(spark, monkeypatch):
    texts = ["the river flows by the town and the river"] * 30 + ["a rare quokka jumps"]
    model = quality.train_quality_model(_texts(spark, texts))
    grams = {r["key"]: r["n"] for r in model.grams[quality.ORDER].collect()}
    assert {1, 30} <= set(grams.values())
    # A share of 1 / 200 puts the limit of the frequent ones above 1; all 200 fit.
    monkeypatch.setattr(quality, "LOCAL_SHARE", 1 / 200)
    assert model.total / 200 > 1 and len(grams) <= 200
    key, value = model.local
    assert len(key) == len(value) == len(grams)


def test_the_local_ngrams_never_outgrow_their_number(spark, monkeypatch):
    texts = ["abcdefgh" * 3] * 9 + ["ijklmnop"] * 2 + ["qrstuvwxyz"]
    model = quality.train_quality_model(_texts(spark, texts))
    counts = sorted((r["n"] for r in model.grams[quality.ORDER].collect()), reverse=True)
    for most in (1, 5, 12, 20, 25, len(counts)):
        monkeypatch.setattr(quality, "LOCAL_SHARE", 1 / most)
        model.__dict__.pop("local", None)
        held = len(model.local[0])
        assert held <= most
        # As many whole counts as fit.
        below = [n for n in counts[held:]]
        assert not below or held + counts.count(below[0]) > most


def test_scores_of_each_model_are_planned_alone(spark, monkeypatch):
    docs = _texts(spark, [f"the river number {i % 7} flows by" for i in range(20)] + ["%%##"])
    docs = docs.selectExpr("*", "'xx' AS lang")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    joins, keep = [], quality.stored

    def counted(df, *partition_by):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(df, *partition_by)

    monkeypatch.setattr(quality, "stored", counted)
    assert quality.quality_scores(docs, labels).count() == 21
    assert max(joins) <= 2 * quality.ORDER + 5
