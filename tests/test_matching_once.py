"""Texts are normalized and fingerprinted once, by one Python worker of a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekspark.functions.text import exact_casefold, nfkc, squeeze
from seekspark.operators import matching

TEXTS = [
    "A  b\tc", " x ", "\x85y z　", "a\x1cb\x1f", "m᠎v", "n​w", " o p  q",
    "ﬁne Straße İ", "¨", "", None, "\r\n\x0b\x0c", "Ⅷ ²",
]


def test_normal_form_equals_its_parts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    found = rows.select("id", matching.normal_form(F.col("text")).alias("a"), exact_casefold(squeeze(nfkc(F.col("text")))).alias("b"))
    assert all(r["a"] == r["b"] for r in found.collect())


def _python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_each_text_passes_one_python_step(spark):
    rows = spark.createDataFrame([("1", "some text " * 20)], "id string, text string")
    normal = rows.select("id", matching.normal_form(F.col("text")).alias("normal")).where(F.length("normal") > 0)
    assert _python_steps(normal) == 1
    stored = spark.createDataFrame([("1", "some text " * 20)], "id string, normal string")
    for keys in (matching.segment_keys, matching.reference_keys):
        assert _python_steps(stored.select("id", F.explode(keys("normal")).alias("key")).where("key is not null")) == 1
