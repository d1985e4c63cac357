from seekspark.operators import planning


def test_apportionment_by_largest_remainder():
    assert planning.apportion(60) == {"single_hop": 30, "summary_reasoning": 10, "multi_context": 10, "unanswerable": 10}
    assert planning.apportion(7) == {"single_hop": 4, "summary_reasoning": 1, "multi_context": 1, "unanswerable": 1}
    assert sum(planning.apportion(8).values()) == 8 and planning.apportion(8)["summary_reasoning"] == 2


def test_plan_takes_turns_and_finds_the_related_context(spark):
    rows = [(d, p, f"{d}{p}") for d, n in (("a", 2), ("b", 3)) for p in range(n)]
    contexts = spark.createDataFrame(rows, "document_id string, place int, context_id string")
    plan = planning.plan_contexts(contexts, 6).orderBy("case_index", "draw")
    got = [(r["case_index"], r["question_type"][0], r["context_id"], r["other_document"]) for r in plan.collect()]
    assert got == [
        (1, "s", "a0", None), (2, "s", "b0", None), (3, "s", "a1", None), (4, "s", "a0", None), (4, "s", "a1", None),
        (5, "m", "a0", "b"), (6, "u", "a1", None),
    ]
    words = [(d, c, w) for d, _, c in rows for w in ({"a0": "x y", "b1": "x y"}.get(c, "z" + c)).split()]
    terms = spark.createDataFrame(words, "document_id string, context_id string, term string")
    second = planning.second_contexts(plan, terms).collect()
    assert [(r["case_index"], r["context_id"], r["jaccard"]) for r in second] == [(5, "b1", 1.0)]
    assert planning.below_minimum(plan, contexts, 2).collect()[0]["document_id"] == "b"
