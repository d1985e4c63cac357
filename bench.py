"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query runs once after a warm-up on the smallest table folder, and its whole result
is consumed by a no-op sink. The retrieval queries answer all benchmark passages in
one plan, so seconds per question are reported next to them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seekspark.catalog import ENTRIES, Tables  # noqa: E402
from seekspark.catalog.texts import questions as asked  # noqa: E402
from seekspark.catalog.texts import stored_lexical_index  # noqa: E402
from seekspark.operators.blockmax import search  # noqa: E402
from seekspark.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UP = "/root/testdata/sf0.001"
RETRIEVAL = [
    "bm25_topk", "dense_topk", "hybrid_retrieval", "graph_local_retrieval",
    "graph_global_retrieval", "mix_retrieval",
]
OTHERS = [
    "lexical_statistics", "cleaned_documents", "document_chunks", "quality_classes",
    "context_matches", "shared_line_components", "entity_degree_table",
    "resolved_entities", "run_counter_report", "pending_job_list",
    "cost_estimates", "agent_run_metrics", "lexical_macro_means", "shortest_graph_paths",
    "layout_section_segments",
]


def main() -> None:
    spark = build_session(
        "seekspark-bench", f"local[{CPUS}]",
        {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables, small = Tables(spark, FOLDER), Tables(spark, WARM_UP)
    for name in ("bm25_topk", "dense_topk"):
        ENTRIES[name].run(small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in RETRIEVAL + OTHERS:
        start = time.perf_counter()
        ENTRIES[name].run(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    # The stored inverted index: its build, then one question and all of them.
    def timed(name: str, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
        return result

    index = timed("bm25_index_build", lambda: stored_lexical_index(tables))
    one = tables.benchmark.orderBy("item_id").limit(1).selectExpr("cast(item_id as string) AS query_id", "text")
    timed("bm25_indexed_one_question", lambda: search(index, one, 8).hits.collect())
    timed("bm25_indexed_all_questions", lambda: search(index, asked(tables), 8).hits.write.format("noop").mode("overwrite").save())
    questions = tables.benchmark.count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "seconds_per_question": {q: round(seconds[q] / questions, 4) for q in RETRIEVAL},
                "questions": questions,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
