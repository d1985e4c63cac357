"""Agent runs, evaluation runs and streamed events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.evaluation import GOLD_SQL, cases, gold_identities, scores_sql
from seekspark.catalog.registry import Tables, query
from seekspark.catalog.retrieval import BASE_SQL, HYBRID_SQL, document_index
from seekspark.catalog.texts import questions, ranked_sql, rounded
from seekspark.operators import metrics
from seekspark.plans import retrieval as plan
from seekspark.plans.agent import AgentRunner
from seekspark.scale import cut_lineage
from seekspark.streaming import events as stream


@query()
def agent_event_log(t: Tables) -> DataFrame:
    """Event log of one bounded run per benchmark passage."""
    log = AgentRunner(document_index(t)).run(questions(t))
    return log.select("run_id", "position", "step", "event", "tool", "ok")


def _modes_sql() -> str:
    """Both strategies' hits and delivered context, each scored against the gold documents."""
    truth = GOLD_SQL.replace("dn", "gd")
    parts = [f"bm AS ({ranked_sql('bm25', 8)}), hy AS ({ranked_sql('hybrid', 8)})"]
    means = []
    for mode, ranked in (("bm25", "bm"), ("hybrid", "hy")):
        kept = f"{ranked}_k"
        parts.append(f"""{ranked}_n AS (SELECT query_id, object_id, rank, len(regexp_extract_all('[citation=' || object_id || '; document=' || source || '; section=' || lang || '; pages=n/a]' || chr(10) || d.text, '\\S+')) AS tokens FROM {ranked} JOIN documents d ON CAST(doc_id AS VARCHAR) = object_id),
{ranked}_l AS (SELECT query_id, list({{'o': object_id, 'n': tokens}} ORDER BY rank) AS l FROM {ranked}_n GROUP BY 1),
{ranked}_f AS (SELECT query_id, list_reduce(list_prepend({{'u': 0, 'k': ['']}}, list_transform(l, lambda x: {{'u': x.n, 'k': [x.o]}})), lambda a, x: CASE WHEN a.u + x.u <= 2400 THEN {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} ELSE a END) AS r FROM {ranked}_l),
{kept} AS (SELECT query_id, unnest(CASE WHEN len(r.k) > 1 THEN r.k[2:] ELSE [l[1].o] END) AS object_id, unnest(range(1, greatest(len(r.k), 2))) AS rank FROM {ranked}_f JOIN {ranked}_l USING (query_id))""")
        for scope, table in (("hits", ranked), ("context", kept)):
            name = f"s_{table}"
            parts.append(scores_sql(name, table).strip())
            means.append(f"""SELECT '{mode}' AS mode, '{scope}' AS scope, count(*) AS total_cases, count(*) FILTER (applicable) AS eligible_cases, count(*) FILTER (NOT applicable) AS excluded_cases,
 round(avg(hit_at_k), 6) AS hit_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k,
 round(CAST(sum(matched_count) FILTER (applicable) AS DOUBLE) / sum(relevant_count) FILTER (applicable), 6) AS micro_recall FROM {name}""")
    return f"WITH {BASE_SQL}, {HYBRID_SQL}, {truth}, " + ", ".join(parts) + " " + " UNION ALL ".join(means)


@query(_modes_sql())
def evaluated_modes(t: Tables) -> DataFrame:
    """Two strategies on the same cases: macro means of hits and delivered context."""
    index, truth = document_index(t), cut_lineage(gold_identities(t))
    asked = plan._Asked(index, plan.prepare_questions(questions(t)))
    frames = []
    for mode in ("bm25", "hybrid"):
        found = plan.retrieve(index, questions(t), mode, asked=asked)
        for scope, rows, rank in (("hits", found.hits, "rank"), ("context", found.context, "position")):
            ranked = rows.select(
                F.col("query_id").alias("case_id"), F.col(rank).alias("rank"), F.col("object_id").alias("identity")
            )
            scores = metrics.retrieval_scores(cases(t), ranked, truth, 8)
            frames.append(metrics.macro_means(scores, []).select(F.lit(mode).alias("mode"), F.lit(scope).alias("scope"), "*"))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return rounded(whole, *metrics.METRICS, "micro_recall")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streamed_event_windows(t: Tables) -> DataFrame:
    """Daily counts per event type, computed by a streaming query over the event table."""
    source = stream.read_event_stream(t.spark, f"{t.folder}/events.parquet")
    table = stream.run_to_memory(stream.windowed_counts(source), "windows_" + uuid.uuid4().hex, "complete")
    return table.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")
    )
