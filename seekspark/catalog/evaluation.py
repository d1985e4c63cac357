"""Evaluation queries: benchmark passages are questions, the documents that contain
them are the gold evidence, rankings come from the lexical and dense operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.registry import Tables, query
from seekspark.catalog.texts import (
    CORPUS_SQL, TOKENS_SQL, bm25_sql, corpus, dense_sql, embedded, questions, ranked_sql, rounded,
)
from seekspark.functions.text import lexical_tokens
from seekspark.operators import citations, dense, lexical, matching, metrics

NORMAL_SQL = r"replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss')"
GOLD_SQL = f"""bn AS MATERIALIZED (SELECT item_id, CAST(item_id AS VARCHAR) AS query_id, {NORMAL_SQL.format('text')} AS x FROM benchmark),
dn AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS object_id, source, {NORMAL_SQL.format('text')} AS x FROM documents),
gold AS (SELECT query_id, object_id, bn.x = dn.x AS equal FROM bn JOIN dn ON bn.x = dn.x OR (length(bn.x) >= 80 AND length(dn.x) > 0 AND (contains(dn.x, bn.x) OR contains(bn.x, dn.x)))
  QUALIFY bn.x = dn.x OR NOT bool_or(bn.x = dn.x) OVER (PARTITION BY query_id))"""


def scores_sql(name: str, ranked: str, k: int = 8) -> str:
    """CTEs ending in ``{name}``: one metric row per question."""
    return f"""
{name}_hit AS (SELECT query_id, rank FROM {ranked} JOIN gold USING (query_id, object_id) WHERE rank <= {k}),
{name}_agg AS (SELECT query_id, count(*) AS matched, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM {name}_hit GROUP BY 1),
{name}_gold AS (SELECT query_id, count(DISTINCT object_id) AS relevant FROM gold GROUP BY 1),
{name}_ret AS (SELECT query_id, count(*) AS n FROM {ranked} WHERE rank <= {k} GROUP BY 1),
{name} AS (SELECT query_id AS case_id, coalesce(relevant, 0) > 0 AS applicable, coalesce(relevant, 0) AS relevant_count, coalesce(n, 0) AS retrieved_count,
 coalesce(matched, 0) AS matched_count, CASE WHEN relevant > 0 THEN CAST(best IS NOT NULL AS DOUBLE) END AS hit_at_k,
 CASE WHEN relevant > 0 THEN coalesce(matched, 0) / relevant END AS recall_at_k, CASE WHEN relevant > 0 THEN coalesce(1 / best, 0.0) END AS mrr,
 CASE WHEN relevant > 0 THEN coalesce(dcg, 0.0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(relevant, {k}) + 1 AS BIGINT)) r(i)) END AS ndcg_at_k
 FROM bn LEFT JOIN {name}_gold USING (query_id) LEFT JOIN {name}_ret USING (query_id) LEFT JOIN {name}_agg USING (query_id))"""


SCORE_COLUMNS = """case_id, applicable, relevant_count, retrieved_count, matched_count, round(hit_at_k, 6) AS hit_at_k,
 round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k"""


def gold(t: Tables) -> DataFrame:
    contexts = t.benchmark.select(F.col("item_id").cast("string").alias("context_id"), "text")
    segments = t.documents.select(F.col("doc_id").cast("string").alias("segment_id"), "text")
    return matching.match_contexts(contexts, segments)


def gold_identities(t: Tables) -> DataFrame:
    return gold(t).select(F.col("context_id").alias("case_id"), F.col("segment_id").alias("identity"))


def cases(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").cast("string").alias("case_id"))


def as_ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("query_id").alias("case_id"), "rank", F.col("object_id").alias("identity"))


def bm25_ranked(t: Tables, k: int = 8) -> DataFrame:
    return as_ranked(lexical.bm25_top_k(corpus(t), questions(t), k))


def dense_ranked(t: Tables, k: int = 8) -> DataFrame:
    return as_ranked(
        dense.dense_top_k(embedded(corpus(t), "object_id"), embedded(questions(t), "query_id"), k, 384)
    )


@query(f"WITH {GOLD_SQL} SELECT query_id AS context_id, object_id AS segment_id, equal FROM gold")
def context_matches(t: Tables) -> DataFrame:
    """Documents that contain a benchmark passage, or are contained in one."""
    return gold(t)


@query(f"""WITH {bm25_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}), {scores_sql('sc', 'r')} SELECT {SCORE_COLUMNS} FROM sc""")
def lexical_retrieval_scores(t: Tables) -> DataFrame:
    scores = metrics.retrieval_scores(cases(t), bm25_ranked(t), gold_identities(t), 8)
    return rounded(scores, *metrics.METRICS)


@query(f"""WITH {bm25_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}), {scores_sql('sc', 'r')}
SELECT count(*) AS total_cases, count(*) FILTER (applicable) AS eligible_cases, count(*) FILTER (NOT applicable) AS excluded_cases,
 round(avg(hit_at_k), 6) AS hit_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k,
 round(CAST(sum(matched_count) FILTER (applicable) AS DOUBLE) / sum(relevant_count) FILTER (applicable), 6) AS micro_recall FROM sc""")
def lexical_macro_means(t: Tables) -> DataFrame:
    scores = metrics.retrieval_scores(cases(t), bm25_ranked(t), gold_identities(t), 8)
    return rounded(metrics.macro_means(scores, []), *metrics.METRICS, "micro_recall")


PAIR_SQL = f"""{bm25_sql()}, {dense_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}), q AS ({ranked_sql('dense', 8)}),
{scores_sql('a', 'r')}, {scores_sql('b', 'q')}, j AS (SELECT a.case_id, b.hit_at_k - a.hit_at_k AS d1, b.recall_at_k - a.recall_at_k AS d2,
 b.mrr - a.mrr AS d3, b.ndcg_at_k - a.ndcg_at_k AS d4 FROM a JOIN b USING (case_id) WHERE a.applicable AND b.applicable),
l AS (SELECT case_id, 'hit_at_k' AS label, d1 AS delta FROM j UNION ALL SELECT case_id, 'recall_at_k', d2 FROM j UNION ALL SELECT case_id, 'mrr', d3 FROM j UNION ALL SELECT case_id, 'ndcg_at_k', d4 FROM j)"""


def deltas(t: Tables) -> DataFrame:
    truth = gold_identities(t)
    baseline = metrics.retrieval_scores(cases(t), bm25_ranked(t), truth, 8)
    candidate = metrics.retrieval_scores(cases(t), dense_ranked(t), truth, 8)
    return metrics.paired_deltas(baseline, candidate, metrics.METRICS)


@query(f"""WITH {PAIR_SQL} SELECT label, count(*) AS eligible_pairs, count(*) FILTER (delta > 1e-12) AS candidate_wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties,
 count(*) FILTER (delta < -1e-12) AS baseline_wins, round(avg(CAST(delta > 1e-12 AS INTEGER)), 6) AS candidate_win_rate, round(avg(CAST(abs(delta) <= 1e-12 AS INTEGER)), 6) AS tie_rate,
 round(avg(CAST(delta < -1e-12 AS INTEGER)), 6) AS baseline_win_rate, round(avg(delta), 6) AS mean_delta FROM l GROUP BY label""")
def paired_mode_comparison(t: Tables) -> DataFrame:
    """Dense against BM25 on the same cases."""
    found = metrics.paired_summary(deltas(t))
    return rounded(found, "candidate_win_rate", "tie_rate", "baseline_win_rate", "mean_delta")


@query()
def paired_bootstrap_intervals(t: Tables) -> DataFrame:
    """Seeded percentile intervals; checked against the plain formula in tests."""
    return rounded(metrics.bootstrap_means(deltas(t)), "ci_low", "ci_high")


@query(f"""WITH {bm25_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}), {scores_sql('sc', 'r')},
 dg AS (SELECT DISTINCT query_id, source FROM gold JOIN dn USING (object_id)), dr AS (SELECT query_id, rank, source FROM r JOIN dn USING (object_id)),
 df AS (SELECT query_id, source, min(rank) AS rank FROM dr JOIN dg USING (query_id, source) GROUP BY ALL),
 dw AS (SELECT query_id, count(*) AS wanted FROM dg GROUP BY 1), dm AS (SELECT query_id, count(*) AS found FROM df GROUP BY 1), ds AS (SELECT query_id, count(DISTINCT source) AS n FROM dr GROUP BY 1)
SELECT case_id, applicable, CASE WHEN applicable THEN CAST(matched_count = relevant_count AS DOUBLE) END AS complete_chain,
 round(coalesce(found, 0) / wanted, 6) AS document_coverage, CASE WHEN applicable THEN CAST(coalesce(found, 0) = wanted AS DOUBLE) END AS all_documents_covered, coalesce(n, 0) AS distinct_source_count
FROM sc LEFT JOIN dw ON dw.query_id = case_id LEFT JOIN dm ON dm.query_id = case_id LEFT JOIN ds ON ds.query_id = case_id""")
def evidence_chain_coverage(t: Tables) -> DataFrame:
    """Passage-level and source-level coverage; a source may hold many passages."""
    ranked, truth = bm25_ranked(t), gold_identities(t)
    owner = t.documents.select(F.col("doc_id").cast("string").alias("identity"), "source")
    evidence = metrics.retrieval_scores(cases(t), ranked, truth, 8)
    ranked_sources = ranked.join(owner, "identity")
    document = metrics.retrieval_scores(
        cases(t),
        ranked_sources.select("case_id", "rank", F.col("source").alias("identity")),
        truth.join(owner, "identity").select("case_id", F.col("source").alias("identity")),
        8,
    )
    found = metrics.evidence_coverage(
        evidence, document, ranked_sources.select("case_id", F.col("source").alias("document_id"))
    )
    return rounded(found, "document_coverage")


MODE_SQL = f"""{bm25_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}), {scores_sql('a', 'r')}, {scores_sql('b', 'r', 3)},
 u AS (SELECT 'top8' AS mode, * FROM a UNION ALL SELECT 'top3', * FROM b),
 ty AS (SELECT *, CASE CAST(case_id AS INTEGER) % 3 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'summary_reasoning' ELSE 'multi_context' END AS question_type FROM u)"""


@query(f"""WITH {MODE_SQL} SELECT mode, question_type, CAST(grouping(question_type) AS TINYINT) AS is_total, count(*) AS case_count, count(*) FILTER (applicable) AS eligible_cases,
 round(avg(hit_at_k), 6) AS hit_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k
FROM ty GROUP BY GROUPING SETS ((mode), (mode, question_type))""".replace("CAST(grouping(question_type) AS TINYINT)", "CAST(grouping(question_type) AS INTEGER)"))
def question_type_report(t: Tables) -> DataFrame:
    """Two cut-offs as modes, in total and per question type, from one aggregation."""
    ranked, truth = bm25_ranked(t), gold_identities(t)
    both = metrics.retrieval_scores(cases(t), ranked, truth, 8).withColumn("mode", F.lit("top8")).unionByName(
        metrics.retrieval_scores(cases(t), ranked, truth, 3).withColumn("mode", F.lit("top3"))
    )
    number = F.col("case_id").cast("int") % 3
    typed = both.withColumn(
        "question_type",
        F.when(number == 0, "single_hop").when(number == 1, "summary_reasoning").otherwise("multi_context"),
    )
    found = metrics.by_question_type(typed).withColumn("is_total", F.col("is_total").cast("int"))
    return rounded(found, *metrics.METRICS)


CITED_SQL = f"""{bm25_sql()}, {GOLD_SQL}, r AS ({ranked_sql('bm25', 8)}),
ca AS (SELECT item_id, query_id AS case_id, item_id % 2 = 1 AS by_text FROM bn),
tx AS (SELECT DISTINCT ca.case_id, md5(b.x) AS context, b.x FROM ca JOIN bn b ON b.item_id - ca.item_id IN (0, 1, 2) AND length(b.x) > 0 WHERE by_text),
it AS (SELECT query_id AS case_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY r.rank % 3, r.rank DESC) AS rank FROM r WHERE CAST(object_id AS BIGINT) % 5 <> 0),
cd AS (SELECT it.case_id, it.rank, list(context ORDER BY tx.x) AS cs FROM it JOIN tx USING (case_id) JOIN dn USING (object_id)
 WHERE dn.x = tx.x OR (least(length(dn.x), length(tx.x)) >= 80 AND (contains(dn.x, tx.x) OR contains(tx.x, dn.x))) GROUP BY ALL),
li AS (SELECT it.case_id, it.rank, md5(dn.x) AS identity, coalesce(cs, []) AS cs FROM it JOIN ca USING (case_id) JOIN dn USING (object_id) LEFT JOIN cd ON cd.case_id = it.case_id AND cd.rank = it.rank WHERE by_text),
st(case_id, rank, seen, taken) AS (SELECT case_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM ca WHERE by_text
 UNION ALL SELECT case_id, rank, list_concat(seen, CASE WHEN t IS NULL THEN [identity] ELSE [identity, t] END), t
 FROM (SELECT li.case_id, li.rank, st.seen, li.identity, list_filter(li.cs, lambda c: NOT list_contains(st.seen, c))[1] AS t FROM st JOIN li ON li.case_id = st.case_id AND li.rank = st.rank + 1)),
fl AS (SELECT case_id, rank FROM st WHERE taken IS NOT NULL
 UNION ALL SELECT it.case_id, it.rank FROM it JOIN ca USING (case_id) JOIN gold ON gold.query_id = it.case_id AND gold.object_id = it.object_id WHERE NOT by_text),
ag AS (SELECT case_id, count(*) AS matched, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM fl GROUP BY 1),
wa AS (SELECT case_id, count(*) AS relevant FROM (SELECT case_id, context FROM tx UNION ALL SELECT case_id, object_id FROM ca JOIN gold ON query_id = case_id WHERE NOT by_text) GROUP BY 1),
re AS (SELECT case_id, count(*) AS n FROM it GROUP BY 1)
SELECT case_id, CASE WHEN by_text THEN 'normalized_context_overlap' ELSE 'evidence_id' END AS matching_method, coalesce(relevant, 0) > 0 AS applicable, coalesce(relevant, 0) AS relevant_count,
 coalesce(n, 0) AS retrieved_count, coalesce(matched, 0) AS matched_count, CASE WHEN relevant > 0 THEN CAST(best IS NOT NULL AS DOUBLE) END AS hit_at_k,
 CASE WHEN relevant > 0 THEN round(coalesce(matched, 0) / relevant, 6) END AS recall_at_k, CASE WHEN relevant > 0 THEN round(coalesce(1 / best, 0.0), 6) END AS mrr,
 CASE WHEN relevant > 0 THEN round(coalesce(dcg, 0.0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(relevant, greatest(coalesce(n, 0), 3)) + 1 AS BIGINT)) q(i)), 6) END AS ndcg_at_k
FROM ca LEFT JOIN wa USING (case_id) LEFT JOIN re USING (case_id) LEFT JOIN ag USING (case_id)"""


@query(f"WITH RECURSIVE {CITED_SQL}")
def cited_evidence_scores(t: Tables) -> DataFrame:
    """Cited evidence against gold ids for even passages, against reference texts for odd
    ones: the passage and its two neighbours. Of the eight best documents those whose id
    isn't divisible by five are cited, in an order of their own."""
    number = F.col("item_id")
    judged = t.benchmark.select(F.col("item_id").cast("string").alias("case_id"), (number % 2 == 1).alias("by_text"))
    texts = t.benchmark.select(F.explode(F.transform(F.array(number, number - 1, number - 2), lambda n: n.cast("string"))).alias("case_id"), "text")
    ranked = bm25_ranked(t).withColumn("citation_id", F.concat(F.lit("c"), "rank"))
    body = t.documents.select(F.col("doc_id").cast("string").alias("identity"), "text")
    evidence = ranked.join(body, "identity").select("case_id", "citation_id", "text", F.array("identity").alias("identities"))
    order = F.struct(F.col("rank") % 3, -F.col("rank"))
    cited = ranked.where(F.col("identity").cast("long") % 5 != 0).select("case_id", order.alias("position"), "citation_id")
    unknown = judged.select("case_id", F.struct(F.lit(0), F.lit(-99)).alias("position"), F.lit("c99").alias("citation_id"))
    items = citations.cited_items(evidence, cited.union(unknown))
    found = citations.evidence_scores(judged, items, gold_identities(t), texts.join(judged.where("by_text"), "case_id", "left_semi"), 3, whole=True)
    return rounded(found, "recall_at_k", "mrr", "ndcg_at_k")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 p AS (SELECT a.label, a.vec_id, max(greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e)))) AS best FROM v a LEFT JOIN v b ON a.label = b.label AND b.vec_id % 7 = 0 AND a.vec_id % 7 <> 0 WHERE a.vec_id % 7 <> 0 GROUP BY ALL),
 q AS (SELECT label, coalesce(best, -1.0) AS best FROM p)
SELECT label, count(*) AS reference_count, round(avg(best), 6) AS mean_max_similarity, round(avg(CAST(round(best, 12) >= 0.3 AS INTEGER)), 6) AS threshold_recall,
 CAST(min(CAST(round(best, 12) >= 0.3 AS INTEGER)) AS DOUBLE) AS all_references_covered FROM q GROUP BY label""")
def semantic_evidence_scores(t: Tables) -> DataFrame:
    """Labels as cases: every seventh vector counts as retrieved, the others as references."""
    picked = F.col("vec_id") % 7 == 0
    references = t.embeddings.where(~picked).select("label", F.col("vec_id").alias("reference_id"), "embedding")
    retrieved = t.embeddings.where(picked).select("label", "embedding")
    found = metrics.semantic_scores(references, retrieved, 0.3, keys=["label"])
    return rounded(found, "mean_max_similarity", "threshold_recall")


@query("""SELECT event_type, round(avg(value), 6) AS latency_mean, quantile_disc(value, 0.5) AS latency_p50, quantile_disc(value, 0.95) AS latency_p95 FROM events GROUP BY event_type""")
def latency_by_event(t: Tables) -> DataFrame:
    return rounded(metrics.latency_summary(t.events, "value", "event_type"), "latency_mean")


@query("""SELECT coalesce(lower(CAST(quality AS VARCHAR)), 'missing') AS value, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def review_value_counts(t: Tables) -> DataFrame:
    return metrics.value_counts(t.documents.join(t.labels, "doc_id", "left"), "quality", "lang")


@query("""WITH c AS (SELECT lang, quality = 1 AS a, toxic = 1 AS r FROM documents LEFT JOIN labels USING (doc_id)),
 n AS (SELECT lang, count(*) AS total_cases, count(*) FILTER (a IS NOT NULL AND r IS NOT NULL) AS eligible_cases, count(*) FILTER (a AND NOT r) AS tp, count(*) FILTER (NOT a AND NOT r) AS fp,
 count(*) FILTER (a AND r) AS fn, count(*) FILTER (NOT a AND r) AS tn FROM c GROUP BY lang)
SELECT *, round((tp + tn) / nullif(eligible_cases, 0), 6) AS refusal_accuracy, round(tp / nullif(tp + fp, 0), 6) AS answerability_precision, round(tp / nullif(tp + fn, 0), 6) AS answerability_recall,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS answerability_f1, round(fp / nullif(fp + tn, 0), 6) AS false_answer_rate, round(fn / nullif(tp + fn, 0), 6) AS false_refusal_rate,
 round(tn / nullif(fp + tn, 0), 6) AS unanswerable_refusal_rate FROM n""")
def answer_behavior(t: Tables) -> DataFrame:
    """Quality label as answerable, toxicity label as refusal, per language."""
    labelled = t.documents.join(t.labels, "doc_id", "left").select(
        "lang", (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("insufficient_evidence")
    )
    found = metrics.behavior_report(labelled, "lang")
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])


@query("""WITH c AS (SELECT source, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT source, count(*) AS eligible_cases, count(*) FILTER (doc_id % 4 <> 0) AS judged_cases, round(avg(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 10 / 10 END), 6) AS citation_correctness,
 round(avg(doc_id % 7 / 7), 6) AS citation_completeness, round(avg(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 / 3 END), 6) AS unsupported_claim_rate,
 string_agg(DISTINCT CASE WHEN n_chars > 1500 THEN 'evidence_id' ELSE 'normalized_context_overlap' END, ',' ORDER BY CASE WHEN n_chars > 1500 THEN 'evidence_id' ELSE 'normalized_context_overlap' END) AS matching_methods FROM c GROUP BY source""")
def citation_quality(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    judged = key % 4 != 0
    made = t.documents.join(t.labels, "doc_id").select(
        "source", (F.col("quality") == 1).alias("answerable"),
        F.when(judged, key % 10 / 10).alias("citation_correctness"),
        (key % 7 / 7).alias("reference_coverage"),
        F.when(judged, key % 3 / 3).alias("unsupported_claim_rate"),
        F.when(F.col("n_chars") > 1500, "evidence_id").otherwise("normalized_context_overlap").alias("matching_method"),
    )
    found = metrics.citation_report(made, "source")
    return rounded(found, "citation_correctness", "citation_completeness", "unsupported_claim_rate")


AGENT_SQL = """ev AS (SELECT user_id AS run_id, event_id AS position, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'view' THEN 'planner_action' WHEN 'purchase' THEN 'answer' ELSE 'tool_result' END AS event,
 CASE WHEN event_type = 'click' THEN 'search_chunks' WHEN event_type = 'error' AND value > 10 THEN 'read_evidence' END AS tool, value > 20 AS ok,
 CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS insufficient, user_id % 3 <> 0 AS answerable FROM events),
lastans AS (SELECT run_id, arg_max(k, position) AS k FROM ev WHERE event = 'answer' GROUP BY run_id),
rd AS (SELECT run_id, k + i AS chunk_id, (k + i) % 10 AS identity FROM lastans, range(5) r(i)),
ci AS (SELECT run_id, unnest([k, k + 1, k + 7]) AS chunk_id FROM lastans),
gd AS (SELECT DISTINCT run_id, unnest([run_id % 10, (run_id + 3) % 10]) AS identity FROM ev WHERE answerable)"""


def agent_tables(t: Tables):
    """Event log as agent runs: users are runs, purchases are answers."""
    kind = F.col("event_type")
    k = F.from_json("props", "k long", {"mode": "FAILFAST"})["k"]
    log = t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), k.alias("k"),
        F.when(kind == "signup", "run_started").when(kind == "view", "planner_action")
        .when(kind == "purchase", "answer").otherwise("tool_result").alias("event"),
        F.when(kind == "click", "search_chunks")
        .when((kind == "error") & (F.col("value") > 10), "read_evidence").alias("tool"),
        (F.col("value") > 20).alias("ok"), (k % 2 == 0).alias("insufficient"),
        (F.col("user_id") % 3 != 0).alias("answerable"),
    )
    last = log.where(F.col("event") == "answer").groupBy("run_id").agg(F.max_by("k", "position").alias("k"))
    chunk = last.select("run_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("k") + i)).alias("chunk_id"))
    read = chunk.withColumn("identity", F.col("chunk_id") % 10)
    cited = last.select("run_id", F.explode(F.array(F.col("k"), F.col("k") + 1, F.col("k") + 7)).alias("chunk_id"))
    gold_rows = log.where("answerable").select("run_id").distinct().select(
        "run_id", F.explode(F.array(F.col("run_id") % 10, (F.col("run_id") + 3) % 10)).alias("identity")
    )
    return log, read, cited, gold_rows


RUN_SCORES_SQL = f"""{AGENT_SQL}, base AS (SELECT run_id, count(*) FILTER (event = 'tool_result') AS tool_call_count, count(*) FILTER (event = 'tool_result' AND ok) AS successful_tool_calls,
 arg_max(insufficient, position) FILTER (event = 'answer') AS insufficient_evidence, bool_or(answerable) AS answerable FROM ev GROUP BY run_id),
 vc AS (SELECT DISTINCT ci.run_id, ci.chunk_id FROM ci JOIN rd USING (run_id, chunk_id)), cf AS (SELECT DISTINCT run_id, identity FROM rd JOIN vc USING (run_id, chunk_id)), fo AS (SELECT DISTINCT run_id, identity FROM rd),
 n AS (SELECT run_id, (SELECT count(DISTINCT chunk_id) FROM rd WHERE rd.run_id = b.run_id) AS reads, (SELECT count(DISTINCT chunk_id) FROM ci WHERE ci.run_id = b.run_id) AS cites, (SELECT count(*) FROM vc WHERE vc.run_id = b.run_id) AS valid,
  (SELECT count(*) FROM fo WHERE fo.run_id = b.run_id) AS found, (SELECT count(*) FROM cf WHERE cf.run_id = b.run_id) AS cfound, (SELECT count(*) FROM gd WHERE gd.run_id = b.run_id) AS wanted,
  (SELECT count(*) FROM fo JOIN gd USING (run_id, identity) WHERE fo.run_id = b.run_id) AS matched, (SELECT count(*) FROM cf JOIN gd USING (run_id, identity) WHERE cf.run_id = b.run_id) AS cmatched FROM base b),
 sc AS (SELECT run_id, tool_call_count, successful_tool_calls, reads AS read_evidence_count, cites AS cited_evidence_count, round(valid / nullif(reads, 0), 6) AS evidence_utilization, round(valid / nullif(cites, 0), 6) AS citation_validity,
  CASE WHEN wanted > 0 THEN round(coalesce(cmatched / nullif(cfound, 0), 0.0), 6) END AS citation_reference_precision, CASE WHEN wanted > 0 THEN round(coalesce(matched / nullif(found, 0), 0.0), 6) END AS reference_evidence_precision,
  CASE WHEN wanted > 0 THEN round(matched / wanted, 6) END AS reference_evidence_recall, insufficient_evidence, insufficient_evidence = (NOT answerable) AS refusal_correct FROM base JOIN n USING (run_id))"""


@query(f"WITH {RUN_SCORES_SQL} SELECT * FROM sc")
def agent_run_metrics(t: Tables) -> DataFrame:
    found = metrics.agent_run_scores(*agent_tables(t))
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])


@query(f"""WITH {RUN_SCORES_SQL} SELECT count(*) AS runs, round(avg(tool_call_count), 4) AS tool_call_count, round(avg(successful_tool_calls), 4) AS successful_tool_calls, round(avg(read_evidence_count), 4) AS read_evidence_count,
 round(avg(cited_evidence_count), 4) AS cited_evidence_count, round(avg(evidence_utilization), 4) AS evidence_utilization, round(avg(citation_validity), 4) AS citation_validity, round(avg(citation_reference_precision), 4) AS citation_reference_precision,
 round(avg(reference_evidence_precision), 4) AS reference_evidence_precision, round(avg(reference_evidence_recall), 4) AS reference_evidence_recall, round(avg(CAST(refusal_correct AS INTEGER)), 4) AS refusal_accuracy FROM sc""")
def agent_run_means(t: Tables) -> DataFrame:
    found = metrics.agent_means(metrics.agent_run_scores(*agent_tables(t)))
    return found.select("runs", *[F.round(c, 4).alias(c) for c in found.columns if c != "runs"])


@query(f"WITH {AGENT_SQL} SELECT run_id, tool, count(*) AS calls FROM ev WHERE event = 'tool_result' AND tool IS NOT NULL GROUP BY ALL")
def agent_tool_counts(t: Tables) -> DataFrame:
    return metrics.tool_counts(agent_tables(t)[0])


@query("""WITH c AS (SELECT event_id AS case_index, event_type AS question_type FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY case_index) AS place FROM c),
 q AS (SELECT *, CASE WHEN place > CASE question_type WHEN 'click' THEN 3 WHEN 'view' THEN 1 WHEN 'error' THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS late FROM p)
SELECT case_index, question_type FROM q ORDER BY late, case_index LIMIT 5""")
def smoke_case_sample(t: Tables) -> DataFrame:
    made = t.events.select(F.col("event_id").alias("case_index"), F.col("event_type").alias("question_type"))
    return metrics.smoke_sample(made, {"click": 3, "view": 1, "error": 1})


@query(f"""WITH {GOLD_SQL} SELECT CAST(d.doc_id AS VARCHAR) AS document_id, count(DISTINCT query_id) AS questions, count(query_id) AS contexts FROM documents d LEFT JOIN gold ON object_id = CAST(d.doc_id AS VARCHAR) GROUP BY 1""")
def question_coverage(t: Tables) -> DataFrame:
    links = gold(t).select(F.col("context_id").alias("case_id"), F.col("segment_id").alias("document_id"))
    return metrics.coverage_by_document(t.documents.select(F.col("doc_id").cast("string").alias("document_id")), links)


@query(f"""WITH a AS (SELECT item_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM benchmark), b AS (SELECT doc_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents),
 na AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1),
 s AS (SELECT item_id, doc_id, count(*) AS c FROM a JOIN b USING (term) GROUP BY ALL), j AS (SELECT item_id, doc_id, c / (na.n + nb.n - c) AS jaccard FROM s JOIN na USING (item_id) JOIN nb USING (doc_id))
SELECT item_id AS id, doc_id AS related_id, round(jaccard, 6) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 12) DESC, doc_id) = 1""")
def related_documents(t: Tables) -> DataFrame:
    """Most similar document per benchmark passage by Jaccard of terms."""
    def terms(df: DataFrame, key: str) -> DataFrame:
        listed = F.explode(F.array_distinct(lexical_tokens(F.col("text"))))
        return df.select(F.lit(0).alias("group_id"), F.col(key).alias("id"), listed.alias("term"))

    found = metrics.related_context(terms(t.benchmark, "item_id"), terms(t.documents, "doc_id"))
    return rounded(found.drop("group_id"), "jaccard")


@query("""WITH RECURSIVE c AS (SELECT source AS document_id, doc_id AS context_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
 n AS (SELECT document_id, count(*) AS n, row_number() OVER (ORDER BY document_id) - 1 AS turn FROM c GROUP BY 1), d AS (SELECT count(*) AS k FROM n),
 k AS (SELECT 0 AS number, 'single_hop' AS question_type, i AS off, 0 AS draw, i + 1 AS case_index FROM range(30) r(i) UNION ALL SELECT 1, 'summary_reasoning', i, w, 31 + i FROM range(10) r(i), range(2) s(w)
   UNION ALL SELECT 2, 'multi_context', i, 0, 41 + i FROM range(10) r(i) UNION ALL SELECT 3, 'unanswerable', i, 0, 51 + i FROM range(10) r(i)),
 p AS (SELECT k.*, n.document_id, (row_number() OVER (PARTITION BY document_id ORDER BY number, off, draw) - 1) % n AS place, o FROM k, d JOIN n ON true LEFT JOIN (SELECT turn AS t2, document_id AS o FROM n) z ON z.t2 = (k.off + 1) % d.k WHERE n.turn = k.off % d.k)
SELECT CAST(case_index AS INTEGER) AS case_index, question_type, CAST(draw AS INTEGER) AS draw, p.document_id, context_id, CASE WHEN question_type = 'multi_context' THEN o END AS other_document FROM p JOIN c ON c.document_id = p.document_id AND c.place = p.place""")
def case_plan(t: Tables) -> DataFrame:
    """Sixty planned cases over all sources, documents as their contexts."""
    from pyspark.sql import Window

    from seekspark.operators.planning import plan_contexts

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    contexts = t.documents.select(F.col("source").alias("document_id"), place.alias("place"), F.col("doc_id").alias("context_id"))
    return plan_contexts(contexts, 60)
