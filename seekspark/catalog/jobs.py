"""Job bookkeeping and cost queries on stand-ins: orders are extraction jobs, line
items are attempts, customers are chunks and nations their documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.registry import Tables, query
from seekspark.functions.ids import stable_id
from seekspark.operators import costs
from seekspark.operators import jobs as ops

NOW = datetime(1997, 1, 1)
NOW_SQL = "TIMESTAMP '1997-01-01'"

JOBS_SQL = """
extractions AS (SELECT o_orderkey AS extraction_id, o_custkey AS chunk_id,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 400000 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'succeeded'
       WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS next_attempt_at,
  o_orderdate + INTERVAL 300 SECOND AS lease_expires_at FROM orders),
items AS (SELECT o_orderpriority AS run_id, o_orderkey AS extraction_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'cached' ELSE 'scheduled' END AS disposition,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'not_required' END AS review_status FROM orders),
attempts AS (SELECT l_orderkey AS extraction_id, l_linenumber AS ordinal,
  CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE o_orderpriority END AS run_id,
  CASE l_returnflag WHEN 'A' THEN 'extract' WHEN 'N' THEN 'repair' ELSE 'glean' END AS stage,
  CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'invalid_json' END AS outcome,
  CAST(l_quantity AS BIGINT) * 10 AS prompt_tokens, CAST(l_quantity AS BIGINT) AS completion_tokens
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
chunks AS (SELECT c_custkey AS chunk_id, c_nationkey AS document_id,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'references' ELSE 'normal' END AS quality_class FROM customer),
eligible AS (SELECT * FROM extractions WHERE (status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {now}))
  OR (status = 'running' AND lease_expires_at <= {now}))
""".format(now=NOW_SQL)


def extractions(t: Tables) -> DataFrame:
    finished = F.col("o_orderstatus") == "F"
    return t.orders.select(
        F.col("o_orderkey").alias("extraction_id"),
        F.col("o_custkey").alias("chunk_id"),
        F.when(finished & (F.col("o_totalprice") >= 400000), "failed")
        .when(finished, "succeeded")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("running")
        .alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("next_attempt_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 300 SECONDS")).alias("lease_expires_at"),
    )


def items(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_orderpriority").alias("run_id"),
        key.alias("extraction_id"),
        F.when(key % 5 == 0, "cached").otherwise("scheduled").alias("disposition"),
        F.when(key % 4 == 0, "pending")
        .when(key % 4 == 1, "approved")
        .when(key % 4 == 2, "rejected")
        .otherwise("not_required")
        .alias("review_status"),
    )


def attempts(t: Tables) -> DataFrame:
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    flag = F.col("l_returnflag")
    return t.lineitem.join(owner, "l_orderkey").select(
        F.col("l_orderkey").alias("extraction_id"),
        F.col("l_linenumber").alias("ordinal"),
        F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise(F.col("o_orderpriority")).alias("run_id"),
        F.when(flag == "A", "extract").when(flag == "N", "repair").otherwise("glean").alias("stage"),
        F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("invalid_json").alias("outcome"),
        (F.col("l_quantity").cast("long") * 10).alias("prompt_tokens"),
        F.col("l_quantity").cast("long").alias("completion_tokens"),
    )


def chunks(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("chunk_id"),
        F.col("c_nationkey").alias("document_id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "references").otherwise("normal").alias("quality_class"),
    )


@query(f"""WITH {JOBS_SQL} SELECT extraction_id, chunk_id, status FROM eligible""")
def eligible_jobs(t: Tables) -> DataFrame:
    due = extractions(t).where(ops.is_eligible(F.lit(NOW)))
    return due.select("extraction_id", "chunk_id", "status")


@query(f"""WITH {JOBS_SQL}, own AS (SELECT extraction_id, run_id, count(*) AS n FROM attempts GROUP BY ALL),
 tot AS (SELECT extraction_id, count(*) FILTER (stage = 'extract') AS a, count(*) FILTER (stage = 'repair') AS b,
   count(*) FILTER (stage = 'glean') AS c FROM attempts GROUP BY ALL)
SELECT e.extraction_id, e.chunk_id, document_id, i.run_id, status, coalesce(n, 0) AS run_attempt_count,
 coalesce(a, 0) AS extract_attempts, coalesce(b, 0) AS repair_attempts, coalesce(c, 0) AS glean_attempts
FROM eligible e JOIN items i USING (extraction_id) JOIN chunks k ON k.chunk_id = e.chunk_id
LEFT JOIN own ON own.extraction_id = e.extraction_id AND own.run_id = i.run_id
LEFT JOIN tot ON tot.extraction_id = e.extraction_id""")
def pending_job_list(t: Tables) -> DataFrame:
    found = ops.pending_jobs(extractions(t), items(t), chunks(t), attempts(t), NOW)
    return found.drop("next_attempt_at", "lease_expires_at")


@query(f"""WITH {JOBS_SQL} SELECT extraction_id, chunk_id, run_id, review_status FROM extractions JOIN items USING (extraction_id)
WHERE status = 'succeeded' AND review_status IN ('not_required', 'approved')""")
def accepted_extractions(t: Tables) -> DataFrame:
    found = ops.accepted_results(extractions(t), items(t))
    return found.select("extraction_id", "chunk_id", "run_id", "review_status")


RUN_SQL = f"""WITH {JOBS_SQL}, a AS (SELECT run_id, count(*) AS total_chunks, count(*) FILTER (disposition = 'cached') AS cached_chunks,
 count(*) FILTER (disposition = 'scheduled') AS scheduled_chunks,
 count(*) FILTER (status = 'succeeded' AND review_status IN ('not_required', 'approved')) AS succeeded_chunks,
 count(*) FILTER (status IN ('succeeded', 'needs_review') AND review_status = 'pending') AS needs_review_chunks,
 count(*) FILTER (status = 'failed' OR review_status = 'rejected') AS failed_chunks
 FROM items JOIN extractions USING (extraction_id) GROUP BY run_id),
b AS (SELECT run_id, count(*) AS attempt_count, count(*) FILTER (stage = 'extract') AS extract_count, count(*) FILTER (stage = 'repair') AS repair_count,
 count(*) FILTER (stage = 'glean') AS glean_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
 FROM attempts JOIN items USING (run_id, extraction_id) GROUP BY run_id)"""


@query(RUN_SQL + """ SELECT a.*, b.* EXCLUDE (run_id), CASE WHEN total_chunks > succeeded_chunks + needs_review_chunks + failed_chunks THEN 'running'
 WHEN needs_review_chunks > 0 THEN 'awaiting_review' WHEN failed_chunks > 0 AND succeeded_chunks > 0 THEN 'completed_with_failures'
 WHEN failed_chunks > 0 THEN 'failed' ELSE 'completed' END AS run_status FROM a JOIN b USING (run_id)""")
def run_counter_report(t: Tables) -> DataFrame:
    return ops.run_counters(extractions(t), items(t), attempts(t))


@query(f"""WITH {JOBS_SQL}, known AS (SELECT 'xtr_' || substr(sha256(CAST(o_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || 'cfg'), 1, 20) AS extraction_id,
 max(o_orderstatus) AS flag FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
k AS (SELECT extraction_id, CASE flag WHEN 'P' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'running' END AS s FROM known),
c AS (SELECT c_custkey AS chunk_id, 'xtr_' || substr(sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || 'cfg'), 1, 20) AS extraction_id FROM customer)
SELECT c.extraction_id, chunk_id, CASE WHEN s = 'succeeded' THEN 'cached' ELSE 'scheduled' END AS disposition,
 CASE WHEN coalesce(s, '') <> 'succeeded' THEN 'pending' ELSE 'not_required' END AS review_status,
 CASE WHEN s = 'failed' THEN 'pending' ELSE coalesce(s, 'pending') END AS status FROM c LEFT JOIN k USING (extraction_id)""")
def prepared_jobs(t: Tables) -> DataFrame:
    """Every customer as a chunk; its orders decide whether a result is already stored."""
    source = t.customer.select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("content_hash"))
    owner = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    prior = t.orders.join(owner, "o_custkey").groupBy("o_custkey", "c_name").agg(F.max("o_orderstatus").alias("flag"))
    known = prior.select(
        stable_id("xtr", F.col("o_custkey"), F.col("c_name"), F.lit("cfg")).alias("extraction_id"),
        F.when(F.col("flag") == "P", "succeeded").when(F.col("flag") == "O", "failed").otherwise("running").alias("status"),
    )
    return ops.prepare_jobs(source, known, "cfg", review_required=True)


@query(f"""WITH {JOBS_SQL}, spent AS (SELECT extraction_id, count(*) AS n, count(*) FILTER (stage = 'repair') AS r FROM attempts GROUP BY ALL)
SELECT 'xat_' || substr(sha256(CAST(e.extraction_id AS VARCHAR) || chr(31) || CAST(coalesce(n, 0) + 1 AS VARCHAR)), 1, 20) AS attempt_id,
 e.extraction_id, coalesce(n, 0) + 1 AS ordinal, 'repair' AS stage, 'running' AS outcome, TIMESTAMP '1997-01-01 00:05:00' AS lease_expires_at
FROM eligible e LEFT JOIN spent USING (extraction_id) WHERE coalesce(n, 0) < 6 AND coalesce(r, 0) < 2""")
def claimed_attempts(t: Tables) -> DataFrame:
    claimed = ops.claim_jobs(extractions(t), attempts(t), "repair", F.lit(NOW).cast("timestamp_ntz"), 300, 6, 2)
    return claimed


@query(f"""WITH {JOBS_SQL} SELECT e.extraction_id, e.chunk_id, 'failed' AS status FROM extractions e
 JOIN (SELECT extraction_id, count(*) AS n FROM attempts GROUP BY ALL HAVING count(*) >= 5) USING (extraction_id)
 WHERE status = 'pending' OR (status = 'running' AND lease_expires_at <= {NOW_SQL})""")
def exhausted_job_list(t: Tables) -> DataFrame:
    found = ops.exhausted_jobs(extractions(t), attempts(t), NOW, 5)
    return found.select("extraction_id", "chunk_id", "status")


@query(f"""WITH {JOBS_SQL} SELECT extraction_id, max(ordinal) AS ordinal, max((ordinal, stage, outcome))[2] AS stage, max((ordinal, stage, outcome))[3] AS outcome
 FROM attempts GROUP BY extraction_id""")
def attempt_states(t: Tables) -> DataFrame:
    """Current state per job from the append-only attempt log."""
    log = attempts(t).select("extraction_id", "ordinal", "stage", "outcome")
    return ops.latest_state(log, "extraction_id", ["ordinal", "stage", "outcome"])


@query(f"""WITH {JOBS_SQL}, r AS (SELECT *, CASE WHEN outcome = 'invalid_json' THEN 'running' ELSE outcome END AS o FROM attempts),
 m AS (SELECT extraction_id, max(ordinal) AS last FROM attempts GROUP BY ALL)
SELECT extraction_id, ordinal, stage, 'interrupted' AS outcome FROM r JOIN m USING (extraction_id) WHERE o = 'running' AND ordinal < last""")
def interrupted_attempt_rows(t: Tables) -> DataFrame:
    outcome = F.when(F.col("outcome") == "invalid_json", "running").otherwise(F.col("outcome"))
    log = attempts(t).withColumn("outcome", outcome)
    return ops.interrupted_attempts(log).select("extraction_id", "ordinal", "stage", "outcome")


@query(f"""WITH {JOBS_SQL}, d AS (SELECT o_orderpriority AS run_id, o_orderkey AS extraction_id,
 CASE WHEN o_totalprice > 250000 THEN 'reject' WHEN o_totalprice > 100000 THEN 'approve' END AS decision FROM orders)
SELECT run_id, extraction_id, disposition, CASE WHEN review_status = 'pending' AND decision = 'approve' THEN 'approved'
 WHEN review_status = 'pending' AND decision = 'reject' THEN 'rejected' ELSE review_status END AS review_status FROM items JOIN d USING (run_id, extraction_id)""")
def reviewed_items(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    decisions = t.orders.select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("extraction_id"),
        F.when(price > 250000, "reject").when(price > 100000, "approve").alias("decision"),
    )
    return ops.review_items(items(t), decisions)


@query(f"""WITH {JOBS_SQL} SELECT DISTINCT run_id, n_name AS document FROM items JOIN extractions USING (extraction_id) JOIN chunks USING (chunk_id) JOIN nation ON n_nationkey = document_id""")
def runs_by_document(t: Tables) -> DataFrame:
    """For every document the runs that would have to be invalidated with it."""
    names = t.nation.select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("document"))
    return (
        items(t).join(extractions(t), "extraction_id").join(chunks(t), "chunk_id")
        .join(F.broadcast(names), "document_id").select("run_id", "document").distinct()
    )


@query(f"""WITH {JOBS_SQL} SELECT DISTINCT run_id FROM items WHERE extraction_id IN (SELECT extraction_id FROM extractions WHERE chunk_id IN
 (SELECT chunk_id FROM chunks WHERE document_id IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')))""")
def runs_of_changed_documents(t: Tables) -> DataFrame:
    """Runs touched by the documents of one region: three semi joins."""
    asia = t.region.where(F.col("r_name") == "ASIA").select(F.col("r_regionkey").alias("n_regionkey"))
    changed = t.nation.join(asia, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("document_id"))
    return ops.runs_touched(items(t), extractions(t), chunks(t), changed)


@query(f"""WITH {JOBS_SQL}, last AS (SELECT extraction_id, max((ordinal, stage, outcome)) AS m FROM attempts GROUP BY ALL)
SELECT run_id, e.extraction_id, chunk_id, coalesce(m[1], 0) AS attempt, m[2] AS stage,
 CASE WHEN review_status = 'rejected' THEN 'review_rejected' ELSE coalesce(m[3], 'failed') END AS failure_kind
FROM extractions e JOIN items i ON i.extraction_id = e.extraction_id LEFT JOIN last ON last.extraction_id = e.extraction_id WHERE status = 'failed'""")
def build_failures(t: Tables) -> DataFrame:
    return ops.failures(extractions(t), items(t), attempts(t))


@query(f"""WITH {JOBS_SQL} SELECT extraction_id, ordinal, stage, outcome, CAST(prompt_tokens + completion_tokens AS BIGINT) AS total_tokens FROM attempts""")
def redacted_attempts(t: Tables) -> DataFrame:
    full = attempts(t).withColumn("messages", F.lit("prompt")).withColumn("raw_response", F.lit("response"))
    return ops.redact(full).select(
        "extraction_id", "ordinal", "stage", "outcome",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


USAGE_SQL = """u0 AS (SELECT l_suppkey AS run_key, CASE l_returnflag WHEN 'A' THEN 'extract' WHEN 'N' THEN 'repair' ELSE 'answer' END AS operation,
 CASE WHEN l_suppkey % 10 = 3 AND l_linestatus = 'F' THEN 'Other' WHEN l_linestatus = 'F' THEN 'Fast' ELSE 'Large' END AS model,
 1 AS calls, CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens, CASE WHEN l_suppkey % 10 <> 4 THEN CAST(l_quantity AS BIGINT) * l_linenumber END AS cache_hit_tokens,
 CASE WHEN l_suppkey % 10 <> 4 THEN CAST(l_quantity AS BIGINT) * 100 - CAST(l_quantity AS BIGINT) * l_linenumber END AS cache_miss_tokens, l_partkey AS completion_tokens FROM lineitem),
u1 AS (SELECT *, coalesce(cache_hit_tokens + cache_miss_tokens = prompt_tokens, false) AS complete FROM u0),
usage AS (SELECT run_key, operation, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
 CASE WHEN bool_and(complete) THEN CAST(sum(cache_hit_tokens) AS BIGINT) END AS cache_hit_tokens,
 CASE WHEN bool_and(complete) THEN CAST(sum(cache_miss_tokens) AS BIGINT) END AS cache_miss_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, bool_and(complete) AS cache_breakdown_complete FROM u1 GROUP BY ALL)"""


def usage_records(t: Tables) -> DataFrame:
    flag, quantity, supplier = F.col("l_returnflag"), F.col("l_quantity").cast("long"), F.col("l_suppkey")
    hits = quantity * F.col("l_linenumber")
    raw = t.lineitem.select(
        supplier.alias("run_key"),
        F.when(flag == "A", "extract").when(flag == "N", "repair").otherwise("answer").alias("operation"),
        F.when((supplier % 10 == 3) & (F.col("l_linestatus") == "F"), "Other")
        .when(F.col("l_linestatus") == "F", "Fast").otherwise("Large").alias("model"),
        F.lit(1).alias("calls"),
        (quantity * 100).alias("prompt_tokens"),
        F.when(supplier % 10 != 4, hits).alias("cache_hit_tokens"),
        F.when(supplier % 10 != 4, quantity * 100 - hits).alias("cache_miss_tokens"),
        F.col("l_partkey").alias("completion_tokens"),
    )
    return costs.with_breakdown(raw)


def price_table(t: Tables) -> DataFrame:
    return t.spark.sql(
        """SELECT model, CAST(h AS DECIMAL(12,6)) AS hit_price, CAST(m AS DECIMAL(12,6)) AS miss_price,
        CAST(o AS DECIMAL(12,6)) AS output_price
        FROM VALUES ('fast', 0.02, 1, 2), ('large', 0.025, 3, 6) AS p(model, h, m, o)"""
    )


@query(f"WITH {USAGE_SQL} SELECT * FROM usage")
def usage_rollup(t: Tables) -> DataFrame:
    return costs.usage_by_model(usage_records(t), "run_key")


@query(f"""WITH {USAGE_SQL}, p(model, h, m, o) AS (VALUES ('fast', 0.02, 1, 2), ('large', 0.025, 3, 6)),
j AS (SELECT *, o IS NOT NULL AND cache_breakdown_complete AS known FROM usage LEFT JOIN p ON p.model = lower(usage.model))
SELECT run_key, CASE WHEN bool_and(known) THEN round(sum(cache_hit_tokens * h + cache_miss_tokens * m + completion_tokens * o)::DOUBLE / 1e6, 6) END AS cost,
 CASE WHEN bool_and(known) THEN 'estimated' ELSE 'unknown' END AS status FROM j GROUP BY run_key""")
def cost_estimates(t: Tables) -> DataFrame:
    found = costs.estimate(usage_records(t), price_table(t), "run_key")
    return found.withColumn("cost", F.round("cost", 6))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (value < 0.1) = 0 THEN round(arg_max(value, event_id), 6) END AS cost,
 count(*) FILTER (value < 0.1) AS missing, count(*) AS observations FROM events GROUP BY user_id""")
def snapshot_costs(t: Tables) -> DataFrame:
    """Last cumulative cost per user; unknown when any observation has none."""
    seen = t.events.select("user_id", "event_id", F.when(F.col("value") >= 0.1, F.col("value")).alias("cost"))
    found = costs.latest_snapshot_cost(seen, "user_id", order="event_id")
    return found.withColumn("cost", F.round("cost", 6))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_returnflag WHEN 'A' THEN 'extract' WHEN 'N' THEN 'repair' ELSE 'glean' END AS stage, l_linestatus = 'F' AS validated,
 CASE WHEN l_linestatus <> 'F' AND l_suppkey % 4 = 0 THEN l_partkey % 2 = 0 END AS pr, l_suppkey % 4 = 1 AS repairable, l_suppkey % 4 = 2 AS rf,
 l_partkey % 3 AS repairs, l_partkey % 2 AS gleans, l_linenumber AS num FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN validated AND stage = 'glean' AND l_partkey % 5 = 0 THEN 'glean_regressed' WHEN validated THEN 'succeeded' WHEN pr THEN 'provider_retryable'
  WHEN NOT pr THEN 'provider_terminal' ELSE 'invalid_json' END AS outcome,
 CASE WHEN stage = 'glean' THEN 'complete' WHEN validated AND stage = 'extract' AND gleans < 1 AND repairs = 0 THEN 'glean' WHEN validated THEN 'complete'
  WHEN num >= 6 THEN 'fail' WHEN stage = 'repair' AND repairs >= 1 THEN 'fail' WHEN pr IS NOT NULL THEN CASE WHEN pr THEN 'retry' ELSE 'fail' END
  WHEN repairable AND repairs >= 1 THEN 'fail' WHEN repairable OR rf THEN 'retry' ELSE 'fail' END AS next_step FROM a""")
def attempt_routing(t: Tables) -> DataFrame:
    """Outcome label and next step of every attempt."""
    flag, supplier, part = F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_partkey")
    validated = F.col("l_linestatus") == "F"
    made = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(flag == "A", "extract").when(flag == "N", "repair").otherwise("glean").alias("stage"),
        validated.alias("validated"),
        F.when(~validated & (supplier % 4 == 0), part % 2 == 0).alias("provider_retryable"),
        (supplier % 4 == 1).alias("repairable"), (supplier % 4 == 2).alias("retryable_finish"),
        (part % 3).alias("repair_attempts"), (part % 2).alias("glean_attempts"),
        F.col("l_linenumber").alias("run_attempt_number"), F.lit(6).alias("max_attempts"),
        F.lit(1).alias("max_glean_attempts"), F.lit(True).alias("has_baseline"),
        (part % 5 != 0).alias("covers_baseline"), F.lit("invalid_json").alias("validation_kind"),
    )
    return made.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ops.attempt_outcome().alias("outcome"), ops.next_step().alias("next_step"),
    )
