"""Streamed leases against the batch operators on the same log."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from seekspark.operators import jobs
from seekspark.streaming import leases

NOW = datetime.datetime(2024, 5, 1)
HOUR = datetime.timedelta(hours=1)


def _log(seed, count):
    draw = random.Random(seed)
    job_rows, attempt_rows = [], []
    for i in range(count):
        status = draw.choice(["pending", "running", "succeeded", "failed"])
        moment = lambda: draw.choice([None, NOW - HOUR, NOW, NOW + HOUR])
        job_rows.append((f"x{i}", status, moment(), moment()))
        for n in range(1, draw.randrange(1, 6)):
            attempt_rows.append((f"x{i}", n, draw.choice(["extract", "repair", "glean"]), draw.choice(["running", "succeeded"])))
    return job_rows, attempt_rows


def _rows(job_rows, attempt_rows, claims):
    early = NOW - 2 * HOUR
    out = [(k, early, "job", s, n, l, None, None, None) for k, s, n, l in job_rows]
    out += [(k, early, "attempt", None, None, None, n, stage, o) for k, n, stage, o in attempt_rows]
    return out + [(k, at, "claim", None, None, None, None, stage, None) for k, at, stage in claims]


def _write(spark, rows, folder, name):
    spark.createDataFrame(rows, leases.LOG).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _start(spark, folder, out, rules, tmp_path, **trigger):
    leases.use_state_store(spark)
    # Timers otherwise keep a stream going without input, and it never counts as finished.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(leases.LOG).option("recursiveFileLookup", True).parquet(folder)
    found = leases.leased_attempts(stream, rules)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(**trigger).start()


def test_stream_equals_claims_and_interruptions_of_the_batch(spark, tmp_path):
    job_rows, attempt_rows = _log(3, 60)
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    _write(spark, _rows(job_rows, attempt_rows, [(k, NOW, "repair") for k, *_ in job_rows]), folder, "one")
    _start(spark, folder, out, leases.LeaseRules(300, 4, 1), tmp_path, availableNow=True).awaitTermination()
    found = spark.read.schema(leases.RESULT).parquet(out)
    opened = spark.createDataFrame(job_rows, "extraction_id string, status string, next_attempt_at timestamp, lease_expires_at timestamp")
    tried = spark.createDataFrame(attempt_rows, "extraction_id string, ordinal int, stage string, outcome string")
    claimed = jobs.claim_jobs(opened, tried, "repair", F.lit(NOW), 300, 4, 1)
    columns = ["attempt_id", "extraction_id", "ordinal", "stage", "outcome", "lease_expires_at"]
    expected = sorted(tuple(r) for r in claimed.select(*columns).collect())
    assert expected and sorted(tuple(r) for r in found.where("outcome = 'running'").select(*columns).collect()) == expected
    # A claimed attempt overtakes the one that ran before it, too.
    log = tried.unionByName(claimed.select("extraction_id", F.col("ordinal").cast("int").alias("ordinal"), "stage", "outcome"))
    stopped = jobs.interrupted_attempts(log).select("extraction_id", "ordinal", "stage", "outcome")
    got = found.where("outcome = 'interrupted'").select("extraction_id", "ordinal", "stage", "outcome")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stopped.collect()))


def test_leases_run_out_and_jobs_are_claimed_again(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    now = datetime.datetime.now()
    jobs_now = [("a", "pending", None, None), ("b", "pending", None, None)]
    _write(spark, _rows(jobs_now, [], [("a", now, "extract"), ("b", now, "extract")]), folder, "one")
    stream = _start(spark, folder, out, leases.LeaseRules(3, 5, 5), tmp_path, processingTime="0 seconds")
    try:
        stream.processAllAvailable()
        _write(spark, [("b", now, "outcome", "succeeded", None, None, 1, None, "succeeded")], folder, "two")
        stream.processAllAvailable()
        time.sleep(4)
        _write(spark, _rows([("z", "pending", None, None)], [], []), folder, "other")
        stream.processAllAvailable()
        _write(spark, [(k, datetime.datetime.now(), "claim", None, None, None, None, "extract", None) for k in "ab"], folder, "three")
        stream.processAllAvailable()
    finally:
        stream.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    rows = spark.read.schema(leases.RESULT).parquet(out).collect()
    found = sorted((r["extraction_id"], r["ordinal"], r["outcome"]) for r in rows)
    assert found == [("a", 1, "interrupted"), ("a", 1, "lease_expired"), ("a", 1, "running"), ("a", 2, "running"), ("b", 1, "running")]


def test_bad_rules_and_rows_are_errors():
    with pytest.raises(ValueError):
        leases.LeaseRules(0, 1, 1)
    log = leases.JobLog("k", dict(leases.EMPTY), leases.LeaseRules(1, 1, 1))
    with pytest.raises(ValueError, match="unknown kind"):
        log.apply({"kind": "other"})
    with pytest.raises(ValueError, match="unsupported"):
        log.apply({"kind": "claim", "stage": "x", "at": 0.0})
