"""Row leases as a stateful stream: claims, expiry and reclaims of extraction jobs.

A log of jobs, attempts, outcomes and claims is keyed by job; the state of a job is what
the batch operators derive from the whole log (status, budgets used, running attempts,
lease). A claim gives a new attempt if the job is due and its budgets allow; an attempt
overtaken by a later one is interrupted; a lease that runs out is reported by a timer and
leaves the job to the next claim. Each batch reads and writes only the jobs it touches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seekspark.functions.ids import SEPARATOR
from seekspark.operators.jobs import STAGES

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = (
    "extraction_id string, at timestamp, kind string, status string, next_attempt_at timestamp, "
    "lease_expires_at timestamp, ordinal int, stage string, outcome string"
)
RESULT = (
    "attempt_id string, extraction_id string, ordinal int, stage string, outcome string, lease_expires_at timestamp"
)
# Order of rows of one instant: what a job is, what was tried, how it ended, who asks.
ORDER = {"job": 0, "attempt": 1, "outcome": 2, "claim": 3}
EMPTY = {"status": "pending", "next": None, "lease": None, "stages": {}, "last": 0, "running": {}}


@dataclass(frozen=True)
class LeaseRules:
    lease_seconds: int
    max_attempts: int
    max_stage_attempts: int

    def __post_init__(self) -> None:
        if self.lease_seconds <= 0 or self.max_attempts <= 0:
            raise ValueError("lease_seconds and max_attempts must be positive")
        if self.max_stage_attempts < 0:
            raise ValueError("max_stage_attempts must not be negative")


class JobLog:
    """Applies log rows to the state of one job and collects result rows; times are microseconds."""

    def __init__(self, key: str, state: dict, rules: LeaseRules) -> None:
        self.key, self.state, self.rules, self.rows = key, state, rules, []

    def _emit(self, ordinal: int, stage: str | None, outcome: str, lease: int | None) -> None:
        digest = hashlib.sha256(SEPARATOR.join((self.key, str(ordinal))).encode()).hexdigest()
        self.rows.append((f"xat_{digest[:20]}", self.key, ordinal, stage, outcome, lease))

    def _tried(self, ordinal: int, stage: str, outcome: str) -> None:
        s = self.state
        s["stages"][stage] = s["stages"].get(stage, 0) + 1
        if outcome == "running":
            s["running"][str(ordinal)] = stage
        s["last"] = max(s["last"], ordinal)
        for number in sorted(map(int, s["running"])):
            if number < s["last"]:
                self._emit(number, s["running"].pop(str(number)), "interrupted", None)

    def apply(self, row: dict) -> None:
        s, kind = self.state, row["kind"]
        if kind == "job":
            s.update(status=row["status"], next=row["next_attempt_at"], lease=row["lease_expires_at"])
        elif kind == "attempt":
            self._tried(int(row["ordinal"]), row["stage"], row["outcome"])
        elif kind == "outcome":
            s["running"].pop(str(int(row["ordinal"])), None)
            s.update(status=row["status"], next=row["next_attempt_at"], lease=None)
        elif kind == "claim":
            self._claim(row["stage"], row["at"])
        else:
            raise ValueError(f"unknown kind of log row: {kind}")

    def _claim(self, stage: str, now: int) -> None:
        if stage not in STAGES:
            raise ValueError(f"unsupported attempt stage: {stage}")
        s = self.state
        due = s["status"] == "pending" and (s["next"] is None or s["next"] <= now)
        late = s["status"] == "running" and s["lease"] is not None and s["lease"] <= now
        spent = sum(s["stages"].values())
        rules = self.rules
        if not (due or late) or spent >= rules.max_attempts or s["stages"].get(stage, 0) >= rules.max_stage_attempts:
            return
        s.update(status="running", lease=now + rules.lease_seconds * 1_000_000)
        self._emit(spent + 1, stage, "running", s["lease"])
        self._tried(spent + 1, stage, "running")

    def expire(self, now: int) -> None:
        """Report a lease that has run out; the job stays open to a claim."""
        s = self.state
        if s["status"] == "running" and s["lease"] is not None and s["lease"] <= now and s["running"]:
            self._emit(s["last"], s["running"].get(str(s["last"])), "lease_expired", s["lease"])


def _micros(value) -> int | None:
    return None if value is None or pd.isna(value) else pd.Timestamp(value).value // 1000


class LeaseProcessor(StatefulProcessor):
    """One JSON value of state per job, and a timer at the end of its lease."""

    def __init__(self, rules: LeaseRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "body string")

    def _load(self, key: str) -> JobLog:
        state = json.loads(self.held.get()[0]) if self.held.exists() else json.loads(json.dumps(EMPTY))
        return JobLog(key, state, self.rules)

    def _save(self, log: JobLog) -> Iterator[pd.DataFrame]:
        self.held.update((json.dumps(log.state),))
        if log.rows:
            frame = pd.DataFrame(log.rows, columns=["attempt_id", "extraction_id", "ordinal", "stage", "outcome", "lease_expires_at"])
            ends = [pd.NaT if r[-1] is None else pd.Timestamp(r[-1], unit="us") for r in log.rows]
            frame["lease_expires_at"] = pd.Series(ends, dtype="datetime64[us]")
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = self._load(key[0])
        found = [r for frame in rows for r in frame.to_dict("records")]
        times = ("at", "next_attempt_at", "lease_expires_at")
        found = [{**r, **{t: _micros(r[t]) for t in times}} for r in found]
        before = log.state["lease"]
        for row in sorted(found, key=lambda r: (r["at"], ORDER.get(r["kind"], 9), r["ordinal"] if r["ordinal"] == r["ordinal"] else 0)):
            log.apply(row)
        lease = log.state["lease"]
        if lease != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            if lease is not None:
                self.handle.registerTimer(lease // 1000)
        yield from self._save(log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        log = self._load(key[0])
        log.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999)
        yield from self._save(log)

    def close(self) -> None:
        pass


def leased_attempts(log: DataFrame, rules: LeaseRules) -> DataFrame:
    """New, interrupted and expired attempts of a streamed ``log`` with the columns of LOG.

    Timers run on the clock: a stream with no-data batches (the default) reports an expired
    lease without further input and therefore never ends by itself. The session needs a state store that keeps timers; ``use_state_store`` selects it.
    """
    return log.groupBy("extraction_id").transformWithStateInPandas(
        LeaseProcessor(rules), RESULT, "append", "ProcessingTime"
    )


def use_state_store(spark: SparkSession) -> None:
    """A state store with timers that commits changes, not whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
