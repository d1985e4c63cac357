"""Stored retrieval traces and their exact replay."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.plans.retrieval import Retrieval


class TraceStore:
    """Appends result tables under a shared root; a replay only reads them back."""

    TABLES = ("hits", "context", "routes", "paths", "rerank", "answers")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(
        self, retrieval: Retrieval, profile_id: str, index_config_hash: str, expected_hash: str,
        answers: DataFrame | None = None,
    ) -> str:
        """Store one batch of questions; the trace must belong to the given profile."""
        if index_config_hash != expected_hash:
            raise ValueError("trace configuration differs from its index profile")
        trace_id = "rtr_" + uuid.uuid4().hex[:20]
        tables = {
            "hits": retrieval.hits, "context": retrieval.context, "routes": retrieval.routes,
            "paths": retrieval.paths, "rerank": retrieval.rerank, "answers": answers,
        }
        for name, df in tables.items():
            if df is not None:
                df.write.parquet(f"{self.root}/{name}/trace_id={trace_id}")
        settings = json.dumps(
            {"mode": retrieval.mode, "profile_id": profile_id, **asdict(retrieval.options)}, sort_keys=True
        )
        head = retrieval.questions.select("query_id", "question").withColumns(
            {
                "settings": F.lit(settings), "mode": F.lit(retrieval.mode),
                "options_hash": F.lit(retrieval.options.config_hash), "created_at": F.current_timestamp(),
            }
        )
        head.write.parquet(f"{self.root}/head/trace_id={trace_id}")
        return trace_id

    def replay(self, trace_id: str, table: str = "hits") -> DataFrame:
        if table not in (*self.TABLES, "head"):
            raise ValueError(f"unknown trace table: {table}")
        path = f"{self.root}/{table}/trace_id={trace_id}"
        try:
            return self.spark.read.parquet(path)
        except Exception as error:
            raise ValueError(f"retrieval trace not found: {trace_id}") from error
