"""Retrieval settings and modes."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from seekspark.functions.ids import canonical_json_hash
from seekspark.operators.lexical import check_parameters

MODES = ("dense", "bm25", "hybrid", "graph_local", "graph_global", "graph_hybrid", "mix")
COMPOSITE = {
    "graph_hybrid": ("graph_local", "graph_global"),
    "mix": ("hybrid", "graph_local", "graph_global"),
}


@dataclass(frozen=True)
class RetrievalOptions:
    """Settings of one retrieval. Names and defaults are fixed values: they are hashed into
    stored traces."""

    top_k: int = 8
    candidate_multiplier: int = 4
    context_token_budget: int = 2400
    graph_max_hops: int = 2
    hybrid_weight: float = 1.0
    graph_local_weight: float = 1.0
    graph_global_weight: float = 1.0
    hybrid_dense_weight: float = 1.0
    hybrid_bm25_weight: float = 1.0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rerank: bool = False
    rerank_candidate_multiplier: int = 4
    graph_path_weight: float = 0.25
    graph_path_candidate_multiplier: int = 2
    multi_context_weight: float = 0.5

    def __post_init__(self) -> None:
        for name in (
            "top_k", "candidate_multiplier", "context_token_budget",
            "rerank_candidate_multiplier", "graph_path_candidate_multiplier",
        ):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 1 <= self.graph_max_hops <= 4:
            raise ValueError("graph_max_hops must be between 1 and 4")
        weights = {k: v for k, v in asdict(self).items() if k.endswith("_weight")}
        for name, value in weights.items():
            if not math.isfinite(value) or value < 0.0:
                raise ValueError(f"{name} must be finite and not negative")
        for name in ("graph_path_weight", "multi_context_weight"):
            if weights[name] > 1.0:
                raise ValueError(f"{name} must not exceed 1")
        if not any(self.route_weights.values()):
            raise ValueError("at least one route weight must be positive")
        if self.hybrid_dense_weight + self.hybrid_bm25_weight <= 0.0:
            raise ValueError("at least one hybrid scorer weight must be positive")
        check_parameters(self.bm25_k1, self.bm25_b)

    @property
    def config_hash(self) -> str:
        return canonical_json_hash(asdict(self))

    @property
    def route_weights(self) -> dict[str, float]:
        return {
            "hybrid": self.hybrid_weight,
            "graph_local": self.graph_local_weight,
            "graph_global": self.graph_global_weight,
        }

    @property
    def rerank_limit(self) -> int:
        return self.top_k * self.rerank_candidate_multiplier

    @property
    def route_limit(self) -> int:
        wanted = self.rerank_limit if self.rerank else self.top_k
        return max(self.top_k * self.candidate_multiplier, wanted)

    @property
    def path_limit(self) -> int:
        return self.top_k * self.graph_path_candidate_multiplier


def active_routes(mode: str, options: RetrievalOptions) -> tuple[str, ...]:
    """Routes of a composite mode with a positive weight; empty for single modes."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    routes = tuple(r for r in COMPOSITE.get(mode, ()) if options.route_weights[r] > 0.0)
    if mode in COMPOSITE and not routes:
        raise ValueError(f"{mode} requires at least one positive route weight")
    return routes
