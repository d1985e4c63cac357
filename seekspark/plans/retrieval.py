"""Retrieval as one plan over many questions: routes, fusion, selection, context."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.text import (
    clean_keywords, clip_to_budget, comparison_subqueries, expanded_query, whitespace_tokens,
)
from seekspark.functions.vectors import embed_column, sigmoid
from seekspark.operators.blockmax import search
from seekspark.operators.dense import collect_queries, dense_top_k
from seekspark.operators.fusion import (
    PATH_DEPTH, SCORE_DIGITS, budget_fold, document_anchors, inject_paths, min_max, top_k,
    top_k_with_anchors, weighted_average_fusion,
)
from seekspark.operators.graph import adjacency, shortest_paths
from seekspark.operators.lexical import bm25_top_k
from seekspark.operators.linked import linked_scores
from seekspark.plans.indexing import Index
from seekspark.plans.options import RetrievalOptions, active_routes
from seekspark.scale import computed_once, cut_lineage, small_side

RELATION_DECAY = 0.9
PATH_ENDPOINTS = 6
SEPARATOR = "\x1f"


class Reranker(Protocol):
    """Scores (question, passage) pairs inside tasks; raw scores pass a logistic."""

    provider: str
    model: str

    def score(self, questions: Sequence[str], passages: Sequence[str]) -> list[float]: ...


@dataclass
class Route:
    """Score tables of one route: chunks, entities, relations as query_id, object_id, score.

    ``linked`` are the objects, with their kind, whose links gave the chunks of a graph route.
    """

    chunks: DataFrame
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    details: DataFrame | None = None
    linked: DataFrame | None = None


@dataclass
class Retrieval:
    """Result tables, all keyed by ``query_id``; a trace is these tables stored."""

    mode: str
    options: RetrievalOptions
    questions: DataFrame
    hits: DataFrame
    context: DataFrame
    routes: DataFrame
    paths: DataFrame | None = None
    rerank: DataFrame | None = None
    anchors: DataFrame | None = None


def prepare_questions(questions: DataFrame) -> DataFrame:
    """Trim, reject blank questions, and append the keyword line for the scorers."""
    none = F.array().cast("array<string>")
    keywords = (
        clean_keywords(F.coalesce("keywords", none)) if "keywords" in questions.columns else none
    )
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    checked = F.when(F.length(text) > 0, text).otherwise(
        F.raise_error(F.lit("question must not be blank"))
    )
    # Computed once: an embedder's input must not be an expression of this size.
    named = questions.select(F.col("query_id").cast("string").alias("query_id"), "text", keywords.alias("words"))
    return computed_once(named, question=checked, expanded=expanded_query(text, F.col("words"))).select(
        "query_id", "question", F.col("expanded").alias("text")
    )


class _Asked:
    """Expanded questions with their vectors, collected at most once per batch, and their
    best BM25 scores, counted once whatever modes ask for them."""

    def __init__(self, index: Index, texts: DataFrame) -> None:
        self.index, self.texts = index, texts.select("query_id", "text")
        self._vectors = self._collected = None
        self._lexical: dict[tuple, DataFrame] = {}

    def lexical(self, k: int, k1: float, b: float) -> DataFrame:
        index = self.index
        if (k, k1, b) not in self._lexical:
            if index.lexical is not None:
                found = search(index.lexical, self.texts, k, k1, b).hits
            else:
                corpus = index.chunks.select("object_id", F.col("embedding_text").alias("text"))
                found = bm25_top_k(corpus, self.texts, k, k1, b, blocks=True)
            self._lexical[k, k1, b] = cut_lineage(found.select("query_id", "object_id", "score"))
        return self._lexical[k, k1, b]

    def top(self, vectors: DataFrame, k: int) -> DataFrame:
        embedder = self.index.embedder
        if self._vectors is None:
            self._vectors = self.texts.select(
                "query_id", embed_column(embedder, F.col("text")).alias("embedding")
            )
            self._collected = collect_queries(self._vectors, embedder.dimensions)
        return dense_top_k(vectors, self._vectors, k, embedder.dimensions, self._collected)


def chunk_route(asked: _Asked, mode: str, options: RetrievalOptions) -> Route:
    """Dense, BM25 or both; each scorer is cut to the route limit before normalizing."""
    weights = {
        "dense": {"dense": 1.0},
        "bm25": {"bm25": 1.0},
        "hybrid": {"dense": options.hybrid_dense_weight, "bm25": options.hybrid_bm25_weight},
    }[mode]
    index, limit, parts = asked.index, options.route_limit, []
    columns = ["query_id", "object_id", "score"]
    if weights.get("dense", 0.0) > 0.0:
        parts.append(asked.top(index.chunks, limit).select(*columns, F.lit("dense").alias("scorer")))
    if weights.get("bm25", 0.0) > 0.0:
        lexical = asked.lexical(limit, options.bm25_k1, options.bm25_b)
        parts.append(lexical.select(*columns, F.lit("bm25").alias("scorer")))
    # At most 2 x limit rows per question: stored once, then read by every later step.
    scores = cut_lineage(_union(parts))
    fused = weighted_average_fusion(scores, weights)
    return Route(chunks=fused.select(*columns), details=fused)


def _linked(scored: DataFrame, index: Index) -> DataFrame:
    """Best score of every chunk behind ``query_id, kind, object_id, score``."""
    links = index.links.select("kind", "object_id", "chunk_id")
    return _best(links.join(small_side(scored), ["kind", "object_id"]).select(
        "query_id", F.col("chunk_id").alias("object_id"), "score"
    ))


def _of_kind(scored: DataFrame, kind: str) -> DataFrame:
    return scored.select("query_id", F.lit(kind).alias("kind"), "object_id", "score")


def _best(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "object_id").agg(F.max("score").alias("score"))


def _relation_ends(index: Index) -> DataFrame:
    return index.relations.select(
        F.col("object_id").alias("relation_id"), "source_entity_id", "target_entity_id"
    )


def local_route(asked: _Asked, options: RetrievalOptions) -> Route:
    """Top entities, their chunks, and at 0.9 of the score their relations' chunks."""
    index = asked.index
    top = asked.top(index.entities, options.route_limit)
    entities = cut_lineage(top.select("query_id", "object_id", "score"))
    around = adjacency(_relation_ends(index)).join(
        small_side(entities.withColumnRenamed("object_id", "entity_id")), "entity_id"
    )
    relations = _best(
        around.select(
            "query_id", F.col("relation_id").alias("object_id"), (F.col("score") * RELATION_DECAY).alias("score")
        )
    )
    linked = _of_kind(entities, "entity").unionByName(_of_kind(relations, "relation"))
    return Route(chunks=_linked(linked, index), entities=entities, relations=relations, linked=linked)


def global_route(asked: _Asked, options: RetrievalOptions) -> Route:
    """Top relations, their chunks, and their end points with the best score."""
    index = asked.index
    top = asked.top(index.relations, options.route_limit)
    relations = cut_lineage(top.select("query_id", "object_id", "score"))
    ends = adjacency(_relation_ends(index)).join(
        small_side(relations.withColumnRenamed("object_id", "relation_id")), "relation_id"
    )
    entities = _best(ends.select("query_id", F.col("entity_id").alias("object_id"), "score"))
    linked = _of_kind(relations, "relation")
    return Route(chunks=_linked(linked, index), entities=entities, relations=relations, linked=linked)


def run_route(asked: _Asked, route: str, options: RetrievalOptions) -> Route:
    if route == "graph_local":
        return local_route(asked, options)
    if route == "graph_global":
        return global_route(asked, options)
    return chunk_route(asked, route, options)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def graph_paths(index: Index, routes: dict[str, Route], options: RetrievalOptions) -> DataFrame:
    """Shortest paths between the six best entities of each question.

    Six entities give at most fifteen pairs per question; searches are shared between
    questions because they run on the distinct pairs.
    """
    scores = _best(_union([r.entities for r in routes.values() if r.entities is not None]))
    chosen = top_k(scores, PATH_ENDPOINTS, ["query_id"]).select("query_id", "object_id", "score", "rank")
    left = chosen.select("query_id", F.col("object_id").alias("source"), F.col("score").alias("s1"), F.col("rank").alias("r1"))
    right = chosen.select("query_id", F.col("object_id").alias("target"), F.col("score").alias("s2"), F.col("rank").alias("r2"))
    pairs = left.join(right, "query_id").where("r1 < r2").select(
        "query_id", "source", "target", F.least("s1", "s2").alias("score")
    )
    pairs = cut_lineage(pairs)
    found = cut_lineage(shortest_paths(pairs, _relation_ends(index), options.graph_max_hops))
    best = pairs.join(small_side(found), ["source", "target"]).groupBy("query_id", "relation_ids").agg(
        F.max_by(F.struct("node_ids", "score"), F.round("score", SCORE_DIGITS)).alias("best")
    )
    return best.select("query_id", "relation_ids", "best.node_ids", "best.score")


def path_scores(index: Index, paths: DataFrame, options: RetrievalOptions) -> DataFrame:
    """Chunks of the paths of two or more steps. ``inject_paths`` reads the first chunks of a
    path, so only that many of each relation are joined with the questions' paths."""
    steps = paths.where(F.size("relation_ids") >= 2).select(
        "query_id", "relation_ids", F.explode("relation_ids").alias("object_id")
    )
    links = index.links.where(F.col("kind") == "relation").join(
        small_side(steps.select("object_id").distinct()), "object_id", "left_semi"
    ).select("object_id", "chunk_id").distinct()
    valid = links.join(index.chunks.select(F.col("object_id").alias("chunk_id")), "chunk_id", "left_semi")
    order = Window.partitionBy("object_id").orderBy("chunk_id")
    first = valid.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PATH_DEPTH * options.path_limit)
    chunks = cut_lineage(first).join(small_side(steps), "object_id").select(
        "query_id", "relation_ids", F.col("chunk_id").alias("object_id")
    ).distinct()
    return inject_paths(paths, chunks, options.path_limit)


def subquestions(questions: DataFrame) -> DataFrame:
    """``query_id, part, parts, text`` of the sub-questions of explicit comparisons."""
    return questions.select("query_id", comparison_subqueries(F.col("question")).alias("subs")).select(
        "query_id", F.size("subs").alias("parts"), F.posexplode("subs").alias("part", "text")
    )


def _with_subquestions(index: Index, ready: DataFrame, options: RetrievalOptions) -> tuple[Route, DataFrame | None]:
    """The hybrid route of the questions and the scores of their sub-questions, asked in one
    pass over the chunks; the latter as ``subquestion_route`` gives them."""
    parts = cut_lineage(subquestions(ready))
    if parts.isEmpty():
        return chunk_route(_Asked(index, ready), "hybrid", options), None
    named = parts.withColumn("asked_id", F.concat(F.lit("sub" + SEPARATOR), F.col("part").cast("string"), F.lit(SEPARATOR), "query_id"))
    both = ready.select(F.concat(F.lit("own" + SEPARATOR), "query_id").alias("query_id"), "text").unionByName(
        named.select(F.col("asked_id").alias("query_id"), "text")
    )
    scores = chunk_route(_Asked(index, both), "hybrid", options).details
    own = scores.where(F.col("query_id").startswith("own"))
    own = own.withColumn("query_id", F.substr("query_id", F.lit(len("own" + SEPARATOR) + 1)))
    names = named.select("asked_id", F.col("query_id").alias("parent"), "part", "parts")
    found = scores.join(small_side(names), F.col("query_id") == F.col("asked_id")).select(
        F.col("parent").alias("query_id"), "part", "parts", "object_id", "score"
    )
    return Route(chunks=own.select("query_id", "object_id", "score"), details=own), cut_lineage(found)


def subquestion_route(
    index: Index, questions: DataFrame, options: RetrievalOptions
) -> DataFrame | None:
    """Hybrid scores of the sub-questions of explicit comparisons, None without any.

    Output ``query_id, part, parts, object_id, score``.
    """
    parts = subquestions(questions)
    keyed = parts.withColumn("parent", F.col("query_id")).withColumn(
        "query_id", F.concat_ws(SEPARATOR, "query_id", F.col("part").cast("string"))
    )
    if keyed.isEmpty():
        return None
    route = chunk_route(_Asked(index, keyed), "hybrid", options)
    names = keyed.select("query_id", "parent", "part", "parts")
    found = route.chunks.join(small_side(names), "query_id").select(
        F.col("parent").alias("query_id"), "part", "parts", "object_id", "score"
    )
    return cut_lineage(found)


def fuse(
    routes: dict[str, Route], weights: dict[str, float], paths: DataFrame | None,
    subs: DataFrame | None, options: RetrievalOptions, index: Index | None = None, limit: int = 0,
) -> DataFrame:
    """``query_id, object_id, score, raw_score`` and one column per signal, all added.

    Every signal is a long table; one hash aggregate per (question, chunk) adds them, so
    no wide outer join is needed and nothing is collected per chunk.

    Graph routes score every chunk that an object of a question links to. With ``index``
    only chunks are returned that can be among the ``limit`` best, or that another signal
    scores: no signal is negative, so any other chunk stays behind ``limit`` chunks that
    the graph routes alone place before it. Their scores are the same as among all chunks.
    """
    frames = []
    key = ["query_id", "component"]

    def add(scores: DataFrame, component: Column, weight: Column | float, bounds: DataFrame | None = None) -> None:
        scaled = min_max(scores.withColumn("component", component), key, bounds=bounds)
        value = (F.col("normalized") * weight).alias("value")
        frames.append(scaled.select("query_id", "object_id", "component", value, F.col("score").alias("raw")))

    names = list(routes)
    wide = {name: route.linked for name, route in routes.items() if route.linked is not None}
    found = linked_scores(index.links, wide) if index is not None and wide else None
    if found is not None:
        few = [r.chunks for name, r in routes.items() if name not in wide] + [df for df in (paths, subs) if df is not None]
        kept = [df.select("query_id", "object_id") for df in (*few, found.best(weights, limit))]
        of_graph = cut_lineage(found.of(cut_lineage(_union(kept).distinct())))
    for name, route in routes.items():
        if found is not None and name in wide:
            add(of_graph.where(F.col("component") == name).drop("component"), F.lit(name), weights[name], found.bounds)
        else:
            add(route.chunks.select("query_id", "object_id", "score"), F.lit(name), weights[name])
    if paths is not None:
        names.append("graph_path")
        add(paths, F.lit("graph_path"), options.graph_path_weight)
    if subs is not None:
        names += [f"multi_context_{i}" for i in (1, 2, 3)]
        label = F.concat(F.lit("multi_context_"), (F.col("part") + 1).cast("string"))
        add(subs, label, options.multi_context_weight / F.col("parts"))
    return _union(frames).groupBy("query_id", "object_id").agg(
        F.sum("value").alias("score"),
        F.max("raw").alias("raw_score"),
        *[F.max(F.when(F.col("component") == n, F.col("value"))).alias(f"part_{n}") for n in names],
    )


def component_map(scored: DataFrame) -> DataFrame:
    """Replace the signal columns of the few selected rows by one map of present signals."""
    parts = [c for c in scored.columns if c.startswith("part_")]
    entries = F.array(
        *[F.struct(F.lit(c.removeprefix("part_")).alias("key"), F.col(c).alias("value")) for c in parts]
    )
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return scored.withColumn("components", F.map_from_entries(present)).drop(*parts)


def route_trace(routes: dict[str, Route]) -> DataFrame:
    """All scored objects of all routes in trace order columns."""
    frames = []
    for name, route in routes.items():
        for kind, scores in (("chunk", route.chunks), ("entity", route.entities), ("relation", route.relations)):
            if scores is not None:
                frames.append(scores.select("query_id", F.lit(name).alias("route"), F.lit(kind).alias("kind"), "object_id", "score"))
    return _union(frames)


def sort_trace(trace: DataFrame) -> DataFrame:
    return trace.orderBy("query_id", "route", F.round("score", SCORE_DIGITS).desc(), "kind", "object_id")


def apply_reranker(
    candidates: DataFrame, questions: DataFrame, index: Index, reranker: Reranker
) -> DataFrame:
    """Score every candidate once; order by score, earlier score, id."""
    texts = index.chunks.select("object_id", "embedding_text")
    pairs = texts.join(small_side(candidates), "object_id").join(
        small_side(questions.select("query_id", "question")), "query_id"
    )

    @F.pandas_udf(T.DoubleType())
    def run(asked: pd.Series, passages: pd.Series) -> pd.Series:
        scores = reranker.score(asked.tolist(), passages.tolist())
        if len(scores) != len(passages):
            raise ValueError("reranker must return one score for every candidate")
        return pd.Series(scores, dtype="float64")

    scored = pairs.withColumn("raw", run.asNondeterministic()(F.col("question"), F.col("embedding_text")))
    return scored.select(
        "query_id", "object_id", F.col("rank").alias("pre_rank"), F.col("score").alias("prior_score"),
        "raw_score", "components", sigmoid(F.col("raw")).alias("score"),
    )


def page_label(start: Column, end: Column) -> Column:
    one, two = start.cast("string"), end.cast("string")
    return (
        F.when(start.isNull(), F.lit("n/a"))
        .when(end.isNull() | (start == end), one)
        .otherwise(F.concat(one, F.lit("-"), two))
    )


def render(citation: Column, title: Column, section_path: Column, start: Column, end: Column, text: Column) -> Column:
    label = F.array_join(section_path, " > ")
    section = F.when(F.length(label) > 0, label).otherwise(F.lit("(untitled)"))
    return F.concat(
        F.lit("[citation="), citation, F.lit("; document="), title, F.lit("; section="), section,
        F.lit("; pages="), page_label(start, end), F.lit("]\n"), text,
    )


def assemble_context(hits: DataFrame, anchors: DataFrame | None, index: Index, options: RetrievalOptions) -> DataFrame:
    """Evidence within the token budget: anchors first, then score order.

    If nothing fits, the first passage is clipped. One array per question holds at
    most top_k plus anchors items, texts included.
    """
    body = index.chunks.select(
        "object_id", "document_id", "document_title", "section_path", "page_start", "page_end", "text"
    )
    picked = body.join(small_side(hits.select("query_id", "object_id", "rank", "score")), "object_id")
    if anchors is not None:
        picked = picked.join(small_side(anchors), ["query_id", "object_id"], "left")
    else:
        picked = picked.withColumn("anchor_rank", F.lit(None).cast("int"))
    args = [F.col(c) for c in ("object_id", "document_title", "section_path", "page_start", "page_end")]
    sized = picked.withColumn("tokens", whitespace_tokens(render(*args, F.col("text"))).cast("long")).withColumn(
        "header", whitespace_tokens(render(*args, F.lit(""))).cast("long")
    )
    place = F.coalesce(F.col("anchor_rank"), F.lit(1 << 20) + F.col("rank"))
    packed = sized.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    place.alias("place"), "object_id", "tokens", "header", "rank", "score", "document_id",
                    "document_title", "section_path", "page_start", "page_end", "text",
                )
            )
        ).alias("items")
    )
    kept = packed.select(
        "query_id", budget_fold(F.col("items"), "tokens", options.context_token_budget).alias("kept"),
        F.get("items", F.lit(0)).alias("first"),
    )
    room = F.lit(options.context_token_budget) - F.col("first.header")
    clip = F.when(room > 0, clip_to_budget(F.col("first.text"), room)).otherwise(F.lit(""))
    clipped = F.col("first").withField("text", clip)
    chosen = (
        F.when(F.size("kept") > 0, F.col("kept"))
        .when(F.length(clip) > 0, F.array(clipped))
        .otherwise(F.slice("kept", 1, 0))
    )
    rows = kept.select("query_id", F.posexplode(chosen).alias("at", "item")).select(
        "query_id", (F.col("at") + 1).alias("position"), "item.*"
    )
    rendered = render(*args, F.col("text"))
    return rows.drop("place", "header", "tokens").withColumns(
        {"rendered": rendered, "token_count": whitespace_tokens(rendered)}
    )


def context_support(context: DataFrame, routes: dict[str, Route], index: Index) -> DataFrame:
    """Entities and relations behind every delivered passage: ``query_id, object_id, kind, support_id``."""
    links = index.links.where(F.col("kind") == "relation").select(F.col("object_id").alias("relation_id"), "chunk_id")
    near = links.join(
        small_side(context.select("query_id", F.col("object_id").alias("chunk_id"))), "chunk_id"
    )
    frames = []
    for route in routes.values():
        if route.relations is None:
            continue
        used = near.join(
            route.relations.select("query_id", F.col("object_id").alias("relation_id")), ["query_id", "relation_id"]
        )
        frames.append(used.select("query_id", F.col("chunk_id").alias("object_id"), F.lit("relation").alias("kind"), F.col("relation_id").alias("support_id")))
        ends = used.join(_relation_ends(index), "relation_id").select(
            "query_id", "chunk_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")
        )
        known = ends.join(
            route.entities.select("query_id", F.col("object_id").alias("entity_id")), ["query_id", "entity_id"], "left_semi"
        )
        frames.append(known.select("query_id", F.col("chunk_id").alias("object_id"), F.lit("entity").alias("kind"), F.col("entity_id").alias("support_id")))
    return _union(frames).distinct()


def retrieve(
    index: Index, questions: DataFrame, mode: str = "mix",
    options: RetrievalOptions | None = None, reranker: Reranker | None = None, asked: _Asked | None = None,
) -> Retrieval:
    """Answer all ``questions(query_id, text[, keywords])`` with one strategy.

    ``asked`` are the same questions prepared; calls that share it share scorers' results.
    """
    options = options or RetrievalOptions()
    if options.rerank and reranker is None:
        raise ValueError("reranking was requested but no reranker is configured")
    composite = active_routes(mode, options)
    ready = prepare_questions(questions)
    asked = asked or _Asked(index, ready)
    limit = options.rerank_limit if options.rerank else options.top_k
    routes, subs = {}, None
    with_subs = "hybrid" in composite and options.multi_context_weight > 0.0
    for name in composite or (mode,):
        if name == "hybrid" and with_subs:
            routes[name], subs = _with_subquestions(index, ready, options)
        else:
            routes[name] = run_route(asked, name, options)
    paths = injected = anchors = None
    if composite:
        paths = graph_paths(index, routes, options)
        if options.graph_path_weight > 0.0:
            injected = cut_lineage(path_scores(index, paths, options))
        if options.multi_context_weight > 0.0 and not with_subs:
            subs = subquestion_route(index, ready, options)
        fused = fuse(routes, options.route_weights, injected, subs, options, index, limit)
    else:
        own = routes[mode].chunks
        fused = own.select(
            "query_id", "object_id", "score", F.col("score").alias("raw_score"),
            F.col("score").alias(f"part_{mode}"),
        )
    if subs is not None:
        anchors = cut_lineage(_anchors(index, subs, fused, limit, options))
        candidates = top_k_with_anchors(fused, anchors, limit)
    else:
        candidates = top_k(fused, limit, ["query_id"])
    candidates = cut_lineage(component_map(candidates))
    rerank_table = None
    if options.rerank:
        rerank_table = cut_lineage(apply_reranker(candidates, ready, index, reranker))
        final = rerank_table
        hits = top_k_with_anchors(final, anchors, options.top_k) if anchors is not None else top_k(final, options.top_k, ["query_id"])
        hits = hits.withColumnRenamed("prior_score", "retrieval_score").withColumn("rerank_score", F.col("score"))
    else:
        hits = candidates.withColumn("retrieval_score", F.col("score")).withColumn("rerank_score", F.lit(None).cast("double"))
    hits = cut_lineage(
        hits.select(
            "query_id", "rank", "object_id", "score", "raw_score", "retrieval_score",
            "rerank_score", "components",
        )
    )
    context = assemble_context(hits, anchors, index, options)
    return Retrieval(
        mode=mode, options=options, questions=ready, hits=hits, context=context,
        routes=route_trace(routes), paths=paths, rerank=rerank_table, anchors=anchors,
    )


def _anchors(index: Index, subs: DataFrame, fused: DataFrame, limit: int, options: RetrievalOptions) -> DataFrame:
    """The top of every sub-ranking, with fused scores and documents, reduced to anchors."""
    ranked = top_k(subs, options.top_k, ["query_id", "part"]).select(
        "query_id", "part", F.col("rank").alias("part_rank"), "object_id"
    )
    small = small_side(ranked)
    scored = fused.select("query_id", "object_id", "score").join(small, ["query_id", "object_id"])
    owners = index.chunks.select("object_id", "document_id").join(small_side(scored), "object_id")
    return document_anchors(owners, limit)
