"""Retrieval queries over an index whose chunks are the documents; sources and
languages are its entities, and every pair of them that occurs is a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.registry import Tables, query
from seekspark.catalog.texts import (
    QUESTION_SQL, bm25_sql, comparison_questions, hash_vectors_sql, questions, ranked_sql, rounded,
)
from seekspark.functions.text import KEYWORD_STOPWORDS, deterministic_keywords
from seekspark.functions.vectors import HashEmbedder, embed_column
from seekspark.operators import digests
from seekspark.operators.fusion import (
    best_path_per_key, select_within_budget, top_k_with_anchors, weighted_fusion,
)
from seekspark.plans import answers, indexing
from seekspark.plans import retrieval as plan
from seekspark.plans.options import RetrievalOptions

CHUNK_SQL = """SELECT CAST(doc_id AS VARCHAR) AS object_id, 'Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text AS text FROM documents"""
ENTITY_SQL = """SELECT 'e:' || source AS object_id, 'Entity: ' || source || chr(10) || 'Type: SOURCE' || chr(10) || 'Aliases: (none)' || chr(10) || 'Description: ' || min(md5(text)) AS text FROM documents GROUP BY source
 UNION ALL SELECT 'e:' || lang, 'Entity: ' || lang || chr(10) || 'Type: LANGUAGE' || chr(10) || 'Aliases: (none)' || chr(10) || 'Description: ' || min(md5(text)) FROM documents GROUP BY lang"""
RELATION_SQL = """SELECT 'r:' || source || ':' || lang AS object_id, 'e:' || source AS s, 'e:' || lang AS t, 'Relation: ' || source || ' --WRITTEN_IN--> ' || lang || chr(10) || 'Description: ' || max(md5(text)) AS text FROM documents GROUP BY source, lang"""


def vectors_sql(name: str, source: str) -> str:
    """CTE ``{name}``: cosine of every question with every object of ``source``."""
    return f"""{hash_vectors_sql(name + 'v', source, 'object_id')},
 {name} AS (SELECT q.query_id, c.object_id, coalesce(s.score, 0.0) AS score FROM questions q CROSS JOIN {source} c LEFT JOIN (
   SELECT query_id, object_id, sum(qv.x * {name}v.x) AS score FROM qv JOIN {name}v USING (slot) GROUP BY ALL) s USING (query_id, object_id))"""


BASE_SQL = f"""{bm25_sql(CHUNK_SQL, QUESTION_SQL)}, ie AS MATERIALIZED ({ENTITY_SQL}), ir AS MATERIALIZED ({RELATION_SQL}), {hash_vectors_sql('qv', 'questions', 'query_id')},
 lk AS (SELECT 'e:' || source AS object_id, CAST(doc_id AS VARCHAR) AS chunk FROM documents UNION ALL SELECT 'e:' || lang, CAST(doc_id AS VARCHAR) FROM documents
   UNION ALL SELECT 'r:' || source || ':' || lang, CAST(doc_id AS VARCHAR) FROM documents)"""


def normal_sql(name: str, source: str, limit: int | None) -> str:
    """CTE ``{name}`` with ``n``: min-max of the (cut) scores per question."""
    cut = f"{name}_c AS ({ranked_sql(source, limit)})" if limit else f"{name}_c AS (SELECT * FROM {source})"
    return f"""{cut}, {name}_b AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM {name}_c GROUP BY 1),
 {name} AS (SELECT query_id, object_id, score, CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (score - lo) / (hi - lo) END AS n FROM {name}_c JOIN {name}_b USING (query_id))"""


HYBRID_SQL = f"""{vectors_sql('dn', 'corpus')}, {normal_sql('nd', 'dn', 32)}, {normal_sql('nb', 'bm25', 32)},
 hybrid AS (SELECT query_id, object_id, coalesce(nb.n, 0) / w + coalesce(nd.n, 0) / w AS score, nd.score AS dense_raw, nb.score AS bm25_raw
   FROM nd FULL JOIN nb USING (query_id, object_id) JOIN (SELECT query_id, 1 + CAST(query_id IN (SELECT query_id FROM nb) AS INTEGER) AS w FROM questions) USING (query_id))"""
LOCAL_SQL = f"""{vectors_sql('es', 'ie')}, le AS ({ranked_sql('es', 32)}),
 lr AS (SELECT query_id, ir.object_id, max(0.9 * score) AS score FROM le JOIN ir ON ir.s = le.object_id OR ir.t = le.object_id GROUP BY ALL),
 local AS (SELECT query_id, chunk AS object_id, max(score) AS score FROM (SELECT query_id, object_id, score FROM le UNION ALL SELECT * FROM lr) JOIN lk USING (object_id) GROUP BY ALL)"""
GLOBAL_SQL = f"""{vectors_sql('rs', 'ir')}, gr AS ({ranked_sql('rs', 32)}),
 ge AS (SELECT query_id, e AS object_id, max(score) AS score FROM (SELECT query_id, score, unnest([s, t]) AS e FROM gr JOIN ir USING (object_id)) GROUP BY ALL),
 global AS (SELECT query_id, chunk AS object_id, max(score) AS score FROM gr JOIN lk USING (object_id) GROUP BY ALL)"""
PATH_SQL = f"""pe AS (SELECT query_id, object_id, max(score) AS score FROM (SELECT query_id, object_id, score FROM le UNION ALL SELECT * FROM ge) GROUP BY ALL), p6 AS ({ranked_sql('pe', 6)}),
 ue AS (SELECT s AS a, t AS b, min(object_id) AS r FROM ir GROUP BY ALL), st AS (SELECT * FROM ue UNION ALL SELECT b, a, r FROM ue),
 pr AS (SELECT x.query_id, x.object_id AS source, y.object_id AS target, least(x.score, y.score) AS score FROM p6 x JOIN p6 y ON x.query_id = y.query_id AND x.rank < y.rank),
 p2 AS (SELECT query_id, source, target, pr.score, min(f.b) AS mid FROM pr JOIN st f ON f.a = source JOIN st g ON g.a = f.b AND g.b = target
   WHERE NOT EXISTS (SELECT 1 FROM st d WHERE d.a = source AND d.b = target) GROUP BY ALL),
 ph AS (SELECT query_id, score, source, mid, target, f.r AS r1, g.r AS r2, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, source, mid, target) AS pos
   FROM p2 JOIN st f ON f.a = source AND f.b = mid JOIN st g ON g.a = mid AND g.b = target WHERE score > 0),
 pc AS (SELECT query_id, chunk AS object_id, min(pos) AS pos, arg_min(score, pos) AS score FROM (SELECT query_id, pos, score, unnest([r1, r2]) AS o FROM ph) JOIN lk ON lk.object_id = o GROUP BY ALL),
 pi AS (SELECT query_id, object_id, score FROM pc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, object_id) <= 16)"""
MIX_SQL = f"""{normal_sql('fh', 'hybrid', None)}, {normal_sql('fl', 'local', None)}, {normal_sql('fg', 'global', None)}, {normal_sql('fp', 'pi', None)},
 fused AS (SELECT query_id, object_id, sum(v) AS score, max(raw) AS raw_score FROM (SELECT query_id, object_id, n AS v, score AS raw FROM fh UNION ALL SELECT query_id, object_id, n, score FROM fl
   UNION ALL SELECT query_id, object_id, n, score FROM fg UNION ALL SELECT query_id, object_id, 0.25 * n, score FROM fp) GROUP BY ALL)"""
HIT_COLUMNS = "query_id, object_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score"


def document_index(t: Tables, embedder: HashEmbedder | None = None) -> indexing.Index:
    embedder = embedder or HashEmbedder()
    docs = t.documents
    key = F.col("doc_id").cast("string")
    text = indexing.chunk_text(F.col("source"), F.array("lang"), F.col("text"))
    chunks = docs.select(
        key.alias("object_id"), F.col("source").alias("document_id"), F.col("source").alias("document_title"),
        F.array("lang").alias("section_path"), F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), "text", text.alias("embedding_text"),
    )
    start = F.md5("text")  # a digest of the whole text

    def entity(column: str, kind: str) -> DataFrame:
        found = docs.groupBy(F.col(column).alias("name")).agg(F.min(start).alias("description"))
        none = F.array().cast("array<string>")
        return found.select(
            F.concat(F.lit("e:"), F.col("name")).alias("object_id"), "name", F.lit(kind).alias("entity_type"),
            indexing.entity_text(F.col("name"), F.lit(kind), none, F.col("description")).alias("embedding_text"),
        )

    entities = entity("source", "SOURCE").unionByName(entity("lang", "LANGUAGE"))
    relation_id = F.concat(F.lit("r:"), F.col("source"), F.lit(":"), F.col("lang"))
    relations = docs.groupBy("source", "lang").agg(F.max(start).alias("description")).select(
        relation_id.alias("object_id"), F.concat(F.lit("e:"), F.col("source")).alias("source_entity_id"),
        F.concat(F.lit("e:"), F.col("lang")).alias("target_entity_id"), F.lit("WRITTEN_IN").alias("predicate"),
        indexing.relation_text(F.col("source"), F.lit("WRITTEN_IN"), F.col("lang"), F.col("description")).alias("embedding_text"),
    )
    ends = F.array(
        F.struct(F.lit("entity").alias("kind"), F.concat(F.lit("e:"), F.col("source")).alias("object_id")),
        F.struct(F.lit("entity").alias("kind"), F.concat(F.lit("e:"), F.col("lang")).alias("object_id")),
        F.struct(F.lit("relation").alias("kind"), relation_id.alias("object_id")),
    )
    links = docs.select(key.alias("chunk_id"), F.inline(ends))

    def embed(df: DataFrame) -> DataFrame:
        return df.withColumn("embedding", embed_column(embedder, F.col("embedding_text")))

    return indexing.Index(
        chunks=embed(chunks), entities=embed(entities), relations=embed(relations),
        links=links, embedder=embedder,
    )


def _hits(t: Tables, mode: str) -> DataFrame:
    found = plan.retrieve(document_index(t), questions(t), mode)
    return rounded(found.hits.select("query_id", "object_id", "rank", "score"), "score")


@query(f"WITH {BASE_SQL}, {HYBRID_SQL}, h AS ({ranked_sql('hybrid', 8)}) SELECT {HIT_COLUMNS} FROM h")
def hybrid_retrieval(t: Tables) -> DataFrame:
    return _hits(t, "hybrid")


@query(f"""WITH {BASE_SQL}, {HYBRID_SQL} SELECT query_id, object_id, round(dense_raw, 6) AS dense_raw, round(bm25_raw, 6) AS bm25_raw, round(score, 6) AS score FROM hybrid""")
def hybrid_components(t: Tables) -> DataFrame:
    """Raw scores of both scorers and their weighted average for all candidates."""
    index = document_index(t)
    asked = plan._Asked(index, plan.prepare_questions(questions(t)))
    details = plan.chunk_route(asked, "hybrid", RetrievalOptions()).details
    return rounded(details.select("query_id", "object_id", "dense_raw", "bm25_raw", "score"), "dense_raw", "bm25_raw", "score")


@query(f"WITH {BASE_SQL}, {LOCAL_SQL}, h AS ({ranked_sql('local', 8)}) SELECT {HIT_COLUMNS} FROM h")
def graph_local_retrieval(t: Tables) -> DataFrame:
    return _hits(t, "graph_local")


@query(f"WITH {BASE_SQL}, {GLOBAL_SQL}, h AS ({ranked_sql('global', 8)}) SELECT {HIT_COLUMNS} FROM h")
def graph_global_retrieval(t: Tables) -> DataFrame:
    return _hits(t, "graph_global")


@query(f"WITH {BASE_SQL}, {HYBRID_SQL}, {LOCAL_SQL}, {GLOBAL_SQL}, {PATH_SQL}, {MIX_SQL}, h AS ({ranked_sql('fused', 8)}) SELECT query_id, object_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(raw_score, 6) AS raw_score FROM h")
def mix_retrieval(t: Tables) -> DataFrame:
    """All routes, path injection included."""
    found = plan.retrieve(document_index(t), questions(t), "mix")
    return rounded(found.hits.select("query_id", "object_id", "rank", "score", "raw_score"), "score", "raw_score")


@query(f"""WITH {BASE_SQL}, {LOCAL_SQL}, {GLOBAL_SQL}, {PATH_SQL}, {MIX_SQL.replace(normal_sql('fh', 'hybrid', None) + ',', '').replace("SELECT query_id, object_id, n AS v, score AS raw FROM fh UNION ALL SELECT query_id, object_id, n, score FROM fl", "SELECT query_id, object_id, n AS v, score AS raw FROM fl")},
 h AS ({ranked_sql('fused', 8)}) SELECT {HIT_COLUMNS} FROM h""")
def graph_hybrid_retrieval(t: Tables) -> DataFrame:
    return _hits(t, "graph_hybrid")


@query(f"WITH {BASE_SQL}, {LOCAL_SQL} SELECT query_id, 'graph_local' AS route, 'chunk' AS kind, object_id, round(score, 6) AS score FROM local UNION ALL SELECT query_id, 'graph_local', 'entity', object_id, round(score, 6) FROM le UNION ALL SELECT query_id, 'graph_local', 'relation', object_id, round(score, 6) FROM lr")
def route_trace_rows(t: Tables) -> DataFrame:
    """Every scored object of the local graph route."""
    found = plan.retrieve(document_index(t), questions(t), "graph_local")
    return rounded(found.routes, "score")


@query(f"""WITH {BASE_SQL}, {LOCAL_SQL}, {GLOBAL_SQL}, {PATH_SQL},
 one AS (SELECT query_id, r AS relations, source || '>' || target AS nodes, pr.score FROM pr JOIN st ON a = source AND b = target),
 two AS (SELECT query_id, f.r || '>' || g.r AS relations, source || '>' || mid || '>' || target AS nodes, score FROM p2 JOIN st f ON f.a = source AND f.b = mid JOIN st g ON g.a = mid AND g.b = target)
SELECT query_id, nodes, relations, round(score, 6) AS score FROM (FROM one UNION ALL FROM two)""")
def question_graph_paths(t: Tables) -> DataFrame:
    """Shortest paths between the six best entities of every question."""
    found = plan.retrieve(document_index(t), questions(t), "graph_hybrid")
    return rounded(
        found.paths.select("query_id", F.array_join("node_ids", ">").alias("nodes"), F.array_join("relation_ids", ">").alias("relations"), "score"),
        "score",
    )


@query(f"""WITH {BASE_SQL}, {HYBRID_SQL}, h AS ({ranked_sql('hybrid', 8)}),
 rnd AS (SELECT query_id, h.object_id, rank, '[citation=' || h.object_id || '; document=' || source || '; section=' || lang || '; pages=n/a]' || chr(10) || d.text AS body FROM h JOIN documents d ON CAST(doc_id AS VARCHAR) = h.object_id),
 tk AS (SELECT *, len(regexp_extract_all(body, '\\S+')) AS tokens FROM rnd), l AS (SELECT query_id, list({{'o': object_id, 'n': tokens}} ORDER BY rank) AS l FROM tk GROUP BY 1),
 f AS (SELECT query_id, list_reduce(list_prepend({{'u': 0, 'k': ['']}}, list_transform(l, lambda x: {{'u': x.n, 'k': [x.o]}})), lambda a, x: CASE WHEN a.u + x.u <= 2400 THEN {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} ELSE a END) AS r FROM l),
 k AS (SELECT query_id, unnest(r.k[2:]) AS object_id, unnest(range(1, len(r.k))) AS position FROM f)
SELECT query_id, object_id, CAST(position AS INTEGER) AS position, CAST(tokens AS INTEGER) AS token_count, sha256(body) AS rendered_hash FROM k JOIN tk USING (query_id, object_id)""")
def budgeted_context(t: Tables) -> DataFrame:
    """Rendered evidence within 2400 tokens for every question."""
    found = plan.retrieve(document_index(t), questions(t), "hybrid").context
    return found.select("query_id", "object_id", "position", "token_count", F.sha2("rendered", 256).alias("rendered_hash"))


@query()
def comparison_retrieval(t: Tables) -> DataFrame:
    """Mixed retrieval of comparison questions with one anchor per compared subject."""
    found = plan.retrieve(document_index(t), comparison_questions(t), "mix")
    marks = found.anchors.select("query_id", "object_id", F.lit(True).alias("is_anchor"))
    hits = found.hits.join(F.broadcast(marks), ["query_id", "object_id"], "left")
    return rounded(
        hits.select("query_id", "object_id", "rank", "score", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")), "score"
    )


class OverlapReranker:
    """Stand-in cross-encoder: shared words minus half of the question's words."""

    provider, model = "overlap", "word-overlap"

    def score(self, asked, passages):
        pairs = zip(asked, passages)
        return [len(set(a.split()) & set(b.split())) - 0.5 * len(set(a.split())) for a, b in pairs]


@query(f"""WITH {BASE_SQL}, {HYBRID_SQL}, h AS ({ranked_sql('hybrid', 32)}),
 w AS (SELECT query_id, h.object_id, score, rank, list_distinct(regexp_extract_all(trim(q.text), '\\S+')) AS a, list_distinct(regexp_extract_all(c.text, '\\S+')) AS b FROM h JOIN questions q USING (query_id) JOIN corpus c USING (object_id)),
 z AS (SELECT query_id, object_id, rank AS pre_rank, score AS prior, 1 / (1 + exp(-(len(list_intersect(a, b)) - 0.5 * len(a)))) AS score FROM w)
SELECT query_id, object_id, CAST(pre_rank AS INTEGER) AS pre_rank, round(prior, 6) AS prior_score, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, round(prior, 12) DESC, object_id) AS INTEGER) AS final_rank FROM z""")
def reranked_candidates(t: Tables) -> DataFrame:
    """Ranks of all candidates before and after reranking."""
    from pyspark.sql import Window

    options = RetrievalOptions(rerank=True)
    found = plan.retrieve(document_index(t), questions(t), "hybrid", options, OverlapReranker())
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", 12).desc(), F.round("prior_score", 12).desc(), "object_id"
    )
    ranked = found.rerank.withColumn("final_rank", F.row_number().over(order))
    return rounded(ranked.select("query_id", "object_id", "pre_rank", "prior_score", "score", "final_rank"), "prior_score", "score")


@query(f"""WITH {BASE_SQL}, s AS (SELECT CAST(query_id AS BIGINT) AS q, object_id, score FROM bm25), nm AS (SELECT query_id, object_id, score FROM bm25), {normal_sql('x', 'nm', None)},
 kw AS (SELECT query_id, object_id, 1.0 * length(object_id) AS score FROM bm25), {normal_sql('y', 'kw', None)}
SELECT query_id, object_id, round(x.n * 1.5, 6) AS lexical, round(y.n * 0.5, 6) AS size, round(x.n * 1.5 + y.n * 0.5, 6) AS score FROM x JOIN y USING (query_id, object_id)""")
def additive_route_fusion(t: Tables) -> DataFrame:
    """Two routes with unequal weights, added; a third without weight is dropped."""
    from seekspark.operators.lexical import bm25_scores

    index = document_index(t)
    base = bm25_scores(index.chunks.select("object_id", F.col("embedding_text").alias("text")), questions(t))
    routes = base.select(
        "query_id", "object_id",
        F.inline(F.array(
            F.struct(F.lit("lexical").alias("route"), F.col("score").alias("score")),
            F.struct(F.lit("size").alias("route"), F.length("object_id").cast("double").alias("score")),
            F.struct(F.lit("unused").alias("route"), F.col("score").alias("score")),
        )),
    )
    fused = weighted_fusion(routes, {"lexical": 1.5, "size": 0.5, "unused": 0.0})
    return rounded(fused, "lexical", "size", "score")


@query("""WITH s AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS object_id, o_totalprice AS score, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS a FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a NULLS LAST, round(score, 12) DESC, object_id) AS slot FROM s), k AS (SELECT * FROM r WHERE slot <= 3)
SELECT query_id, object_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, object_id) AS INTEGER) AS rank FROM k""")
def anchored_selection(t: Tables) -> DataFrame:
    """Three orders per customer, urgent ones first, then ranked by price."""
    scores = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_totalprice").alias("score"))
    anchors = t.orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_orderkey").alias("anchor_rank")
    )
    return top_k_with_anchors(scores, anchors, 3).select("query_id", "object_id", "rank")


@query("""WITH r AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS object_id, 100 + o_orderkey % 400 AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 12) DESC, CAST(o_orderkey AS VARCHAR)) AS rank FROM orders),
 l AS (SELECT query_id, list({'o': object_id, 'n': tokens} ORDER BY rank) AS l FROM r WHERE rank <= 8 GROUP BY 1),
 f AS (SELECT query_id, list_reduce(list_prepend({'u': CAST(0 AS BIGINT), 'k': ['']}, list_transform(l, lambda x: {'u': x.n, 'k': [x.o]})), lambda a, x: CASE WHEN a.u + x.u <= 900 THEN {'u': a.u + x.u, 'k': list_concat(a.k, x.k)} ELSE a END) AS r FROM l),
 k AS (SELECT query_id, unnest(r.k[2:]) AS object_id, unnest(range(1, len(r.k))) AS position FROM f)
SELECT query_id, object_id, CAST(tokens AS BIGINT) AS tokens, CAST(position AS INTEGER) AS position FROM k JOIN r USING (query_id, object_id)""")
def token_budget_selection(t: Tables) -> DataFrame:
    """Greedy selection under a budget that skips what does not fit."""
    from seekspark.operators.fusion import top_k

    rows = t.orders.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("object_id"),
        F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 400 + 100).alias("tokens"),
    )
    return select_within_budget(top_k(rows, 8, ["query_id"]), 900)


@query("""WITH p AS (SELECT l_suppkey AS query_id, 'r' || l_partkey % 50 AS rel, 's' || l_suppkey AS a, 'p' || l_partkey AS b, l_discount AS score, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS arrival FROM lineitem)
SELECT query_id, rel AS relation, a || '>' || b AS nodes, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id, rel ORDER BY round(score, 12) DESC, arrival) = 1""")
def distinct_paths(t: Tables) -> DataFrame:
    """Best path per relation sequence; the earliest wins a tie."""
    paths = t.lineitem.select(
        F.col("l_suppkey").alias("query_id"),
        F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("node_ids"),
        F.array(F.concat(F.lit("r"), (F.col("l_partkey") % 50).cast("string"))).alias("relation_ids"),
        F.array().cast("array<string>").alias("source_chunk_ids"), F.col("l_discount").alias("score"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("arrival"),
    )
    return best_path_per_key(paths).select(
        "query_id", F.array_join("relation_ids", ">").alias("relation"), F.array_join("node_ids", ">").alias("nodes"), "score"
    )


@query(f"""SELECT object_id, 'chunk' AS kind, sha256(text) AS text_hash FROM ({CHUNK_SQL}) UNION ALL SELECT object_id, 'entity', sha256(text) FROM ({ENTITY_SQL}) UNION ALL SELECT object_id, 'relation', sha256(text) FROM ({RELATION_SQL})""")
def index_item_texts(t: Tables) -> DataFrame:
    index = document_index(t)
    items = indexing.index_items(index.chunks, index.entities, index.relations)
    return items.select("object_id", "kind", F.sha2("embedding_text", 256).alias("text_hash"))


@query(f"""SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'chunk' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'entity', count(*) FROM ({ENTITY_SQL}) UNION ALL SELECT 'relation', count(*) FROM ({RELATION_SQL}))""")
def index_kind_totals(t: Tables) -> DataFrame:
    index = document_index(t)
    return indexing.kind_counts(indexing.index_items(index.chunks, index.entities, index.relations))


TREE_SQL = """t3 AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS p, sha256(string_agg(l, '' ORDER BY l)) AS h, count(*) AS n FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(31) || sha256(text)) AS l FROM documents) GROUP BY 1),
 t2 AS (SELECT substr(p, 1, 2) AS q, sha256(string_agg(p || h, '' ORDER BY p)) AS h, sum(n) AS n FROM t3 GROUP BY 1), t1 AS (SELECT substr(q, 1, 1) AS r, sha256(string_agg(q || h, '' ORDER BY q)) AS h, sum(n) AS n FROM t2 GROUP BY 1),
 t0 AS (SELECT '' AS s, sha256(string_agg(r || h, '' ORDER BY r)) AS h, sum(n) AS n FROM t1)"""


@query(f"""WITH {TREE_SQL} SELECT CAST(level AS INTEGER) AS level, prefix, digest, CAST(n AS BIGINT) AS n FROM (SELECT 3 AS level, p AS prefix, h AS digest, n FROM t3 UNION ALL SELECT 2, q, h, n FROM t2 UNION ALL SELECT 1, r, h, n FROM t1 UNION ALL SELECT 0, s, h, n FROM t0)""")
def corpus_digest_tree(t: Tables) -> DataFrame:
    hashed = t.documents.select(F.col("doc_id").cast("string").alias("object_id"), F.sha2("text", 256).alias("content_hash"))
    return digests.digest_tree(hashed, "object_id", "content_hash", 3)


@query("""SELECT CAST(doc_id AS VARCHAR) AS object_id, CASE source WHEN 'src3' THEN 'changed' WHEN 'src5' THEN 'removed' ELSE 'added' END AS change FROM documents WHERE source IN ('src3', 'src5', 'src7')""")
def snapshot_differences(t: Tables) -> DataFrame:
    """Two snapshots compared through their trees: one source is changed, one missing in
    the second, one missing in the first; rows are read below differing nodes only."""
    def snapshot(left_out: str, text) -> DataFrame:
        kept = t.documents.where(F.col("source") != left_out)
        return kept.select(F.col("doc_id").cast("string").alias("object_id"), F.sha2(text, 256).alias("content_hash"))

    old = snapshot("src7", F.col("text"))
    new = snapshot("src5", F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    trees = [digests.digest_tree(rows, "object_id", "content_hash", 3) for rows in (old, new)]
    return digests.changed_rows(old, new, digests.differing_leaves(*trees, 3), "object_id", "content_hash", 3)


@query(f"""WITH {TREE_SQL} SELECT h AS fingerprint FROM t0""")
def corpus_fingerprint(t: Tables) -> DataFrame:
    hashed = t.documents.select(F.col("doc_id").cast("string").alias("object_id"), F.sha2("text", 256).alias("content_hash"))
    return indexing.content_fingerprint(hashed, "object_id", "content_hash")


@query(f"""WITH {BASE_SQL}, {HYBRID_SQL}, h AS ({ranked_sql('hybrid', 8)}),
 k AS (SELECT query_id, h.object_id, rank, len(regexp_extract_all('[citation=' || h.object_id || '; document=' || source || '; section=' || lang || '; pages=n/a]' || chr(10) || d.text, '\\S+')) AS tokens, d.text FROM h JOIN documents d ON CAST(doc_id AS VARCHAR) = h.object_id)
SELECT query_id, arg_min(object_id, rank) AS citations, sha256(arg_min(text, rank)) AS answer_hash, false AS insufficient_evidence FROM k WHERE tokens <= 2400 GROUP BY query_id""")
def grounded_answers(t: Tables) -> DataFrame:
    """Offline answers: the first delivered passage of every question, with its citation."""
    found = plan.retrieve(document_index(t), questions(t), "hybrid")
    answered = answers.deterministic_answers(found)
    return answered.select(
        "query_id", F.array_join("citations", ",").alias("citations"), F.sha2("answer", 256).alias("answer_hash"), "insufficient_evidence"
    )


# Questions with their first twelve distinct keywords appended.
KEYED_QUESTION_SQL = f"""SELECT CAST(item_id AS VARCHAR) AS query_id, any_value(text) || chr(10) || 'Keywords: ' || string_agg(word, ', ' ORDER BY pos) AS text FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS turn FROM (
  SELECT * FROM (SELECT *, replace(lower(word), 'ß', 'ss') AS fold FROM (
   SELECT item_id, text, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (
    SELECT item_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*') AS l FROM benchmark)))
  WHERE fold NOT IN ({", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)}) QUALIFY row_number() OVER (PARTITION BY item_id, fold ORDER BY pos) = 1))
 WHERE turn <= 12 GROUP BY item_id"""


@query(f"""WITH {BASE_SQL}, {HYBRID_SQL}, {LOCAL_SQL}, {GLOBAL_SQL}, {PATH_SQL}, {MIX_SQL}, h AS ({ranked_sql('fused', 8)}) SELECT {HIT_COLUMNS} FROM h""".replace(QUESTION_SQL, KEYED_QUESTION_SQL))
def keyword_expanded_retrieval(t: Tables) -> DataFrame:
    """Mixed retrieval with extracted keywords appended to every question."""
    keyed = questions(t).withColumn("keywords", deterministic_keywords(F.col("text")))
    found = plan.retrieve(document_index(t), keyed, "mix")
    return rounded(found.hits.select("query_id", "object_id", "rank", "score"), "score")


@query(f"""WITH {BASE_SQL}, {LOCAL_SQL}, h AS ({ranked_sql('local', 8)}),
 tk AS (SELECT query_id, h.object_id, rank, len(regexp_extract_all('[citation=' || h.object_id || '; document=' || source || '; section=' || lang || '; pages=n/a]' || chr(10) || d.text, '\\S+')) AS tokens FROM h JOIN documents d ON CAST(doc_id AS VARCHAR) = h.object_id),
 l AS (SELECT query_id, list({{'o': object_id, 'n': tokens}} ORDER BY rank) AS l FROM tk GROUP BY 1),
 f AS (SELECT query_id, l[1].o AS first, list_reduce(list_prepend({{'u': 0, 'k': ['']}}, list_transform(l, lambda x: {{'u': x.n, 'k': [x.o]}})), lambda a, x: CASE WHEN a.u + x.u <= 2400 THEN {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} ELSE a END) AS r FROM l),
 c AS (SELECT query_id, unnest(CASE WHEN len(r.k) > 1 THEN r.k[2:] ELSE [first] END) AS chunk FROM f),
 u AS (SELECT c.query_id, c.chunk, lk.object_id AS relation FROM c JOIN lk ON lk.chunk = c.chunk JOIN lr ON lr.query_id = c.query_id AND lr.object_id = lk.object_id)
SELECT query_id, chunk AS object_id, 'relation' AS kind, relation AS support_id FROM u
UNION SELECT u.query_id, u.chunk, 'entity', le.object_id FROM u JOIN ir ON ir.object_id = u.relation JOIN le ON le.query_id = u.query_id AND le.object_id IN (ir.s, ir.t)""")
def passage_support(t: Tables) -> DataFrame:
    """Entities and relations that stand behind every delivered passage."""
    index = document_index(t)
    ready = plan.prepare_questions(questions(t))
    routes = {"graph_local": plan.local_route(plan._Asked(index, ready), RetrievalOptions())}
    context = plan.retrieve(index, questions(t), "graph_local").context
    return plan.context_support(context, routes, index)
