"""Graph, resolution, extraction and chunking queries.

Stand-ins: suppliers and parts are entities linked by line items; parts are entity
mentions whose last word is an alias; documents are chunks and share lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.registry import Tables, query
from seekspark.functions.text import paragraphs
from seekspark.operators import chunking, extraction, graph, resolution
from seekspark.operators.quality import quality_class
from seekspark.scale import cut_lineage, small_side

GRAPH_SQL = """rel AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t, l_returnflag AS predicate,
  's' || l_suppkey || '-p' || l_partkey || '-' || l_returnflag AS relation_id FROM lineitem),
ent AS (SELECT 's' || s_suppkey AS entity_id, s_name AS canonical_name FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name FROM part),
adj AS (SELECT s AS entity_id, relation_id, t AS neighbor_id, 'outgoing' AS direction FROM rel
  UNION ALL SELECT t, relation_id, s, 'incoming' FROM rel),
deg AS (SELECT entity_id, count(*) FILTER (direction = 'incoming') AS in_degree, count(*) FILTER (direction = 'outgoing') AS out_degree,
  count(*) AS degree FROM adj GROUP BY 1)"""


def entities(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.col("s_name").alias("canonical_name"),
    )
    return suppliers.unionByName(
        t.part.select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"),
            F.col("p_name").alias("canonical_name"),
        )
    )


def relation_rows(t: Tables) -> DataFrame:
    """A relation per line item; equal ones repeat."""
    source = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    target = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return t.lineitem.select(
        source.alias("source_entity_id"),
        target.alias("target_entity_id"),
        F.col("l_returnflag").alias("predicate"),
        F.concat_ws("-", source, target, F.col("l_returnflag")).alias("relation_id"),
    )


def relations(t: Tables) -> DataFrame:
    return relation_rows(t).distinct()


@query(f"WITH {GRAPH_SQL} SELECT * FROM deg")
def entity_degree_table(t: Tables) -> DataFrame:
    return graph.degrees(relations(t))


@query(f"""WITH {GRAPH_SQL} SELECT entity_id, canonical_name, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
 coalesce(degree, 0) AS degree FROM ent LEFT JOIN deg USING (entity_id) ORDER BY degree DESC, lower(canonical_name), entity_id LIMIT 10""")
def top_entities_by_degree(t: Tables) -> DataFrame:
    return graph.top_entities(entities(t), relations(t), 10)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT DISTINCT s AS a, t AS b FROM rel UNION SELECT DISTINCT t, s FROM rel),
 low AS (SELECT (SELECT min(a) FROM e) AS root), reach(node) AS (SELECT root FROM low UNION SELECT b FROM reach JOIN e ON a = node),
 n AS (SELECT count(*) AS linked FROM (SELECT DISTINCT a FROM e)), r AS (SELECT count(*) AS size FROM reach),
 iso AS (SELECT count(*) AS isolated_nodes FROM ent WHERE entity_id NOT IN (SELECT a FROM e))
SELECT (SELECT count(*) FROM ent) AS nodes, (SELECT count(*) FROM rel) AS edges,
 CASE WHEN size = linked THEN 1 END + isolated_nodes AS components, size AS largest_component, isolated_nodes FROM n, r, iso""")
def graph_summary_row(t: Tables) -> DataFrame:
    return graph.graph_summary(entities(t), relations(t))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT 'd' || doc_id AS d, 'l' || sha256(line) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0),
 shared AS (SELECT h FROM l GROUP BY h HAVING count(*) > 1), se AS (SELECT d, h FROM l WHERE h IN (SELECT h FROM shared)),
 e AS (SELECT d AS a, h AS b FROM se UNION ALL SELECT h, d FROM se),
 reach(root, node) AS (SELECT DISTINCT d, d FROM se UNION SELECT root, b FROM reach JOIN e ON a = node),
 c AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT DISTINCT d AS node, coalesce(component, d) AS component FROM l LEFT JOIN c ON node = d""")
def shared_line_components(t: Tables) -> DataFrame:
    """Documents linked directly or transitively by identical lines."""
    lines = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("src"),
        F.explode(F.split("text", "\n")).alias("line"),
    ).where((F.length("line") > 0) & F.col("src").isNotNull())
    # A line is told by 128 bits of its hash, and links every document with the first one.
    hashed = lines.select("src", F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("line"))
    shared = hashed.groupBy("line").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst < last").drop("last")
    shared = cut_lineage(shared)
    edges = hashed.join(small_side(shared), "line").select("src", "dst").where("src <> dst").distinct()
    found = graph.connected_components(edges)
    return hashed.select(F.col("src").alias("node")).distinct().join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


@query(f"""WITH {GRAPH_SQL} SELECT entity_id, relation_id, neighbor_id, direction FROM adj""")
def adjacency_rows(t: Tables) -> DataFrame:
    return graph.adjacency(relations(t))


HOP_SQL = f"""WITH {GRAPH_SQL}, seeds AS (SELECT s_nationkey AS session_id, 's' || s_suppkey AS entity_id FROM supplier),
 trav AS (SELECT session_id, relation_id FROM seeds JOIN adj USING (entity_id) WHERE relation_id LIKE '%-A'),
 fresh AS (SELECT * FROM seeds JOIN adj USING (entity_id) WHERE (session_id, relation_id) NOT IN (SELECT session_id, relation_id FROM trav)),
 once AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY session_id, relation_id ORDER BY entity_id, neighbor_id) = 1),
 sel AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY entity_id, relation_id, neighbor_id) AS rank FROM once
   QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entity_id, relation_id, neighbor_id) <= 400)"""


@query(HOP_SQL + " SELECT session_id, entity_id AS seed_entity_id, relation_id, neighbor_id, direction, CAST(rank AS INTEGER) AS rank FROM sel")
def one_hop_expansion(t: Tables) -> DataFrame:
    return graph.expand_one_hop(*_hop_inputs(t), 400)[0]


@query(HOP_SQL + """ SELECT session_id, entity_id FROM seeds WHERE (session_id, entity_id) NOT IN
 (SELECT session_id, entity_id FROM fresh WHERE (session_id, relation_id) NOT IN (SELECT session_id, relation_id FROM sel))""")
def exhausted_seeds(t: Tables) -> DataFrame:
    return graph.expand_one_hop(*_hop_inputs(t), 400)[1]


def _hop_inputs(t: Tables):
    seeds = t.supplier.select(
        F.col("s_nationkey").alias("session_id"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"),
    )
    around = graph.adjacency(relations(t))
    walked = seeds.join(around, "entity_id").where(F.col("relation_id").endswith("-A"))
    return seeds, around, walked.select("session_id", "relation_id")


@query(f"""WITH {GRAPH_SQL}, st AS (SELECT entity_id AS a, neighbor_id AS b, min(relation_id) AS r FROM adj GROUP BY ALL),
 pairs AS (SELECT 's' || s_suppkey AS source, 'p' || s_suppkey AS target FROM supplier UNION ALL
   SELECT 's' || s_suppkey, 's' || (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) FROM supplier WHERE s_suppkey <> (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier)),
 h1 AS (SELECT source, target, 1 AS hops, source || '>' || target AS path FROM pairs JOIN st ON a = source AND b = target),
 h2 AS (SELECT source, target, 2 AS hops, arg_min(source || '>' || x.b || '>' || target, [source, x.b, target]) AS path FROM pairs JOIN st x ON x.a = source JOIN st y ON y.a = x.b AND y.b = target GROUP BY ALL),
 h3 AS (SELECT source, target, 3 AS hops, arg_min(source || '>' || x.b || '>' || y.b || '>' || target, [source, x.b, y.b, target]) AS path FROM pairs JOIN st x ON x.a = source JOIN st y ON y.a = x.b JOIN st z ON z.a = y.b AND z.b = target
   WHERE (source, target) NOT IN (SELECT source, target FROM h1) AND (source, target) NOT IN (SELECT source, target FROM h2) GROUP BY ALL),
 best AS (SELECT source, target, arg_min(path, hops) AS path FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY ALL),
 n AS (SELECT source, target, path, string_split(path, '>') AS l FROM best),
 hop AS (SELECT source, target, path, i, l[i] AS a, l[i + 1] AS b FROM (SELECT *, unnest(range(1, len(l))) AS i FROM n))
SELECT source, target, path, string_agg(r, '>' ORDER BY i) AS relations FROM hop JOIN st USING (a, b) GROUP BY ALL""")
def shortest_graph_paths(t: Tables) -> DataFrame:
    """Shortest undirected paths up to three hops between entity pairs."""
    n = t.supplier.agg(F.count("*").alias("n"))
    keys = t.supplier.join(F.broadcast(n)).select("s_suppkey", ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("other"))
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    pairs = keys.select(
        name.alias("source"),
        F.explode(F.array(
            F.concat(F.lit("p"), F.col("s_suppkey").cast("string")),
            F.concat(F.lit("s"), F.col("other").cast("string")),
        )).alias("target"),
    )
    # Of repeated relations the search takes the smallest id, so they needn't be made distinct.
    found = graph.shortest_paths(pairs, relation_rows(t), 3)
    return found.select(
        "source", "target", F.array_join("node_ids", ">").alias("path"),
        F.array_join("relation_ids", ">").alias("relations"),
    )


@query(f"""WITH {GRAPH_SQL} SELECT 'nodes' AS section, entity_id AS sort_key, '{{"id":"' || entity_id || '","canonical_name":"' || canonical_name || '"}}' AS json FROM ent
 UNION ALL SELECT 'edges', s || chr(31) || t || chr(31) || relation_id, '{{"source":"' || s || '","target":"' || t || '","key":"' || relation_id || '","predicate":"' || predicate || '"}}' FROM rel""")
def node_link_export(t: Tables) -> DataFrame:
    return graph.node_link_rows(entities(t), relations(t))


@query(f"""WITH {GRAPH_SQL} SELECT relation_id, entity_id FROM (SELECT relation_id, unnest([s, t]) AS entity_id FROM rel)
 WHERE entity_id NOT IN (SELECT entity_id FROM ent WHERE entity_id NOT LIKE '%7')""")
def dangling_relation_ends(t: Tables) -> DataFrame:
    """Integrity check against an entity table that lacks some entities."""
    kept = entities(t).where(~F.col("entity_id").endswith("7"))
    return graph.dangling_endpoints(kept, relations(t))


@query(f"""WITH {GRAPH_SQL}, ev AS (SELECT 'p' || l_partkey AS entity_id, count(*) AS evidence FROM lineitem GROUP BY 1)
SELECT entity_id, canonical_name, coalesce(out_degree, 0) AS outgoing, coalesce(in_degree, 0) AS incoming, coalesce(evidence, 0) AS evidence
FROM ent LEFT JOIN deg USING (entity_id) LEFT JOIN ev USING (entity_id)""")
def entity_inspection(t: Tables) -> DataFrame:
    from seekspark.operators.jobs import inspect_entities

    proof = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id"))
    return inspect_entities(entities(t), relations(t), proof)


# --- resolution ---------------------------------------------------------------
MENTION_SQL = """m AS (SELECT CAST(p_partkey AS VARCHAR) AS mention_id, p_name AS name, p_type AS entity_type,
  p_brand || ' ' || p_type || ' of size ' || p_size AS description, string_split(p_name, ' ')[-1] AS noun FROM part),
k AS (SELECT noun, name, count(*) AS n FROM m GROUP BY ALL),
c AS (SELECT noun, name AS canonical_name FROM k QUALIFY row_number() OVER (PARTITION BY noun ORDER BY n DESC, lower(name), name) = 1),
ty AS (SELECT noun, entity_type FROM (SELECT noun, entity_type, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY noun ORDER BY n DESC, entity_type) = 1),
e AS (SELECT noun, canonical_name, entity_type, 'ent_' || substr(sha256(lower(canonical_name)), 1, 20) AS entity_id FROM c JOIN ty USING (noun))"""


def greedy_sql(source: str, key: str) -> str:
    """CTEs ending in ``d({key}, description)``: longest-first texts within 4000 characters."""
    return f"""u AS (SELECT DISTINCT {key}, description FROM {source}),
 l AS (SELECT {key}, list({{'n': length(description), 't': description}} ORDER BY length(description) DESC, lower(description), description) AS l FROM u GROUP BY ALL),
 d AS (SELECT {key}, list_reduce(l, lambda a, x: CASE WHEN a.n + 1 + x.n <= 4000 THEN {{'n': a.n + 1 + x.n, 't': a.t || chr(10) || x.t}} ELSE a END).t AS description FROM l)"""


def mentions(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").cast("string").alias("mention_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("entity_type"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(" of size "), F.col("p_size").cast("string")).alias("description"),
        F.array(F.element_at(F.split("p_name", " "), -1)).alias("aliases"),
    )


@query(f"""WITH {MENTION_SQL}, {greedy_sql('m', 'noun')}
SELECT entity_id, canonical_name, lower(canonical_name) AS normalized_name, entity_type, description FROM e JOIN d USING (noun)""")
def resolved_entities(t: Tables) -> DataFrame:
    return resolution.resolve_entities(mentions(t))[0]


@query(f"WITH {MENTION_SQL} SELECT mention_id, entity_id FROM m JOIN e USING (noun)")
def mention_assignment(t: Tables) -> DataFrame:
    return resolution.resolve_entities(mentions(t))[1]


@query(f"""WITH {MENTION_SQL}, a AS (SELECT noun, name AS alias FROM m UNION SELECT noun, noun FROM m)
SELECT entity_id, alias FROM a JOIN e USING (noun) WHERE alias <> canonical_name""")
def entity_alias_rows(t: Tables) -> DataFrame:
    return resolution.resolve_entities(mentions(t))[2]


RELATION_SQL = f"""{MENTION_SQL}, me AS (SELECT mention_id, entity_id FROM m JOIN e USING (noun)),
rm AS (SELECT CAST(l_partkey AS VARCHAR) AS s, CAST(l_suppkey AS VARCHAR) AS t, CASE l_returnflag WHEN 'A' THEN 'PART_OF' WHEN 'N' THEN 'USED_WITH' ELSE 'REPLACES' END AS predicate,
 'line ' || l_linenumber || ' of quantity ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' status ' || l_linestatus AS description FROM lineitem),
loc AS (SELECT a.entity_id AS source_entity_id, b.entity_id AS target_entity_id, predicate, description,
 'rel_' || substr(sha256(a.entity_id || chr(31) || b.entity_id || chr(31) || predicate), 1, 20) AS relation_id
 FROM rm JOIN me a ON a.mention_id = s JOIN me b ON b.mention_id = t)"""


def relation_mentions(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_partkey").cast("string").alias("source_mention_id"),
        F.col("l_suppkey").cast("string").alias("target_mention_id"),
        F.when(flag == "A", "part of").when(flag == "N", "used with").otherwise("replaces").alias("predicate"),
        F.concat(
            F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of quantity "),
            F.col("l_quantity").cast("long").cast("string"), F.lit(" status "), F.col("l_linestatus"),
        ).alias("description"),
    )


@query(f"""WITH {RELATION_SQL}, {greedy_sql('loc', 'relation_id')}, h AS (SELECT relation_id, source_entity_id, target_entity_id, predicate, count(*) AS mentions FROM loc GROUP BY ALL)
SELECT h.*, description FROM h JOIN d USING (relation_id)""")
def merged_relations(t: Tables) -> DataFrame:
    assignment = resolution.resolve_entities(mentions(t))[1]
    return resolution.merge_relations(relation_mentions(t), assignment)


@query(f"""WITH {MENTION_SQL} SELECT DISTINCT entity_id, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM lineitem JOIN m ON mention_id = CAST(l_partkey AS VARCHAR) JOIN e USING (noun)""")
def entity_source_chunks(t: Tables) -> DataFrame:
    """Distinct evidence chunks per entity, kept as rows."""
    assignment = resolution.resolve_entities(mentions(t))[1]
    spans = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("mention_id"), F.col("l_orderkey").cast("string").alias("chunk_id")
    )
    return resolution.source_chunks(spans.join(assignment, "mention_id"), "entity_id")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_attempt_keys(t: Tables) -> DataFrame:
    return resolution.duplicate_keys(t.lineitem, "l_orderkey", "l_linenumber")


# --- extraction ---------------------------------------------------------------
def completions(t: Tables) -> DataFrame:
    """A completion per document with defects that depend on the document id."""
    key, line = F.col("doc_id"), F.trim(F.array_max(F.split("text", "\n")))

    def entity(ref, name, kind, quote):
        return F.struct(
            ref.alias("ref"), name.alias("name"), kind.alias("entity_type"),
            F.concat(F.lit("seen in "), F.col("source")).alias("description"),
            F.array().cast("array<string>").alias("aliases"), F.array(quote).alias("evidence_quotes"),
        )

    def relation(source, target, name, quote):
        return F.struct(
            F.lit(source).alias("source_ref"), F.lit(target).alias("target_ref"), name.alias("predicate"),
            F.lit("a link").alias("description"), F.array(quote).alias("evidence_quotes"),
        )

    absent = F.lit("never written anywhere")
    records = F.struct(
        F.array(
            entity(F.lit("e1"), F.col("source"), F.lit("dataSource"), line),
            entity(F.when(key % 3 == 0, F.lit("e1")).otherwise(F.lit("e2")), F.col("lang"), F.lit("language"), line),
            entity(F.lit("e3"), F.lit("third"), F.when(key % 5 == 0, F.lit("??")).otherwise(F.lit("other")), F.when(key % 4 == 0, absent).otherwise(line)),
        ).alias("entities"),
        F.array(
            relation("e1", "e2", F.lit("WRITTEN_IN"), line), relation("e1", "e1", F.lit("SAME"), line),
            relation("e1", "e3", F.when(key % 7 == 0, F.lit("bad name")).otherwise(F.lit("MENTIONS")), line),
            relation("e1", "e2", F.lit("WRITTEN_IN"), line),
        ).alias("relations"),
    )
    body = F.to_json(records)
    content = F.when(key % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        key % 13 == 0, F.lit("not json")
    ).otherwise(body)
    return t.documents.where(F.length(F.trim("text")) > 0).select(
        F.concat(F.lit("x"), key.cast("string")).alias("extraction_id"),
        key.cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"), content.alias("content"),
        F.when(key % 17 == 0, "content_filter").otherwise("stop").alias("finish_reason"),
    )


# Quotes over this length are rejected; it is the engine's own limit, stated once.
DOC_SQL = f"""base AS (SELECT doc_id, 'x' || doc_id AS extraction_id, length(trim(list_max(string_split(text, chr(10))))) > {extraction.MAX_QUOTE} AS long FROM documents WHERE length(trim(text)) > 0),
ok AS (SELECT * FROM base WHERE doc_id % 17 <> 0 AND (doc_id % 13 <> 0 OR doc_id % 11 = 0)),
er AS (SELECT extraction_id, doc_id, 0 AS index, CASE WHEN long THEN 'schema' END AS reason FROM ok
 UNION ALL SELECT extraction_id, doc_id, 1, CASE WHEN long THEN 'schema' WHEN doc_id % 3 = 0 THEN 'duplicate_ref' END FROM ok
 UNION ALL SELECT extraction_id, doc_id, 2, CASE WHEN doc_id % 5 = 0 OR (long AND doc_id % 4 <> 0) THEN 'schema' WHEN doc_id % 4 = 0 THEN 'not_verbatim' END FROM ok),
rr AS (SELECT extraction_id, doc_id, 0 AS index, CASE WHEN long THEN 'schema' WHEN doc_id % 3 = 0 THEN 'missing_endpoint' END AS reason FROM ok
 UNION ALL SELECT extraction_id, doc_id, 1, CASE WHEN long THEN 'schema' ELSE 'self_relation' END FROM ok
 UNION ALL SELECT extraction_id, doc_id, 2, CASE WHEN long OR doc_id % 7 = 0 THEN 'schema' WHEN doc_id % 5 = 0 OR doc_id % 4 = 0 THEN 'missing_endpoint' END FROM ok
 UNION ALL SELECT extraction_id, doc_id, 3, CASE WHEN long THEN 'schema' WHEN doc_id % 3 = 0 THEN 'missing_endpoint' ELSE 'duplicate_relation' END FROM ok)"""


def _usable(t: Tables) -> DataFrame:
    return extraction.classify_completions(completions(t)).where(F.col("failure").isNull())


@query(f"WITH {DOC_SQL} SELECT extraction_id, CASE WHEN doc_id % 17 = 0 THEN 'content_filtered' WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'invalid_json' END AS failure FROM base")
def completion_failures(t: Tables) -> DataFrame:
    return extraction.classify_completions(completions(t)).select("extraction_id", "failure")


@query(f"WITH {DOC_SQL} SELECT extraction_id, index, reason FROM er")
def entity_record_checks(t: Tables) -> DataFrame:
    return extraction.validate_entities(_usable(t)).select("extraction_id", "index", "reason")


@query(f"WITH {DOC_SQL} SELECT extraction_id, index, reason FROM rr")
def relation_record_checks(t: Tables) -> DataFrame:
    usable = _usable(t)
    checked = extraction.validate_relations(usable, extraction.validate_entities(usable))
    return checked.select("extraction_id", "index", "reason")


@query(f"""WITH {DOC_SQL}, q AS (SELECT extraction_id, count(*) FILTER (k = 'e') AS re, count(*) FILTER (k = 'e' AND reason IS NULL) AS ae,
 count(*) FILTER (k = 'r') AS rr, count(*) FILTER (k = 'r' AND reason IS NULL) AS ar FROM (SELECT *, 'e' AS k FROM er UNION ALL SELECT *, 'r' AS k FROM rr) GROUP BY 1)
SELECT CAST(sum(re) AS BIGINT) AS raw_entities, CAST(sum(ae) AS BIGINT) AS accepted_entities, CAST(sum(rr) AS BIGINT) AS raw_relations, CAST(sum(ar) AS BIGINT) AS accepted_relations,
 CAST(0 AS BIGINT) AS sanitized_relation_records, CAST(sum(re - ae) AS BIGINT) AS dropped_entities, CAST(sum(rr - ar) AS BIGINT) AS dropped_relations,
 count(*) FILTER (re > ae OR rr > ar) AS chunks_with_drops FROM q""")
def extraction_quality_totals(t: Tables) -> DataFrame:
    usable = _usable(t)
    checked = extraction.validate_entities(usable)
    return extraction.extraction_quality(checked, extraction.validate_relations(usable, checked))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS x, o_orderpriority AS f FROM orders WHERE o_orderstatus <> 'O'), c AS (SELECT DISTINCT o_custkey AS x, o_orderpriority AS f FROM orders WHERE o_orderstatus <> 'F'),
 a AS (SELECT x, f, max(b) AS b, max(c) AS c FROM (SELECT x, f, 1 AS b, 0 AS c FROM b UNION ALL SELECT x, f, 0, 1 FROM c) GROUP BY ALL)
SELECT x AS extraction_id, CAST(sum(b) AS BIGINT) AS baseline_facts, CAST(sum(c) AS BIGINT) AS candidate_facts, count(*) FILTER (b = 1 AND c = 0) = 0 AS accepted,
 CASE WHEN count(*) FILTER (b = 1 AND c = 0) = 0 THEN count(*) FILTER (b = 0 AND c = 1) ELSE 0 END AS added_facts FROM a GROUP BY x""")
def glean_audit_report(t: Tables) -> DataFrame:
    """Second-pass facts against first-pass facts, per customer as extraction."""
    facts = t.orders.select(F.col("o_custkey").alias("extraction_id"), F.col("o_orderpriority").alias("fact"), "o_orderstatus")
    baseline = facts.where("o_orderstatus <> 'O'").drop("o_orderstatus").distinct()
    candidate = facts.where("o_orderstatus <> 'F'").drop("o_orderstatus").distinct()
    return extraction.glean_audit(baseline, candidate)


# --- chunks -------------------------------------------------------------------
@query(r"""SELECT doc_id, CASE WHEN source = 'src3' THEN 'references'
 WHEN len(regexp_extract_all(trim(text), '(?m)^\s*\[\d+\]\s+[A-Z]')) >= 3 THEN 'references'
 WHEN regexp_matches(text, '(?i)(?:©|copyright|all rights reserved|permission to (?:copy|reproduce)|provided proper attribution|版权所有|保留所有权利)') THEN 'copyright'
 WHEN source <> 'src5' AND len(regexp_extract_all(text, '(?i)(?:\b(?:university|institute|department|laboratory|research lab|equal contribution)\b|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b)')) >= 2 THEN 'author_affiliation'
 WHEN regexp_matches(text, '(?i)(?:<\s*(?:eos|bos|pad)\s*>|attention visuali[sz]ations?|input[- ]input layer\d*)') THEN 'visualization_label' ELSE 'normal' END AS quality_class FROM documents""")
def quality_classes(t: Tables) -> DataFrame:
    path = (
        F.when(F.col("source") == "src3", F.array(F.lit("7. References")))
        .when(F.col("source") == "src5", F.array(F.lit("Method")))
        .otherwise(F.array().cast("array<string>"))
    )
    return t.documents.select(
        "doc_id", quality_class(path, F.col("text"), F.lit(0), F.lit(None).cast("int")).alias("quality_class")
    )


def document_segments(t: Tables) -> DataFrame:
    """Cleaned paragraphs of every document, the language as section, ten per page."""
    from seekspark.functions.text import clean_text

    blocks = paragraphs(clean_text(F.col("text")))
    return t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"), "lang", blocks.alias("blocks")
    ).select(
        "document_id",
        F.transform(
            "blocks",
            lambda b, i: F.struct(
                b.alias("text"), F.array("lang").alias("section_path"),
                (F.floor(i / 10) + 1).cast("int").alias("page_start"), (F.floor(i / 10) + 1).cast("int").alias("page_end"),
            ),
        ).alias("segments"),
    )


@query()
def document_chunks(t: Tables) -> DataFrame:
    """Section-aware chunks of all documents; checked by invariants and brute force in tests."""
    made = chunking.chunk_documents(document_segments(t), 128, 16)
    return made.withColumn("section_path", F.array_join("section_path", " > "))


@query("""WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 o AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 2 AS a FROM l),
 s AS (SELECT doc_id, a, a + length(line) AS b, i // 5 + 1 AS page FROM o)
SELECT doc_id, CAST(min(page) AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end FROM (SELECT d.doc_id, page FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND b > n_chars // 3 AND a < n_chars // 2) GROUP BY doc_id""")
def span_pages(t: Tables) -> DataFrame:
    """Pages overlapped by the middle part of every document."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            line.alias("text"), F.array().cast("array<string>").alias("section_path"),
            (F.floor(i / 5) + 1).cast("int").alias("page_start"), (F.floor(i / 5) + 1).cast("int").alias("page_end"),
        ),
    )
    placed = t.documents.select("doc_id", "n_chars", chunking.place_segments(lines).alias("segments"))
    pages = chunking.pages_of_span(
        F.col("segments"), F.floor(F.col("n_chars") / 3), F.floor(F.col("n_chars") / 2)
    )
    return placed.select("doc_id", pages.alias("p")).select("doc_id", "p.page_start", "p.page_end")
