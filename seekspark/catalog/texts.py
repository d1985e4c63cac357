"""Queries over text functions, tokens and the lexical and dense rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.catalog.registry import Tables, query
from seekspark.functions import ids, text, vectors
from seekspark.operators import blockmax, dense, lexical
from seekspark.operators.fusion import min_max, top_k
from seekspark.scale import checkpoint_dir

# --- SQL fragments shared by several statements -------------------------------
TOKENS_SQL = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\x{{3400}}-\x{{9fff}}]+|[\p{{L}}\p{{N}}]+')"
CORPUS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS object_id, text FROM documents"
QUESTION_SQL = "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark"


def bm25_sql(corpus: str = CORPUS_SQL, questions: str = QUESTION_SQL) -> str:
    """Common table expressions ending in ``bm25(query_id, object_id, score)``."""
    return f"""
    corpus AS ({corpus}), questions AS ({questions}),
    tok AS (SELECT object_id, unnest({TOKENS_SQL.format('text')}) AS term FROM corpus),
    lens AS (SELECT object_id, len({TOKENS_SQL.format('text')}) AS doc_len FROM corpus),
    tfs AS (SELECT object_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    tot AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
    qt AS (SELECT DISTINCT query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM questions),
    bm25 AS (
      SELECT query_id, object_id,
             sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 /
                 (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)))) AS score
      FROM qt JOIN dfs USING (term) JOIN tfs USING (term) JOIN lens USING (object_id), tot
      GROUP BY ALL)"""


def ranked_sql(source: str, k: int, by: str = "query_id", tie: str = "object_id") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {by}
        ORDER BY round(score, 12) DESC, {tie}) AS rank FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {by}
        ORDER BY round(score, 12) DESC, {tie}) <= {k}"""


def hash_vectors_sql(name: str, source: str, key: str) -> str:
    """CTEs ending in ``{name}({key}, slot, x)``: sparse unit hash vectors of ``source``."""
    return f"""
    {name}_w AS (SELECT {key}, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'),
        '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
    {name}_f AS (SELECT {key}, 'word:' || w AS f FROM {name}_w
        UNION ALL SELECT {key}, 'gram:' || substr(w, CAST(i AS BIGINT), 3)
        FROM (SELECT {key}, w, unnest(range(1, length(w) - 1)) AS i FROM {name}_w
              WHERE length(w) >= 3)),
    {name}_h AS (SELECT f, sha256(f) AS h FROM (SELECT DISTINCT f FROM {name}_f)),
    {name}_s AS (SELECT {key}, CAST(('0x' || substr(h, 1, 16))::UBIGINT % 384 AS INTEGER) AS slot,
        sum(CASE WHEN ('0x' || substr(h, 17, 2))::INTEGER % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v
        FROM {name}_f JOIN {name}_h USING (f) GROUP BY ALL),
    {name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS length FROM {name}_s GROUP BY ALL),
    {name} AS (SELECT {key}, slot, v / length AS x FROM {name}_s JOIN {name}_n USING ({key})
        WHERE length > 0)"""


def dense_sql() -> str:
    """CTEs ending in ``dense(query_id, object_id, score)`` over all documents."""
    return f"""
    dcorpus AS ({CORPUS_SQL}), dquestions AS ({QUESTION_SQL}),
    {hash_vectors_sql('dv', 'dcorpus', 'object_id')},
    {hash_vectors_sql('qv', 'dquestions', 'query_id')},
    dense AS (SELECT q.query_id, c.object_id, coalesce(s.score, 0.0) AS score
      FROM dquestions q CROSS JOIN dcorpus c LEFT JOIN (
        SELECT query_id, object_id, sum(qv.x * dv.x) AS score
        FROM qv JOIN dv USING (slot) GROUP BY ALL) s USING (query_id, object_id))"""


# --- frames shared by several queries -----------------------------------------
def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("object_id"), "text")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), "text")


def embedded(df: DataFrame, key: str) -> DataFrame:
    column = vectors.embed_column(vectors.HashEmbedder(), F.col("text"))
    return df.select(key, column.alias("embedding"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.round(column, 6))
    return df


# --- queries ------------------------------------------------------------------
@query(f"""WITH {bm25_sql()}, r AS ({ranked_sql('bm25', 8)})
SELECT query_id, object_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r""")
def bm25_topk(t: Tables) -> DataFrame:
    ranked = lexical.bm25_top_k(corpus(t), questions(t), 8)
    return rounded(ranked, "score")


def stored_lexical_index(t: Tables) -> blockmax.LexicalIndex:
    folder = f"{checkpoint_dir(t.spark)}/lexical-{uuid.uuid4().hex}"
    return blockmax.build_index(corpus(t), folder)


@query(f"""WITH {bm25_sql()}, r AS ({ranked_sql('bm25', 8)})
SELECT query_id, object_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r""")
def bm25_indexed_topk(t: Tables) -> DataFrame:
    """The same from a stored index, skipping blocks that can't reach the eighth score."""
    return rounded(blockmax.search(stored_lexical_index(t), questions(t), 8).hits, "score")


@query(f"""WITH {bm25_sql()} SELECT term, df, tokens FROM (SELECT 'word:' || term AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tokens FROM tfs GROUP BY term
 UNION ALL SELECT '', count(*), CAST(sum(doc_len) AS BIGINT) FROM lens)""")
def stored_term_statistics(t: Tables) -> DataFrame:
    """Document and token counts per term as the stored index keeps them."""
    return stored_lexical_index(t).terms


@query(f"""WITH {dense_sql()}, r AS ({ranked_sql('dense', 8)})
SELECT query_id, object_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r""")
def dense_topk(t: Tables) -> DataFrame:
    ranked = dense.dense_top_k(
        embedded(corpus(t), "object_id"), embedded(questions(t), "query_id"), 8, 384
    )
    return rounded(ranked, "score")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings),
parts AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS i FROM v),
cent AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS c FROM cent GROUP BY label),
s AS (SELECT query_id, vec_id AS object_id, list_cosine_similarity(c, e) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 12) DESC, object_id) AS rank FROM s)
SELECT query_id, object_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 10""")
def centroid_topk(t: Tables) -> DataFrame:
    """Nearest stored vectors of every label centroid."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]
        ).alias("embedding")
    )
    stored = t.embeddings.select(F.col("vec_id").alias("object_id"), "embedding")
    ranked = dense.dense_top_k(stored, centroids.withColumn("query_id", F.col("query_id").cast("long")), 10, 64)
    return rounded(ranked.withColumn("query_id", F.col("query_id").cast("int")), "score")


@query("""WITH c AS (SELECT doc_id, nfc_normalize(text) AS x FROM documents),
a AS (SELECT doc_id, replace(replace(replace(x, chr(173), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM c),
b AS (SELECT doc_id, regexp_replace(x, '([A-Za-z])-\\s*\\n\\s*([a-z])', '\\1-\\2', 'g') AS x FROM a),
d AS (SELECT doc_id, regexp_replace(regexp_replace(x, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g'),
     '([^\\n])\\n([^\\n])', '\\1 \\2', 'g') AS x FROM b),
e AS (SELECT doc_id, regexp_replace(x, '[\\t\\v\\f\\r ]+', ' ', 'g') AS x FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(x, ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS x FROM e)
SELECT doc_id, sha256(trim(x, ' ' || chr(10))) AS cleaned_hash, CAST(length(trim(x, ' ' || chr(10))) AS INTEGER) AS cleaned_chars FROM f""")
def cleaned_documents(t: Tables) -> DataFrame:
    cleaned = t.documents.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select(
        "doc_id",
        ids.sha256_text(F.col("cleaned")).alias("cleaned_hash"),
        F.length("cleaned").alias("cleaned_chars"),
    )


@query(f"""WITH tok AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS tokens, CAST(len(list_distinct(l)) AS INTEGER) AS distinct_tokens,
 sha256(array_to_string(list_transform(l, lambda x: 'word:' || x), ' ')) AS token_hash FROM tok""")
def lexical_token_lists(t: Tables) -> DataFrame:
    tokens = t.documents.select("doc_id", text.lexical_tokens(F.col("text")).alias("l"))
    return tokens.select(
        "doc_id",
        F.size("l").alias("tokens"),
        F.size(F.array_distinct("l")).alias("distinct_tokens"),
        F.sha2(F.array_join("l", " "), 256).alias("token_hash"),
    )


@query(f"""WITH tok AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS w FROM documents),
tfs AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY ALL)
SELECT 'word:' || w AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tokens FROM tfs GROUP BY w
UNION ALL SELECT '' AS term, count(*) AS df, CAST(sum(len({TOKENS_SQL.format('text')})) AS BIGINT) AS tokens FROM documents""")
def lexical_statistics(t: Tables) -> DataFrame:
    """Document frequency and token count per term; the empty term holds the totals."""
    return lexical.corpus_statistics(lexical.postings(corpus(t)))


@query(f"""WITH q AS (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*') AS l FROM benchmark),
w AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM q),
k AS (SELECT *, replace(lower(word), 'ß', 'ss') AS fold FROM w),
s AS (SELECT * FROM k WHERE fold NOT IN ('a','an','and','are','as','at','be','by','for','from','how','in','is','of','on','or','the','to','what','when','where','which','who','why','with')),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, fold ORDER BY pos) = 1),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 12),
a AS (SELECT item_id, string_agg(word, ', ' ORDER BY pos) AS keywords FROM g GROUP BY item_id)
SELECT b.item_id, a.keywords, b.text || chr(10) || 'Keywords: ' || a.keywords AS expanded
FROM benchmark b JOIN a USING (item_id)""")
def question_keywords(t: Tables) -> DataFrame:
    keyed = t.benchmark.select(
        "item_id", "text", text.deterministic_keywords(F.col("text")).alias("k")
    )
    return keyed.select(
        "item_id",
        F.array_join("k", ", ").alias("keywords"),
        text.expanded_query(F.col("text"), F.col("k")).alias("expanded"),
    )


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(
   regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\s*\\n'),
   lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: length(x) > 0)) AS paragraph FROM documents)
SELECT doc_id, sha256(paragraph) AS paragraph_hash, CAST(length(paragraph) AS INTEGER) AS chars FROM p""")
def text_paragraphs(t: Tables) -> DataFrame:
    found = t.documents.select(
        "doc_id", F.explode(text.paragraphs(F.col("text"))).alias("paragraph")
    )
    return found.select(
        "doc_id",
        ids.sha256_text(F.col("paragraph")).alias("paragraph_hash"),
        F.length("paragraph").alias("chars"),
    )


@query("""SELECT p_partkey, upper(trim(regexp_replace(upper(p_name || ' / ' || p_type), '[^A-Z0-9]+', '_', 'g'), '_')) AS predicate,
 trim(regexp_replace(upper(p_type || p_brand), '[^A-Z0-9]+', '_', 'g'), '_') AS entity_type,
 lower(trim(p_name)) || ' #' AS alias FROM part""")
def normalized_names(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        text.normalize_predicate(F.concat("p_name", F.lit(" / "), "p_type")).alias("predicate"),
        text.normalize_entity_type(F.concat(F.upper("p_type"), F.upper("p_brand"))).alias("entity_type"),
        text.normalize_alias(F.concat(F.lit(" “"), F.upper("p_name"), F.lit("   #' "))).alias("alias"),
    )


@query("""WITH d AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)[-1] AS quote FROM documents)
SELECT doc_id, CAST(instr(text, quote) - 1 AS INTEGER) AS char_start,
 CAST(instr(text, quote) - 1 + length(quote) AS INTEGER) AS char_end FROM d WHERE quote IS NOT NULL""")
def evidence_spans(t: Tables) -> DataFrame:
    """First verbatim offset of the last non-empty line of every document."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(line) > 0)
    quoted = t.documents.withColumn("quote", F.try_element_at(lines, F.lit(-1)))
    spans = quoted.select("doc_id", text.verbatim_span(F.col("quote"), F.col("text")).alias("s"))
    return spans.where(F.col("s").isNotNull()).select("doc_id", "s.char_start", "s.char_end")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(l_linenumber, l_linenumber + 1 + CAST(l_quantity AS BIGINT) % 3)) AS page FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, page AS page, 'evd_' || substr(sha256('doc-' || CAST(l_orderkey AS VARCHAR) || chr(31) || 'page:' || CAST(page AS VARCHAR)), 1, 20) AS evidence_id FROM l
UNION ALL SELECT NULL, NULL, NULL, NULL, 'evd_' || substr(sha256('doc-' || CAST(p_partkey AS VARCHAR) || chr(31) || 'section:' || p_brand || ' > ' || p_type), 1, 20) FROM part""")
def evidence_locators(t: Tables) -> DataFrame:
    """One locator per page of a range; a section locator where no page is known."""
    first = F.col("l_linenumber")
    last = (first + F.col("l_quantity").cast("int") % 3).cast("int")
    document = F.concat(F.lit("doc-"), F.col("l_orderkey").cast("string"))
    none = F.array().cast("array<string>")
    paged = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.posexplode(ids.evidence_ids(document, first, last, none)).alias("i", "evidence_id"),
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_linenumber") + F.col("i")).cast("long").alias("page"), "evidence_id",
    )
    nothing = F.lit(None).cast("int")
    name = F.concat(F.lit("doc-"), F.col("p_partkey").cast("string"))
    section = t.part.select(
        F.lit(None).cast("long").alias("l_orderkey"),
        nothing.alias("l_linenumber"),
        F.lit(None).cast("long").alias("l_partkey"),
        F.lit(None).cast("long").alias("page"),
        F.explode(ids.evidence_ids(name, nothing, nothing, F.array("p_brand", "p_type"))).alias("evidence_id"),
    )
    return paged.unionByName(section)


@query("""SELECT doc_id, 'doc_' || substr(sha256('file:' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 20) AS document_id,
 'chk_' || substr(sha256('file:' || source || '/' || CAST(doc_id AS VARCHAR) || chr(31) || '0' || chr(31) || sha256(text)), 1, 20) AS chunk_id FROM documents""")
def stable_identifiers(t: Tables) -> DataFrame:
    uri = ids.file_source_uri(F.col("source"), F.col("doc_id").cast("string"))
    return t.documents.select(
        "doc_id",
        ids.stable_id("doc", uri).alias("document_id"),
        ids.stable_id("chk", uri, F.lit("0"), ids.sha256_text(F.col("text"))).alias("chunk_id"),
    )


@query("""SELECT event_id, round(1 / (1 + exp(-(value - 20) / 5)), 6) AS logistic,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 round(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) / 1e6, 6) AS gap_seconds,
 ts + INTERVAL 300 SECOND AS lease_expires_at FROM events""")
def event_scalars(t: Tables) -> DataFrame:
    """Logistic score, strict JSON field, seconds since the user's last event, lease end."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    parsed = F.from_json("props", "k long", {"mode": "FAILFAST"})
    return t.events.select(
        "event_id",
        F.round(vectors.sigmoid((F.col("value") - 20) / 5), 6).alias("logistic"),
        parsed["k"].alias("k"),
        F.round(F.timestamp_diff("MICROSECOND", before, F.col("ts")) / 1e6, 6).alias("gap_seconds"),
        (F.col("ts") + F.expr("INTERVAL 300 SECONDS")).alias("lease_expires_at"),
    )


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS tokens,
 CASE WHEN len(regexp_extract_all(text, '\S+')) <= 24 THEN text
  ELSE regexp_extract(text, '^(?:\s*\S+){24}') || '…' END AS clipped,
 trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS normalized FROM conversations""")
def clipped_turns(t: Tables) -> DataFrame:
    """Token counts and the first 24 tokens of every turn."""
    body = F.col("text")
    return t.conversations.select(
        "conv_id", "turn",
        text.whitespace_tokens(body).alias("tokens"),
        text.clip_to_budget(body, F.lit(24)).alias("clipped"),
        text.normalize_context(body).alias("normalized"),
    )


@query()
def evidence_unit_lists(t: Tables) -> DataFrame:
    """Exact substrings of at most 700 characters; checked against brute force in tests."""
    return t.documents.where(F.length(F.trim("text")) > 0).select(
        "doc_id", F.posexplode(text.evidence_units(F.col("text"))).alias("unit", "content")
    )


@query(r"""WITH q AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: length(x) >= 5) AS w FROM benchmark),
c AS (SELECT item_id, 'Compare ' || array_to_string(w[1:3], ' ') || ' and ' || array_to_string(w[-3:], ' ') || ' in ' || w[4] AS question,
 array_to_string(w[1:3], ' ') || ' in ' || w[4] AS a, array_to_string(w[-3:], ' ') || ' in ' || w[4] AS b FROM q)
SELECT item_id, question, 1 AS part, a AS subquery FROM c UNION ALL SELECT item_id, question, 2, b FROM c WHERE b <> a""")
def comparison_parts(t: Tables) -> DataFrame:
    """Sub-questions of comparison questions made from every benchmark passage."""
    made = comparison_questions(t)
    parts = made.select(
        F.col("query_id").cast("long").alias("item_id"), F.col("text").alias("question"),
        F.posexplode(text.comparison_subqueries(F.col("text"))).alias("i", "subquery"),
    )
    return parts.select("item_id", "question", (F.col("i") + 1).alias("part"), "subquery")


def comparison_questions(t: Tables) -> DataFrame:
    words = F.filter(
        F.regexp_extract_all("text", F.lit(text.WORD_PATTERN), F.lit(0)),
        lambda word: F.length(word) >= 5,
    )
    split = t.benchmark.select("item_id", words.alias("w"))
    return split.select(
        F.col("item_id").cast("string").alias("query_id"),
        F.concat(
            F.lit("Compare "), F.array_join(F.slice("w", 1, 3), " "), F.lit(" and "),
            F.array_join(F.slice("w", -3, 3), " "), F.lit(" in "), F.get("w", F.lit(3)),
        ).alias("text"),
    )


@query(f"""WITH {bm25_sql()}, b AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM bm25 GROUP BY 1)
SELECT query_id, object_id, round(CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0
 ELSE (score - lo) / (hi - lo) END, 6) AS normalized FROM bm25 JOIN b USING (query_id)""")
def score_normalization(t: Tables) -> DataFrame:
    """Min-max over all positive BM25 scores of a query."""
    scores = lexical.bm25_scores(corpus(t), questions(t))
    return rounded(min_max(scores, ["query_id"]), "normalized").drop("score")


@query(f"""WITH dcorpus AS ({CORPUS_SQL}), {hash_vectors_sql('dv', 'dcorpus', 'object_id')}
SELECT object_id, CAST(count(*) AS BIGINT) AS filled, round(sum(x), 6) AS total, round(max(x), 6) AS largest,
 CAST(sum(slot) AS BIGINT) AS slot_sum FROM dv GROUP BY object_id""" .replace("FROM dv GROUP", "FROM dv WHERE x <> 0 GROUP"))
def hash_embeddings(t: Tables) -> DataFrame:
    """Fingerprint of the hash vector of every document."""
    parts = embedded(corpus(t), "object_id").select(
        "object_id", F.posexplode("embedding").alias("slot", "x")
    ).where(F.col("x") != 0)
    return parts.groupBy("object_id").agg(
        F.count("*").alias("filled"), F.round(F.sum("x"), 6).alias("total"),
        F.round(F.max("x"), 6).alias("largest"), F.sum("slot").alias("slot_sum"),
    )
