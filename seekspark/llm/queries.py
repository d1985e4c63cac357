"""The queries of this subpackage, and SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
SQL: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        folder = folder.rstrip("/")
        return function(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[function.__name__] = run
    return function


@query
def op6_best_fit_packing(spark, table):
    import public_tokenizers

    from seekspark.llm.packing import pack_documents

    return pack_documents(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_language_id(spark, table):
    from seekspark.llm.frames import id_bucket
    from seekspark.llm.language import identify_languages, train_filters

    docs = table("documents").withColumn("held_out", id_bucket("doc_id", 4) == 2)
    filters = train_filters(docs.where("not held_out"))
    return identify_languages(docs, filters, "doc_id", "held_out")


@query
def op3_quality_classifier(spark, table):
    from seekspark.llm.quality import quality_scores

    return quality_scores(table("documents"), table("labels"))


@query
def op10_toxicity(spark, table):
    from seekspark.llm.frames import id_bucket
    from seekspark.llm.toxicity import toxicity_scores, train_toxicity

    docs = table("documents").withColumn("held_out", id_bucket("doc_id", 5) == 0)
    model = train_toxicity(docs, table("labels"), id_bucket("doc_id", 5) != 0)
    return toxicity_scores(docs, model, "doc_id", "held_out")


@query
def op5_html_extraction(spark, table):
    from seekspark.llm.html_text import extract_main_text

    return extract_main_text(table("pages"))


@query
def op4_order_minhash(spark, table):
    from seekspark.llm.neardup import near_duplicate_classes

    return near_duplicate_classes(table("documents"))


@query
def op1_nearest_neighbours(spark, table):
    from pyspark.sql import functions as F

    from seekspark.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table("embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


@query
def op7_subspace_join(spark, table):
    from seekspark.llm.similarity_join import linked_vectors

    return linked_vectors(table("embeddings"), "vec_id", "embedding")


@query
def op9_hidden_markov(spark, table):
    from seekspark.llm.frames import id_bucket
    from seekspark.llm.hidden_markov import STATES, score_texts

    docs = table("documents").withColumn("held_out", id_bucket("doc_id", 7) == 2)
    return score_texts(docs, id_bucket("doc_id", 7) != 2, STATES, "doc_id", "held_out")


@query
def op8_sentencepiece(spark, table):
    """Every document encoded and decoded again: its number of ids, their checksum, and
    whether the text came back."""
    import public_tokenizers

    from seekspark.llm.sentencepieces import round_trips

    return round_trips(table("documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id")


URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


@query
def op11_url_filter(spark, table):
    from seekspark.llm.url_rules import judge_urls

    return judge_urls(table("pages"), "url", URL_RULES, "page_id")


SQL["op11_url_filter"] = f"""WITH rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT row, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
s AS (SELECT row, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM raw),
m AS (SELECT s.*, verdict, h || p AS rule, row_number() OVER (PARTITION BY row ORDER BY length(h) DESC, length(p) DESC) AS place
 FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1"""


@query
def op12_importance_resampling(spark, table):
    from seekspark.llm.importance import importance_draw

    return importance_draw(table("documents"), table("benchmark"))


def _feature_counts(table: str) -> str:
    return f"""{table}_r AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM {table}),
{table}_w AS (SELECT row, word, i FROM (SELECT row, regexp_extract_all(
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table}_r),
 unnest(words) WITH ORDINALITY AS u(word, i)),
{table}_f AS (SELECT row, feature, count(*) AS n FROM (SELECT row, word AS feature FROM {table}_w
 UNION ALL SELECT row, word || ' ' || lead(word) OVER (PARTITION BY row ORDER BY i) FROM {table}_w) WHERE feature IS NOT NULL GROUP BY ALL)"""


SQL["op12_importance_resampling"] = f"""WITH RECURSIVE {_feature_counts("documents")}, {_feature_counts("benchmark")},
step(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
distinct_f AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM documents_f UNION SELECT feature FROM benchmark_f)),
bucket AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM distinct_f, crc),
s AS (SELECT b, sum(n) AS n FROM documents_f JOIN bucket USING (feature) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM benchmark_f JOIN bucket USING (feature) GROUP BY b),
total AS (SELECT (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM s) AS sn, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM t) AS tn),
gain AS (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (sn + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (tn + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t ON s.b = t.b, total),
weight AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM documents_f JOIN bucket USING (feature) JOIN gain USING (b) GROUP BY row),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents_r LEFT JOIN weight USING (row)),
ranked AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 39"""


@query
def op13_periodic_runs(spark, table):
    """The runs of each text, after a periodic tail was planted into one text in ten."""
    from pyspark.sql import functions as F

    from seekspark.llm.word_runs import longest_run, periodic_runs, with_planted_period

    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs(table("documents"), with_planted_period("text", key), "doc_id")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda text: F.concat(text, F.lit("\n"))), "")
    best = found.withColumn("best", longest_run("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
