import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seekspark.llm import hidden_markov, language, quality, toxicity
from seekspark.llm.frames import id_bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_id string"
VOICES = {
    "xx": "shu mako teri ponda kilo vash renu",
    "yy": "ölk brünn stoß häff grüm plötz wurg",
    "zz": "caña fuele ñoco riera muela jabó ción",
}


def _voice(name, words, draw):
    return " ".join(draw.choice(VOICES[name].split()) for _ in range(words))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, "x") for i, t, lang in rows], SCHEMA)


def test_id_bucket_is_crc32_of_the_decimal_text(spark):
    rows = spark.createDataFrame([(0,), (41,), (None,)], "doc_id long").select(id_bucket("doc_id", 7)).collect()
    assert [r[0] for r in rows] == [zlib.crc32(b"0") % 7, zlib.crc32(b"41") % 7, -1]


def test_languages_of_unseen_texts(spark):
    draw = random.Random(1)
    rows = [(i, _voice(n, draw.randint(3, 60), draw), n) for i, n in enumerate(list(VOICES) * 40)]
    filters = language.train_filters(_docs(spark, rows + [(900, None, "xx"), (901, "shu", None)]))
    assert filters.languages == ["xx", "yy", "zz"]
    fresh = [(i, _voice(n, 5, draw), n) for i, n in enumerate(list(VOICES) * 10)]
    odd = [(100, None, "xx"), (101, "", "xx"), (102, "12 .,!", "xx"), (103, "漢字", "yy"), (104, fresh[0][1] * 2000, "xx"), (0, fresh[0][1], "yy")]
    found = language.identify_languages(_docs(spark, fresh + odd), filters, "doc_id").collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(fresh) + len(odd)
    assert all(by_id[i]["lang_pred"] == n for i, _, n in fresh)
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_filters_return_all_languages_of_an_n_gram(spark):
    rows = [(0, "abab abab", "p"), (1, "abab cdcd", "q")]
    filters = language.train_filters(_docs(spark, rows))
    row, key, _ = language.grams(*language.arrays.text_bytes(pa.array(["abab", "cdcd"])))
    share = filters.scores(row, key, 2)
    assert share[0].min() > 0.9 and share[1][1] > 0.9 > share[1][0]
    nothing = language.train_filters(_docs(spark, rows).limit(0))
    assert language.identify_languages(_docs(spark, rows), nothing, "doc_id").first()["lang_pred"] == "und"


def _kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney from the definition, with dictionaries."""
    def symbols(t):
        return ["<s>"] * (order - 1) + list(re.sub(r"\s+", " ", re.sub(r"\d", "0", t or ""))) + ["</s>"]

    counts = {order: collections.Counter()}
    alphabet = set()
    for t in texts:
        s = symbols(t)
        alphabet |= set(s[order - 1 : -1])
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts, totals, rest = {}, {}, {}
    for k in counts:
        n = [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        discounts[k] = quality._discounts(n)
        totals[k], rest[k] = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            rest[k][g[:-1]] += discounts[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(alphabet) + quality.FIRST_SYMBOL)
        k, c = len(g), counts[len(g)][g]
        if not totals[k][g[:-1]]:
            return p(g[1:])
        own = (c - discounts[k][min(c, 3) - 1]) / totals[k][g[:-1]] if c else 0.0
        return own + rest[k][g[:-1]] / totals[k][g[:-1]] * p(g[1:])

    def perplexity(t):
        s = [x if x in alphabet or x in ("<s>", "</s>") else "<unk>" for x in symbols(t)]
        logs = [math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def test_perplexities_equal_the_definition(spark, monkeypatch):
    draw = random.Random(2)
    trusted = [(i, _voice("xx", draw.randint(1, 12), draw) + draw.choice([".", "", "\n 12"]), "xx") for i in range(60)] + [(60, None, "xx")]
    asked = trusted[:5] + [(70, "%%% shu &&", "xx"), (71, None, "xx"), (72, "", "yy"), (73, "makoteri kilokilo pondapon", "xx"), (70, "%%% shu &&", "xx")]
    # Only the very frequent n-grams are known to every task; the others are joined.
    monkeypatch.setattr(quality, "LOCAL_SHARE", 0.01)
    model = quality.train_quality_model(_docs(spark, trusted))
    found = quality.perplexities(_docs(spark, asked), model, "doc_id").collect()
    brute = _kneser_ney([t for _, t, _ in trusted], quality.ORDER)
    assert len(found) == len(asked)
    texts = {i: t for i, t, _ in asked}
    for r in found:
        assert math.isclose(r["perplexity"], brute(texts[r["doc_id"]]), rel_tol=1e-4)


def test_quality_keeps_clean_and_drops_junk(spark):
    draw = random.Random(3)
    rows = [(i, _voice(n, draw.randint(4, 40), draw), n) for i, n in enumerate(["xx", "yy"] * 60)]
    junk = [(200 + i, " ".join(w + draw.choice(["%%%", "###"]) for w in _voice("xx", 20, draw).split()), "xx") for i in range(10)]
    odd = [(300, None, "xx"), (301, "", None), (302, _voice("yy", 10, draw), None)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows[:100]] + [(200, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = _docs(spark, rows + junk + odd)
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs, labels).collect()}
    assert len(kept) == len(rows + junk + odd)
    assert sum(kept[i] for i, _, _ in rows) >= len(rows) - 2
    assert not any(kept[i] for i, _, _ in junk)
    assert kept[300] and kept[301] and kept[302]
    assert quality.quality_scores(docs, labels.limit(0)).where("not kept").count() == 0
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_a_language_with_one_trusted_text_keeps_its_clean_texts(spark):
    draw = random.Random(8)
    rows = [(i, _voice("xx", draw.randint(10, 40), draw), "xx") for i in range(200)]
    rare = [(500 + i, _voice("yy", draw.randint(10, 40), draw), "yy") for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(150), 500]], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(_docs(spark, rows + rare), labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert len(found) == len(rows + rare)
    assert sum(kept[i] for i, _, _ in rare) >= len(rare) - 1


def test_fitted_share_is_by_language_and_leaves_half_out(spark):
    rows = [(i, "t", "xx") for i in range(2000)] + [(5000 + i, "t", "yy") for i in range(9)] + [(9000, "t", "zz")]
    docs = _docs(spark, rows)
    chosen, below = quality.fitted_share(docs, docs.select("doc_id"), 100)
    count = collections.Counter(r["lang"] for r in chosen.collect())
    assert 60 <= count["xx"] <= 140 and count["yy"] == 4 and count["zz"] == 0
    assert below.count() == 3


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(4)
    k, size = 3, 6
    model = hidden_markov.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T)
    sequences = [[0], [3, 0], [1, 2, 5, 0], [4, 4, 1, 3, 0]]
    start, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    expected = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    logs = []
    for s in sequences:
        weight = {}
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emissions[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.moves[path[t - 1], path[t]] * model.emissions[s[t], path[t]]
            weight[path] = p
        total = sum(weight.values())
        logs.append(math.log10(total))
        for path, p in weight.items():
            expected[0][path[0]] += p / total
            for t in range(len(s)):
                expected[2][s[t], path[t]] += p / total
                if t:
                    expected[1][path[t - 1], path[t]] += p / total
    column = pa.array([np.array(s, "<i4").tobytes() for s in sequences], pa.binary())
    likelihood = hidden_markov.expected_counts(model, column, start, moves, emissions)
    assert math.isclose(likelihood, sum(logs))
    assert np.allclose(hidden_markov.forward_log10(model, column), logs)
    for got, want in zip((start, moves, emissions.T), expected):
        assert np.allclose(got, want)


def test_base_scores_equal_the_definition_and_the_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "LOCAL_SHARE", 0.02)
    monkeypatch.setattr(hidden_markov, "EMISSION_SHARE", 0.025)
    monkeypatch.setattr(hidden_markov, "PRIOR", 5.0)
    draw = random.Random(5)
    rows = [(i, _voice(n, draw.randint(20, 60), draw) + f" rare{i % 11}", n) for i, n in enumerate(list(VOICES) * 120)]
    rows += [(500, None, "xx"), (501, "", "xx"), (502, "SHU  Shu\x0bneverseen", "xx"), (3, rows[3][1], "xx")]
    training = id_bucket("doc_id", 7) != 2
    found = hidden_markov.score_texts(_docs(spark, rows), training, 4, "doc_id", "source").collect()
    assert len(found) == len(rows)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]
    counts = collections.Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        words = tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    untrained = hidden_markov.score_texts(_docs(spark, rows[:3]), F.lit(False), 4, "doc_id").collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in untrained)
    assert hidden_markov.score_texts(_docs(spark, rows).limit(0), training, 4, "doc_id").count() == 0


def test_every_iteration_reads_all_training_texts(spark, monkeypatch):
    read = []

    def iterate(model, sequences, vocabulary):
        read.append(sequences.count())
        return model, 1e9 * len(read)

    monkeypatch.setattr(hidden_markov, "_iterate", iterate)
    docs = _docs(spark, [(i, "shu mako", "xx") for i in range(40)])
    hidden_markov.score_texts(docs, F.col("doc_id") % 4 != 0, 3, "doc_id")
    assert read == [30] * 9


def test_clause_weights_compose():
    t = toxicity
    plain = t.clause_score([t.INSULT], [1.0])
    assert t.clause_score([t.TARGET, t.INSULT], [0, 1.0]) > plain
    assert t.clause_score([t.NEGATION, t.OTHER, t.INSULT], [0, 0, 1.0]) < plain
    assert t.clause_score([t.REPORT, t.OTHER, t.INSULT], [0, 0, 1.0]) < plain
    assert t.clause_score([t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT], [0, 0, 0, 0, 1.0]) == plain
    assert t.clause_score([t.THREAT], [1.0]) == 0 < t.clause_score([t.TARGET, t.THREAT], [0, 1.0])
    small = t.Transducer({(0, 1): (1, 0.5)}).compose(t.Transducer({(0, 1): (0, 0.5)}))
    assert small.move(small.start, 1) == ((1, 0), 0.25)


def test_toxic_stems_are_learned(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = _voice("xx", 30, draw).split() + [f"w{draw.randint(0, 9999)}a"]
        toxic = i % 5 == 0
        if toxic:
            words[draw.randint(0, 20)] = "grobian" + draw.choice(["o", "a", "es", "um"])
        rows.append((i, " ".join(words), "xx"))
        labels.append((i, 1, int(toxic)))
    fresh = [(1000, "mako grobianix teri.", "xx"), (1001, "mako teri", "xx"), (1002, None, "xx"), (1003, "", "xx"), (1004, "shu " * 5000 + "grobiane", "xx"), (1000, "mako grobianix teri.", "xx")]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(_docs(spark, rows), table, F.col("doc_id") % 4 != 0)
    found = toxicity.toxicity_scores(_docs(spark, fresh), model, "doc_id", "text").collect()
    assert len(found) == len(fresh)
    assert {r["doc_id"]: r["predicted"] for r in found} == {1000: 1, 1001: 0, 1002: 0, 1003: 0, 1004: 1}
    assert all(0 <= r["score"] <= 1 for r in found)
    empty = toxicity.train_toxicity(_docs(spark, rows), table.limit(0), F.lit(True))
    assert toxicity.toxicity_scores(_docs(spark, fresh), empty, "doc_id").where("predicted = 1").count() == 0
