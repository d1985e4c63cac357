"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech or other. One
small transducer per kind says how an insult or threat weighs in its state; their
composition runs over the clauses that hold an insult or threat, so a negated or reported
word counts less and a threat counts only against a target. The insult vocabulary, word
stems in any language, is learned from labelled texts, and so is the map from a text's
clause scores to a probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import arrays

# Bound on the labelled texts that the vocabulary and the probability are fitted on.
LABELLED_DOCUMENTS = 30_000
STEM_SIZES = (3, 4, 5, 6, 7)
WHOLE = 0
# A stem must be this much likelier in toxic texts, and rarely occur in others.
LEAST_ODDS = 20.0
LEAST_PRECISION = 0.8
LEAST_TEXTS = 3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
# Closed-class words of the grammar in the languages it knows.
WORDS = {
    THREAT: "kill hurt destroy attack stab shoot burn töten umbringen erschießen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yourself they them he she du dich dir euch ihr sie tu toi te vous ils elles tú usted ustedes ellos ellas",
    NEGATION: "not no never neither nor isn aren don nicht kein keine nie niemals pas jamais aucun non nunca jamás ningún",
    REPORT: "said says quote quoted called wrote claimed alleged sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
}
CLAUSE_ENDS = ".!?;\n"


@dataclass
class Transducer:
    """``step[state, symbol] = (next state, weight)``; anything else keeps the state."""

    step: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def move(self, state, symbol):
        return self.step.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: pairs of states, products of weights, over reachable pairs."""
        start = (self.start, other.start)
        step, todo = {}, [start]
        seen = {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in range(6):
                a_next, x = self.move(a, symbol)
                b_next, y = other.move(b, symbol)
                step[state, symbol] = ((a_next, b_next), x * y)
                if (a_next, b_next) not in seen:
                    seen.add((a_next, b_next))
                    todo.append((a_next, b_next))
        return Transducer(step, start)


def _scope(opener: int, width: int, factor: float) -> Transducer:
    """An opener changes the weight of hits in the next ``width`` words."""
    step = {}
    for left in range(width + 1):
        for symbol in range(6):
            weight = factor if left and symbol in (INSULT, THREAT) else 1.0
            step[left, symbol] = (max(left - 1, 0), weight)
        step[left, opener] = (width, 1.0)
    return Transducer(step)


@functools.cache
def grammar() -> Transducer:
    insult = Transducer({(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.1)})
    threat = Transducer({(0, THREAT): (0, 0.0), (1, THREAT): (1, 1.0), (0, TARGET): (1, 1.0)})
    target = Transducer({(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.2), (1, THREAT): (1, 1.2)})
    negation = _scope(NEGATION, 3, 0.6)
    report = _scope(REPORT, 8, 0.7)
    return insult.compose(threat).compose(target).compose(negation).compose(report)


def clause_score(symbols: list[int], weights: list[float]) -> float:
    machine, total = grammar(), 0.0
    state = machine.start
    for symbol, weight in zip(symbols, weights):
        state, factor = machine.move(state, symbol)
        if symbol in (INSULT, THREAT):
            total += weight * factor
    return total


class _Words:
    """Letter runs of a slice: the distinct words, and row and word code of each run."""

    def __init__(self, part: pa.Array):
        points, self.at = arrays.code_points(*arrays.text_bytes(part))
        self.rows = len(self.at) - 1
        self.points = arrays.lower_table()[points]
        letter = arrays.class_table()[points] == 1
        edge = np.zeros(len(points) + 1, bool)
        edge[self.at] = True
        before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
        after = np.concatenate([letter[1:], [False]]) if len(letter) else letter
        self.start = np.flatnonzero(letter & (~before | edge[:-1]))
        self.end = np.flatnonzero(letter & (~after | edge[1:])) + 1
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        self.code, self.hash = pd.factorize(arrays.span_hashes(self.points, self.start, self.end))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(self.code), prepend=-1)) if len(self.code) else self.code
        self.first_start, self.first_end = self.start[first], self.end[first]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(codes of distinct words, feature hash) for whole words and for each stem size."""
        every = np.arange(len(self.hash))
        yield every, arrays.mix(self.hash + np.uint64(1))
        for size in STEM_SIZES:
            long = every[self.first_end - self.first_start > size]
            begin = self.first_start[long]
            yield long, arrays.span_hashes(self.points, begin, begin + size)

    def signatures(self) -> np.ndarray:
        """One min-hash of the words per row; copies and most near copies share it."""
        low = np.full(self.rows, np.uint64(2**64 - 1))
        np.minimum.at(low, self.row, self.hash[self.code])
        return low

    def row_features(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs."""
        pair = np.unique(self.row.astype(np.int64) * max(1, len(self.hash)) + self.code)
        row, code = pair // max(1, len(self.hash)), pair % max(1, len(self.hash))
        rows, keys = [], []
        for codes, hashes in self.features():
            value = np.zeros(len(self.hash), np.uint64)
            has = np.zeros(len(self.hash), bool)
            value[codes], has[codes] = hashes, True
            chosen = has[code]
            rows.append(row[chosen])
            keys.append(value[code[chosen]])
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        return row[new], key[new]


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in arrays.slices(batches):
        words = _Words(part.column(0))
        row, key = words.row_features()
        sign = words.signatures()[row]
        pairs = pd.DataFrame({"feature": key.view(np.int64), "sign": sign.view(np.int64)}).drop_duplicates()
        yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)


def _clean_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for part in arrays.slices(batches):
            _, key = _Words(part.column(0)).row_features()
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            total += np.bincount(at[known[at] == key], minlength=len(known))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(known[hit].view(np.int64)), pa.array(total[hit])], names=["feature", "n"]
        )

    return run


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes of stems and words
    weights: np.ndarray
    intercept: float = -4.0
    slope: float = 2.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def _tail(hits: np.ndarray, total: np.ndarray, rate: float) -> np.ndarray:
    """Upper bound of the log probability of so many hits by chance (Chernoff)."""
    share = np.clip(hits / np.maximum(total, 1), 1e-9, 1 - 1e-9)
    bound = -total * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    return np.where(share <= rate, 0.0, bound)


def labelled_sample(labels: DataFrame, usable: Column, most: int = LABELLED_DOCUMENTS) -> DataFrame:
    """``label_id, toxic`` of about ``most`` labelled documents, chosen by a hash of the id.

    A document with several labels counts as toxic if one of them says so.
    """
    rows = labels.where("doc_id is not null and toxic is not null").where(usable)
    rows = rows.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(rows.count(), 1))
    limit = 2**63 - 1 if share == 1 else int(share * 2**64) - 2**63
    return F.broadcast(rows.where(F.xxhash64("label_id", F.lit("toxic")) <= F.lit(limit)))


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """Learn from ``docs(doc_id, text)`` whose row in ``labels`` is ``usable``.

    At most about LABELLED_DOCUMENTS rows are used, which bounds the vocabulary. With no
    toxic or no clean row the vocabulary is empty and every text scores low.
    """
    sample = labelled_sample(labels, usable)
    marked = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    toxic, clean = marked.where("toxic = 1").select("text"), marked.where("toxic = 0").select("text")
    found = toxic.mapInArrow(_toxic_features, "feature long, sign long").distinct()
    spark = docs.sparkSession
    held = (
        found.groupBy("feature").agg(F.count("*").alias("pos"))
        .where(F.col("pos") >= LEAST_TEXTS).toPandas()
    )
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    known = np.sort(held["feature"].to_numpy(np.int64).view(np.uint64))
    clean_texts = clean.count()
    toxic_texts = found.select("sign").distinct().count() if len(known) else 0
    if not len(known) or not clean_texts:
        return model
    counted = (
        clean.mapInArrow(_clean_counts(spark.sparkContext.broadcast(known)), "feature long, n long")
        .groupBy("feature").agg(F.sum("n").alias("neg")).toPandas()
    )
    both = held.merge(counted, "left", on="feature").fillna({"neg": 0})
    pos, neg = both["pos"].to_numpy(float), both["neg"].to_numpy(float)
    odds = (pos + 0.5) / (toxic_texts + 1) * (clean_texts + 1) / (neg + 0.5)
    rate = toxic_texts / (toxic_texts + clean_texts)
    sure = _tail(pos, pos + neg, rate) < -np.log(len(both))
    good = (odds >= LEAST_ODDS) & (pos / (pos + neg) >= LEAST_PRECISION) & sure
    feature = both["feature"].to_numpy(np.int64)[good].view(np.uint64)
    order = np.argsort(feature)
    model = ToxicityModel(feature[order], np.minimum(np.log(odds[good][order]), 6.0))
    evidence = toxicity_evidence(marked, model, "toxic")
    levels = (
        evidence.groupBy("toxic", F.round("evidence", 1).alias("e"))
        .agg(F.count("*").alias("n")).toPandas()
    )
    model.intercept, model.slope = _logistic(
        np.log1p(levels["e"].to_numpy(float)), levels["toxic"].to_numpy(float), levels["n"].to_numpy(float)
    )
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(beta @ design)))
        slope = design @ (n * (y - p)) - ridge * beta
        bend = (design * (n * p * (1 - p))) @ design.T + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@functools.cache
def _context_words() -> tuple[np.ndarray, np.ndarray]:
    texts = [(word, symbol) for symbol, words in WORDS.items() for word in words.split()]
    points = [np.array([ord(c) for c in word], np.uint32) for word, _ in texts]
    key = np.concatenate([arrays.span_hashes(p, np.array([0]), np.array([len(p)])) for p in points])
    order = np.argsort(key)
    return key[order], np.array([s for _, s in texts])[order]


def _evidence(part: pa.Array, model: ToxicityModel) -> np.ndarray:
    words = _Words(part)
    out = np.zeros(words.rows)
    if not len(words.hash):
        return out
    symbol = np.full(len(words.hash), OTHER)
    keys, kinds = _context_words()
    at = np.minimum(np.searchsorted(keys, words.hash), len(keys) - 1)
    symbol = np.where(keys[at] == words.hash, kinds[at], symbol)
    weight = np.where(symbol == THREAT, 3.0, 0.0)
    if len(model.features):
        for codes, hashes in words.features():
            at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
            hit = model.features[at] == hashes
            one = codes[hit]
            symbol[one] = INSULT
            weight[one] = np.maximum(weight[one], model.weights[at[hit]])
    matched = np.flatnonzero(weight[words.code] > 0)
    ends = np.flatnonzero(np.isin(words.points, np.array([ord(c) for c in CLAUSE_ENDS], np.uint32)))
    ends = np.union1d(ends, words.at)
    clause = np.searchsorted(ends, words.start, "right")
    for one in np.unique(clause[matched]):
        a, b = np.searchsorted(clause, [one, one + 1])
        code = words.code[a:b]
        out[words.row[a]] += clause_score(symbol[code].tolist(), weight[code].tolist())
    return out


def toxicity_evidence(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``keep`` columns and the summed clause scores of each row of ``docs(text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "scored_text"):
            evidence = _evidence(part.column(0), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(evidence)], names=[*part.schema.names[1:], "evidence"]
            )

    text = docs["text"].alias("scored_text")
    return docs.select(text, *keep).mapInArrow(run, docs.select(*keep).schema.add("evidence", "double"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Whole texts of any length are read. Null, empty and wordless texts have no clause
    and get the score of no evidence. Repeated rows get equal scores; a word that matches
    several stems takes the largest weight. Only ``text`` is read for the score.
    """
    p = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.log1p("evidence"))))
    return toxicity_evidence(docs, model, *keep).select(
        *keep, p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted")
    )
