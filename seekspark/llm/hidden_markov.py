"""Hidden Markov language model of words, trained by Baum-Welch over partitions.

Each iteration reads all training texts; tasks run the scaled forward-backward recursion
and return expected counts, which are summed and become the next parameters. A word
with a fixed share of all tokens has an emission of its own; the others emit through a
class, given by their last letters, and share its emission by their counts. Counts of
words too rare to be sent to every task are joined, so what is broadcast is bounded by
shares and not by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm import arrays
from seekspark.llm.frames import stored

STATES = 12
# Words with these shares of all training tokens have their own emission, or a count
# that every task knows; the inverse shares bound their numbers.
EMISSION_SHARE = 2e-5
LOCAL_SHARE = 2e-6
SUFFIX_BYTES = 3
SUFFIX_CLASSES = 2048
# Each iteration reads all training texts. They end when the log10 likelihood per token
# has grown by less than LEAST_GAIN, or after ITERATIONS.
ITERATIONS = 9
LEAST_GAIN = 1e-3
SEGMENT = 256
# Pieces that advance together.
BLOCK_ROWS = 512
# Weight of the corpus-wide word distribution in each state's emissions, in tokens.
PRIOR = 200.0
SEED = 7
END = 0


def _tokens(text: pa.Array):
    """Hash, suffix class and row of every word of the rows."""
    data, at = arrays.text_bytes(text)
    data = arrays.lower_ascii(data)
    start, end, row = arrays.words(data, at)
    suffix = arrays.span_hashes(data, np.maximum(start, end - SUFFIX_BYTES), end)
    return arrays.span_hashes(data, start, end), (suffix % np.uint64(SUFFIX_CLASSES)).astype(np.int32), row


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pd.DataFrame] = []
    size = 0

    def merged() -> pd.DataFrame:
        return pd.concat(held).groupby(["word", "suffix"], sort=False, as_index=False)["n"].sum()

    for part in arrays.slices(batches):
        word, suffix, _ = _tokens(part.column(0))
        code, first = pd.factorize(word)
        where = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
        one = pd.DataFrame({"word": first.view(np.int64), "suffix": suffix[where], "n": np.bincount(code, minlength=len(first))})
        held.append(one)
        size += len(one)
        if size > 1_500_000:
            held = [merged()]
            if len(held[0]) > 750_000:
                yield pa.RecordBatch.from_pandas(held[0], preserve_index=False)
                held = []
            size = sum(map(len, held))
    if held:
        yield pa.RecordBatch.from_pandas(merged(), preserve_index=False)


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the words whose counts every task knows
    counts: np.ndarray
    symbols: np.ndarray  # own emission of each, or -1
    own: int  # words with an emission of their own
    denominators: np.ndarray  # per suffix class: its tokens + words + 1
    unigram: np.ndarray  # training tokens per symbol: end, own words, suffix classes
    tokens: int
    types: int

    @property
    def size(self) -> int:
        return 1 + self.own + SUFFIX_CLASSES


def _vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = (sums["n"] or 0) + texts, sums["v"] + (texts > 0)
    rows = counts.where(F.col("n") >= max(2.0, tokens * LOCAL_SHARE)).select("word", "n").toPandas()
    word, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    least = max(2.0, tokens * EMISSION_SHARE)
    symbols = np.where(n >= least, np.cumsum(n >= least), -1)
    own = int((n >= least).sum())
    shared = counts.where(F.col("n") < least).groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    mass, kinds = np.zeros(SUFFIX_CLASSES), np.zeros(SUFFIX_CLASSES)
    mass[shared["suffix"]], kinds[shared["suffix"]] = shared["n"], shared["v"]
    unigram = np.concatenate([[texts], n[symbols > 0], mass + 0.5])
    return Vocabulary(word, n, symbols, own, mass + kinds + 1, unigram, tokens, types)


def _as_bytes(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values, which Spark reads many times faster than
    arrays of numbers."""
    ends = pa.array((4 * at).astype(np.int32))
    raw = pa.py_buffer(np.ascontiguousarray(values.astype("<i4")))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends.buffers()[1], raw])


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row_id = TaskContext.get().partitionId() << 33
        for part in arrays.slices(batches):
            rows = part.num_rows
            word, suffix, row = _tokens(part.column(0))
            if len(known.words):
                at = np.minimum(np.searchsorted(known.words, word), len(known.words) - 1)
                local = known.words[at] == word
            else:
                at, local = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
            count = np.where(local, known.counts[at], 0) if len(known.words) else np.zeros(len(word))
            symbol = np.where(local, known.symbols[at], -1) if len(known.words) else np.full(len(word), -1)
            own = symbol > 0
            symbol = np.where(own, symbol, 1 + known.own + suffix).astype(np.int32)
            logs = np.log10(count + 1)
            base = np.bincount(row[local], weights=logs[local], minlength=rows)
            inside = local & ~own
            shares = np.bincount(row[inside], weights=logs[inside], minlength=rows) - np.bincount(
                row[~own], weights=np.log10(known.denominators[suffix[~own]]), minlength=rows
            )
            n = np.bincount(row, minlength=rows)
            # The end of each text is its last symbol.
            stop = np.cumsum(n + 1)
            line = np.zeros(len(word) + rows, np.int32)
            keep = np.ones(len(line), bool)
            keep[stop - 1] = False
            line[keep], line[stop - 1] = symbol, END
            rest = np.flatnonzero(~local)
            edges = np.searchsorted(row[rest], np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[1:],
                    pa.array(row_id + np.arange(rows)),
                    _as_bytes(line, np.concatenate([[0], stop])),
                    pa.array(n + 1),
                    pa.array(np.bincount(row[local], minlength=rows)),
                    pa.array(base.astype(np.float64)),
                    pa.array(shares.astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(word[rest].view(np.int64))),
                ],
                names=[*part.schema.names[1:], "row_id", "symbols", "n_tokens", "known", "base", "shares", "rest"],
            )
            row_id += rows

    return run


@dataclass
class Parameters:
    start: np.ndarray  # K
    moves: np.ndarray  # K x K
    emissions: np.ndarray  # symbols x K

    def steady(self) -> np.ndarray:
        out = np.full(len(self.start), 1 / len(self.start))
        for _ in range(100):
            out = out @ self.moves
        return out / out.sum()


def first_parameters(unigram: np.ndarray, states: int = STATES) -> Parameters:
    """Persistent states with the corpus distribution, each disturbed at random."""
    noise = np.random.default_rng(SEED).normal(0, 0.7, (len(unigram), states))
    emissions = (unigram[:, None] + 1e-3) * np.exp(noise)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), moves, emissions / emissions.sum(0))


def _segments(symbols: pa.Array, limit: int | None):
    """Start, length and whether a text starts, longest first; cut at ``limit``.

    A row's symbols are the bytes of 32-bit numbers."""
    if isinstance(symbols, pa.ChunkedArray):
        symbols = symbols.combine_chunks()
    data, at = arrays.text_bytes(symbols.cast(pa.binary()))
    flat, at = data.view("<i4"), at // 4
    begin, size = at[:-1], np.diff(at)
    opens = np.ones(len(begin), bool)
    if limit:
        pieces = -(-size // limit)
        owner = np.repeat(np.arange(len(begin)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, opens = begin[owner] + number * limit, number == 0
        size = np.minimum(size[owner] - number * limit, limit)
    order = np.argsort(-size, kind="stable")
    return flat, begin[order], size[order], opens[order], order


def expected_counts(model: Parameters, symbols: pa.Array, start, moves, emissions) -> float:
    """Add the expected counts of some texts to the arrays (Baum-Welch); ``emissions`` has
    a row per state. Returns the log10 likelihood of the texts' pieces.

    The rows of one step stand one after the other, steps in order, so that emissions are
    gathered once and the counts of a state are summed over contiguous memory.
    """
    flat, begins, sizes, opened, _ = _segments(symbols, SEGMENT)
    states = len(model.start)
    steady, ones = model.steady(), np.ones(states)
    back = np.ascontiguousarray(model.moves.T)
    likelihood = 0.0
    for block in range(0, len(begins), BLOCK_ROWS):
        begin, size, opens = (x[block : block + BLOCK_ROWS] for x in (begins, sizes, opened))
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), "left")  # rows longer than t
        edge = np.concatenate([[0], np.cumsum(active)])
        step = np.repeat(np.arange(longest), active)
        at = flat[begin[np.arange(edge[-1]) - np.repeat(edge[:-1], active)] + step]
        emitted = model.emissions[at]
        alpha, inverse = np.empty((len(at), states)), np.empty((len(at), 1))
        now = np.where(opens[:, None], model.start, steady)
        for t in range(longest):
            here = slice(edge[t], edge[t + 1])
            rows, n = alpha[here], active[t]
            if t:
                np.matmul(now[:n], model.moves, out=rows)
                rows *= emitted[here]
            else:
                np.multiply(now, emitted[here], out=rows)
            np.divide(1.0, rows.dot(ones), out=inverse[here, 0])
            rows *= inverse[here]
            now = rows
        likelihood -= float(np.log10(inverse).sum())
        emitted *= inverse
        gamma = alpha.copy()
        beta = np.ones((len(begin), states))
        pair = np.zeros((states, states))
        for t in range(longest - 1, -1, -1):
            here, n = slice(edge[t], edge[t + 1]), active[t]
            gamma[here] *= beta[:n]
            if t:
                weighted = emitted[here]
                weighted *= beta[:n]
                pair += alpha[edge[t - 1] : edge[t - 1] + n].T @ weighted
                np.matmul(weighted, back, out=beta[:n])
        moves += pair * model.moves
        start += gamma[: active[0]][opens].sum(0)
        gamma = np.ascontiguousarray(gamma.T)
        for k in range(states):
            emissions[k] += np.bincount(at, weights=gamma[k], minlength=emissions.shape[1])
    return likelihood


def forward_log10(model: Parameters, symbols: pa.Array) -> np.ndarray:
    """log10 likelihood of each row's whole sequence by the scaled forward recursion."""
    flat, begin, size, _, order = _segments(symbols, None)
    out = np.zeros(len(begin))
    if len(begin):
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), "left")
        now = np.broadcast_to(model.start, (len(begin), len(model.start)))
        for t in range(longest):
            n = active[t]
            now = (now[:n] if t == 0 else now[:n] @ model.moves) * model.emissions[flat[begin[:n] + t]]
            total = now.sum(1)
            now = now / total[:, None]
            out[:n] += np.log10(total)
    back = np.empty(len(out))
    back[order] = out
    return back


# Rows of the sums beside the emissions: the log likelihood, the start, and the moves.
LIKELIHOOD, START, MOVES = -1, -2, -3


def _counter(shared, states: int):
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, moves = np.zeros(states), np.zeros((states, states))
        emissions = np.zeros(model.emissions.shape[::-1])
        likelihood = np.zeros(states)
        for batch in batches:
            likelihood[0] += expected_counts(model, batch.column(0), start, moves, emissions)
        used = np.flatnonzero(emissions.any(0))
        rows = np.concatenate([[LIKELIHOOD, START], MOVES - np.arange(states), used]).astype(np.int32)
        values = np.concatenate([likelihood[:, None], start[:, None], moves.T, emissions[:, used]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(v) for v in values]], names=["row", *names])

    return run, "row int, " + ", ".join(f"{n} double" for n in names), names


def _iterate(model: Parameters, sequences: DataFrame, vocabulary: Vocabulary) -> tuple[Parameters, float]:
    """The next parameters, and the log10 likelihood under those before."""
    states = len(model.start)
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    run, schema, names = _counter(shared, states)
    sums = sequences.select("symbols").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    shared.destroy()
    row, value = sums["row"].to_numpy(), sums[names].to_numpy()
    start, moves = np.full(states, 0.1), np.full((states, states), 0.1)
    start += value[row == START].sum(0)
    emissions = PRIOR * (vocabulary.unigram / vocabulary.unigram.sum())[:, None] * np.ones(states)
    emissions[row[row >= 0]] += value[row >= 0]
    moves[MOVES - row[row <= MOVES]] += value[row <= MOVES]
    after = Parameters(start / start.sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))
    return after, float(value[row == LIKELIHOOD].sum())


def score_texts(docs: DataFrame, is_training: Column, states: int = STATES, *keep: str) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score per row.

    Tokens are runs without ASCII white space after lower-casing A-Z, then one end; a null
    or empty text is its end alone. The model and the counts come from the rows of
    ``docs(text, ...)`` for which ``is_training`` holds; without any, every token has the
    count 0 and scores stay finite. base_score is the add-one unigram score, score the
    model's log10 probability, exact for texts of any length. Words are told apart by
    64-bit hashes. Repeated rows are scored, and counted, each.
    """
    spark = docs.sparkSession
    held = docs.select("text", F.coalesce(is_training, F.lit(False)).alias("training"), *keep)
    training = held.where("training")
    counts = stored(
        training.select("text").mapInArrow(_word_counts, "word long, suffix int, n long")
        .groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))
    )
    texts = training.count()
    vocabulary = _vocabulary(counts, texts)
    schema = held.drop("text").schema
    for name, kind in (
        ("row_id", "long"), ("symbols", "binary"), ("n_tokens", "long"), ("known", "long"),
        ("base", "double"), ("shares", "double"), ("rest", T.ArrayType(T.LongType())),
    ):
        schema = schema.add(name, kind)
    encoded = held.mapInArrow(_encoder(spark.sparkContext.broadcast(vocabulary)), schema)
    encoded = stored(encoded, "training")
    model = first_parameters(vocabulary.unigram + 1e-9, states)
    before = None
    for _ in range(ITERATIONS if texts else 0):
        model, likelihood = _iterate(model, encoded.where("training"), vocabulary)
        if before is not None and likelihood - before < LEAST_GAIN * vocabulary.tokens:
            break
        before = likelihood
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = forward_log10(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(value)], names=[*batch.schema.names[1:], "model"])

    columns = [*keep, "row_id", "n_tokens", "known", "base", "shares"]
    likelihood = encoded.select("symbols", *columns).mapInArrow(scored, encoded.select(*columns).schema.add("model", "double"))
    rest = encoded.select("row_id", F.explode("rest").alias("word")).join(counts.select("word", "n"), "word")
    rest = rest.groupBy("row_id").agg(F.sum(F.log10(F.col("n") + 1)).alias("rest_logs"), F.count("*").alias("rest_known"))
    logs = F.coalesce("rest_logs", F.lit(0.0))
    ends = math.log10(texts + 1)
    whole = math.log10(vocabulary.tokens + vocabulary.types + 1)
    return likelihood.join(rest, "row_id", "left").select(
        *keep, "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs + ends - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.col("shares") + logs).alias("score"),
    )
