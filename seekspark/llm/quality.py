"""Quality filter: interpolated modified Kneser-Ney character model of trusted text.

Counts, continuation counts, discounts and back-off weights are aggregations and joins of
n-gram tables. A text's n-grams are first summed within the text. Those frequent in the
trusted text (at most a fixed number) are scored in place; the others are joined with
the count tables, sharded by n-gram, and summed per document.
A document is kept if its perplexity is within its language's limit. A short text's
perplexity varies more, as one over the root of its length; so what is compared with the
quantile of trusted texts of the language is the log distance from their median
perplexity times that root.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm import arrays
from seekspark.llm.frames import stored
from seekspark.scale import small_side

ORDER = 4
SYMBOL_BITS = 16
# Symbols below this share of the trusted text are the unknown symbol. N-grams below theirs
# are joined, unless there are few. The inverse shares bound what is sent to every task.
SYMBOL_SHARE = 2e-5
LOCAL_SHARE = 1e-6
# Trusted ids are broadcast up to this many; beyond it they are joined by id.
BROADCAST_IDS = 1_000_000
QUANTILE = 0.998
# The limit is the quantile times this factor.
SLACK = 1.25
UNKNOWN, START, END = 0, 1, 2
FIRST_SYMBOL = 3


def _symbols(data: np.ndarray, at: np.ndarray):
    """Code points with digits folded and each run of white space as one blank."""
    points, at = arrays.code_points(data, at)
    kind = arrays.class_table()[points]
    points = np.where(kind == 3, 32, np.where(kind == 2, 48, points))
    blank = kind == 3
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1][at[:-1] < len(points)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], kept[at]


def _encode(data: np.ndarray, at: np.ndarray, alphabet: np.ndarray):
    """Keys of the n-grams that end at each symbol or at the end of a row; row of each."""
    points, at = _symbols(data, at)
    where = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(where, len(alphabet) - 1)] == points if len(alphabet) else np.zeros(len(points), bool)
    code = np.where(known, where + FIRST_SYMBOL, UNKNOWN).astype(np.uint64)
    rows, size = len(at) - 1, np.diff(at)
    pad = ORDER - 1
    line = np.full(len(code) + rows * (pad + 1), START, np.uint64)
    owner = np.repeat(np.arange(rows), size + pad + 1)
    line[np.arange(len(code)) + np.repeat(np.arange(rows) * (pad + 1) + pad, size)] = code
    last = at[1:] + np.arange(1, rows + 1) * (pad + 1) - 1
    line[last] = END
    key = np.zeros(max(0, len(line) - pad), np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(SYMBOL_BITS)) | line[k : k + len(key)]
    good = owner[:-pad] == owner[pad:] if len(line) > pad else np.zeros(0, bool)
    return key[good], owner[pad:][good]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _summed(keys_of):
    """Task-wise sums of the keys that ``keys_of(data, at)`` gives, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in arrays.slices(batches):
            one = np.unique(keys_of(*arrays.text_bytes(part.column(0))), return_counts=True)
            held.append(one)
            size += len(one[0])
            if size > 2_000_000:
                held = [_merged(held)]
                size = len(held[0][0]) // 2
        if held:
            key, count = _merged(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.uint64).view(np.int64)), pa.array(count)], names=["key", "n"]
            )

    return run


def _context(key: str = "key"):
    return F.shiftrightunsigned(key, SYMBOL_BITS)


def _suffix(order: int, key: str = "key"):
    """The last ``order`` symbols of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << (SYMBOL_BITS * order)) - 1))


class QualityModel:
    """``grams[k](key, lp)`` and ``backoffs[k](key, lb)`` of the orders 1 to ORDER."""

    def __init__(self, alphabet, grams, backoffs, total):
        self.alphabet, self.grams, self.backoffs, self.total = alphabet, grams, backoffs, total

    @functools.cached_property
    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent n-grams and their log probabilities; at most 1 / LOCAL_SHARE rows."""
        least, table = max(1.0, self.total * LOCAL_SHARE), self.grams[ORDER]
        # Counts below the share, at most ``least`` different ones, and null for all above it.
        sizes = dict(table.groupBy(F.when(F.col("n") < least, F.col("n")).alias("n")).count().collect())
        room = 1 / LOCAL_SHARE - sizes.pop(None, 0)
        for n in sorted(sizes, reverse=True):
            room -= sizes[n]
            if room < 0:
                break
            least = n
        rows = table.where(F.col("n") >= least).select("key", F.col("lp").cast("float").alias("lp")).toPandas()
        key = rows["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        return key[order], rows["lp"].to_numpy(np.float32)[order]


def _alphabet(trusted: DataFrame) -> tuple[np.ndarray, int]:
    """The symbols above their share, in order, and the number of all symbols."""

    def symbols(data, at):
        return _symbols(data, at)[0].astype(np.uint64)

    counts = trusted.select("text").mapInArrow(_summed(symbols), "key long, n long")
    counts = stored(counts.groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(1.0, total * SYMBOL_SHARE)).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64)).astype(np.uint32), total


def _gram_table(trusted: DataFrame, alphabet: np.ndarray) -> DataFrame:
    """``key, n`` of the n-grams of order ORDER."""

    def keys(data, at):
        return _encode(data, at, alphabet)[0]

    table = trusted.select("text").mapInArrow(_summed(keys), "key long, n long")
    return stored(table.groupBy("key").agg(F.sum("n").alias("n")))


def train_quality_model(trusted: DataFrame) -> QualityModel:
    """Fit on ``trusted(text)``; nulls count as empty texts, no rows give a flat model."""
    alphabet, total = _alphabet(trusted)
    return _fitted(alphabet, _gram_table(trusted, alphabet), total)


def cross_fitted(trusted: DataFrame) -> tuple[QualityModel, QualityModel, QualityModel]:
    """Models of all of ``trusted(text, upper)``, of its lower and of its upper half.

    Every text is counted once; the whole model's counts are the sums of the halves'.
    """
    alphabet, total = _alphabet(trusted)
    halves = [_gram_table(trusted.where(F.col("upper") == upper), alphabet) for upper in (False, True)]
    whole = stored(halves[0].unionByName(halves[1]).groupBy("key").agg(F.sum("n").alias("n")))
    lower, upper = (_fitted(alphabet, half, half.agg(F.sum("n")).first()[0] or 0) for half in halves)
    return _fitted(alphabet, whole, total), lower, upper


def _fitted(alphabet: np.ndarray, table: DataFrame, total: int) -> QualityModel:
    """The model of a stored table of n-grams of order ORDER.

    Each step is stored, so that no plan repeats the ones before it: the driver plans and
    compiles small joins only.
    """
    tables = {ORDER: table}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = stored(
            tables[order + 1].groupBy(_suffix(order).alias("key")).agg(F.count("*").alias("n"))
        )
    symbols_known = len(alphabet) + FIRST_SYMBOL
    grams, backoffs = {}, {}
    lower = None
    for order in range(1, ORDER + 1):
        cc = tables[order].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
        discounts = _discounts([cc[f"n{i}"] for i in range(1, 5)])
        taken = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        seen = tables[order].select("key", "n", _context().alias("context"), taken.alias("taken"))
        contexts = stored(seen.groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest")
        ))
        joined = seen.join(contexts, "context").withColumn("suffix", _suffix(order - 1) if order > 1 else F.lit(0))
        if lower is None:
            below = joined.withColumn("p_low", F.lit(1.0 / symbols_known))
        else:
            below = joined.join(lower.select(F.col("key").alias("suffix"), F.exp("lp").alias("p_low")), "suffix")
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("rest") * F.col("p_low")
        lower = grams[order] = stored(below.select("key", "n", F.log(p).alias("lp")))
        backoffs[order] = contexts.select(F.col("context").alias("key"), F.log("rest").alias("lb"))
    return QualityModel(alphabet, grams, backoffs, total)


def _discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the counts of counts; 0.5 where undefined."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in range(3)]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, (table, value) = model.value
        row_id = TaskContext.get().partitionId() << 33
        for part in arrays.slices(batches):
            rows = part.num_rows
            key, row = _encode(*arrays.text_bytes(part.column(0)), alphabet)
            total = np.bincount(row, minlength=rows)
            if len(table):
                at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                hit = table[at] == key
                local = np.bincount(row[hit], weights=value[at[hit]], minlength=rows)
            else:
                hit, local = np.zeros(len(key), bool), np.zeros(rows)
            # Other n-grams, summed within each row.
            rest, owner = key[~hit], row[~hit]
            order = np.lexsort((rest, owner))
            rest, owner = rest[order], owner[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(rest))).astype(np.int32)
            ends = pa.array(np.searchsorted(owner[start], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[1:],
                    pa.array(row_id + np.arange(rows)),
                    pa.array(total.astype(np.int64)),
                    pa.array(local.astype(np.float64)),
                    pa.ListArray.from_arrays(ends, pa.array(rest[start].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(count)),
                ],
                names=[*part.schema.names[1:], "row_id", "n_symbols", "local", "keys", "counts"],
            )
            row_id += rows

    return run


def _resolved(keys: DataFrame, model: QualityModel) -> DataFrame:
    """``key, lp`` of each n-gram: the longest known suffix and the back-off above it."""
    out = keys
    for order in range(ORDER, 0, -1):
        out = out.join(
            model.grams[order].select(F.col("key").alias(f"k{order}"), F.col("lp").alias(f"p{order}")),
            F.col(f"k{order}") == (_suffix(order) if order < ORDER else F.col("key")), "left",
        ).drop(f"k{order}")
        context = _context() if order == ORDER else F.shiftrightunsigned(_suffix(order), SYMBOL_BITS)
        out = out.join(
            model.backoffs[order].select(F.col("key").alias(f"k{order}"), F.col("lb").alias(f"b{order}")),
            F.col(f"k{order}") == context, "left",
        ).drop(f"k{order}")
    value = F.coalesce("b1", F.lit(0.0)) + F.lit(-float(np.log(len(model.alphabet) + FIRST_SYMBOL)))
    for order in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"p{order}"), (F.coalesce(f"b{order}", F.lit(0.0)) + value) if order > 1 else value)
    return out.select("key", value.alias("lp"))


def perplexities(docs: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """``keep`` columns, row_id, n_symbols and perplexity of every row of ``docs(text)``.

    The symbols of a text include its end, so a null or empty text has one. Rows that
    repeat are scored each; row_id tells them apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.alphabet, model.local))
    schema = docs.select(*keep).schema
    for name, kind in (("row_id", "long"), ("n_symbols", "long"), ("local", "double"), ("keys", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)
    scored = stored(docs.select("text", *keep).mapInArrow(_scorer(shared), schema))
    rest = scored.select("row_id", F.inline(F.arrays_zip("keys", "counts"))).withColumnRenamed("keys", "key")
    known = _resolved(rest.select("key").distinct(), model)
    sums = rest.join(known, "key").groupBy("row_id").agg(F.sum(F.col("lp") * F.col("counts")).alias("joined"))
    return scored.drop("keys", "counts").join(sums, "row_id", "left").select(
        *keep, "row_id", "n_symbols",
        F.exp(-(F.col("local") + F.coalesce("joined", F.lit(0.0))) / F.col("n_symbols")).alias("perplexity"),
    )


def _limits_of_share(counts: list, most: int | None) -> list[tuple]:
    """Per language (lang, below): trusted ids whose hash is less than ``below`` are the lower half.

    ``counts`` has lang, n and half, the middle hash. With ``most`` only that many are
    taken, shared so that only large languages are cut.
    """
    if most is None:
        return [(r["lang"], r["half"]) for r in counts]
    left, cap = most, 0.0
    order = sorted(counts, key=lambda r: r["n"])
    for i, r in enumerate(order):
        cap = left / (len(order) - i)
        if r["n"] / 2 > cap:
            break
        left -= r["n"] / 2
    share = lambda r: min(1.0, cap / r["n"]) if r["n"] / 2 > cap else 1.0
    return [(r["lang"], min(r["half"], int(share(r) * 2**48) - 2**47 if share(r) < 1 else r["half"])) for r in counts]


def fitted_share(docs: DataFrame, good: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lang) of the lower half of the trusted documents, and lang, below.

    Chosen within each language by a hash of the id; documents with a hash of ``below`` or
    more are the upper half. Of one or two documents none is in the lower half. ``most``
    bounds the lower half.
    """
    spark = docs.sparkSession
    pairs = stored(docs.select("doc_id", "lang").join(good, "doc_id", "left_semi").distinct().withColumn("hash", _fit_hash()))
    counts = pairs.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("hash", 0.5, 10_000).alias("half")).collect()
    below = spark.createDataFrame(_limits_of_share(counts, most), docs.select("lang").schema.add("below", "long"))
    chosen = pairs.join(F.broadcast(below), pairs["lang"].eqNullSafe(below["lang"])).where("hash < below")
    return chosen.select("doc_id", pairs["lang"]), below


def _fit_hash() -> Column:
    """48 bits, which the percentile's doubles hold exactly."""
    return F.shiftright(F.xxhash64("doc_id", F.lit("trusted")), 16)


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, excess, limit, kept of every row of ``docs``.

    The model is fitted on all documents that ``labels`` (doc_id, quality) calls good.
    Medians and quantiles are those of all of them too, by language: each language's are
    halved, and a half is scored by the model of the other, as a text has too low a
    perplexity where it was fitted. A language with fewer of them than the quantile needs,
    1 / (1 - quantile), has its own median and the limit of all; one without any, null
    included, has both from all. A median of few symbols varies itself, which the excess
    allows for. Unless both halves have a text all rows are kept. Null and empty texts have
    the perplexity of an end at once and are kept, as they hold nothing that is bad.
    Repeated rows get equal results; other columns of ``docs`` are not read.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    docs = docs.select("doc_id", "lang", "text")
    below = F.broadcast(fitted_share(docs, good)[1].withColumnRenamed("lang", "fit_lang"))  # one row per language
    marked = docs.join(small_side(good.withColumn("good", F.lit(True)), BROADCAST_IDS), "doc_id", "left")
    marked = marked.join(below, F.col("lang").eqNullSafe(F.col("fit_lang")), "left")
    marked = marked.select("doc_id", "lang", "text", F.when(F.col("good"), _fit_hash() >= F.col("below")).alias("upper"))
    model, lower, upper = cross_fitted(marked.where("upper is not null"))
    parts = [("upper is null", model), ("upper", lower), ("not upper", upper)]
    # One after the other: the driver plans the joins of one model at a time.
    scores = [stored(perplexities(marked.where(rows), fit, "doc_id", "lang", "upper")) for rows, fit in parts]
    scored = functools.reduce(DataFrame.unionByName, scores)
    own = scored.where("n_symbols > 1 and upper is not null").select("lang", "n_symbols", "perplexity")

    def by_language(rows: DataFrame, source: DataFrame, **values: Column) -> DataFrame:
        """Attach each of ``values`` over the language's rows of ``source``, else over all."""
        each = source.where("lang is not null").groupBy("lang").agg(*[v.alias(f"own_{k}") for k, v in values.items()])
        every = source.agg(*[v.alias(f"every_{k}") for k, v in values.items()])
        # One row per language, and one row.
        joined = rows.join(F.broadcast(each), "lang", "left").crossJoin(F.broadcast(every))
        return joined.select(*rows.columns, *[F.coalesce(f"own_{k}", f"every_{k}").alias(k) for k in values])

    # The root of n, as long as the median rests on many more symbols.
    excess = (F.log("perplexity") - F.log("median")) * F.sqrt(F.col("n_symbols") / (1 + F.col("n_symbols") / F.col("rests_on")))
    middle = {"median": F.percentile_approx("perplexity", 0.5, 10_000), "rests_on": F.sum("n_symbols")}
    scored = by_language(scored, own, **middle).withColumn("excess", excess)
    own = by_language(own, own, **middle).withColumn("excess", excess)
    limit = F.percentile_approx("excess", quantile, 10_000) * slack
    least = 1 / max(1 - quantile, 1e-9)
    enough = own.where("lang is not null").groupBy("lang").agg(F.when(F.count("*") >= least, limit).alias("own_limit"))
    held = scored.join(F.broadcast(enough), "lang", "left").crossJoin(F.broadcast(own.agg(limit.alias("every_limit"))))
    held = held.withColumn("limit", F.coalesce("own_limit", "every_limit") if lower.total and upper.total else F.lit(None).cast("double"))
    kept = F.expr("n_symbols = 1 or limit is null or excess <= limit")
    return held.select("doc_id", "lang", "n_symbols", "perplexity", "excess", "limit").withColumn("kept", kept)
