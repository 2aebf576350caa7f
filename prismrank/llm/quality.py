"""Quality rules: robust multivariate outliers within each language and source.

Every document becomes a vector of transformed statistics. Each group's centre
and scatter are minimum-covariance-determinant estimates, found as in the
deterministic algorithm: from several starts, concentration steps over all rows
until none lessens a determinant, each keeping the part of the group nearest by
Mahalanobis distance; of the starts the one of least determinant counts. A step
is two aggregations with partial sums, so a group of any size
is spread over all tasks and only its moments meet. Far documents are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, join_params, map_batches, materialize, text_of

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_SYMBOL = str.maketrans("", "", "#*$%&|<>")

#: What the vector's parts vary by without meaning anything; added to each scatter. Those of the shares let each
#: of them alone reach the cutoff: about 0.6 of the lines or 0.45 of the words, where a group has none.
FLOORS = {"size": 0.7, "word_length": 0.25, "symbols": 0.12, "dup_lines": 0.16, "repeats": 0.14, "line_length": 0.6}
PARTS = tuple(FLOORS)
P = len(PARTS)
#: Of chi-square with as many degrees of freedom as parts: the 0.999 quantile and the median.
CUTOFF, MEDIAN = 22.458, 5.348
#: Groups with fewer usable rows are pooled by language.
LEAST = 60
#: Starts of the concentration steps, the fall of a log determinant that still counts, and the most steps.
STARTS, FALL, MOST_STEPS = ("deviations", "floors", "bounded"), 1e-3, 30
#: Rows of the estimates' table up to which it is broadcast (under 400 bytes each).
BROADCAST_GROUPS = 20_000


def _statistics(text: str) -> tuple:
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(_NOT_SYMBOL))
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    vector = [np.log1p(n), np.log(chars / n), np.sqrt(symbols / n), np.sqrt(dup_lines / len(lines)), np.sqrt(repeated / n), np.log(n / len(lines))] if n else [0.0] * P
    return n, chars, symbols, dup_lines, repeated, n < 50 or 100 * repeated > 50 * n, vector


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the contract's counts, base_failed and the vector of each document. Null texts are empty."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "vector"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.float64())]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *zip(names, types, strict=True)])

    def one(batch: pa.RecordBatch) -> dict:
        columns = zip(*map(_statistics, batch.column(3).to_pylist()), strict=True) if batch.num_rows else [[]] * len(names)
        return {"doc_id": batch.column(0), "lang": batch.column(1), "source": batch.column(2)} | dict(zip(names, map(list, columns), strict=True))

    given = docs.select(F.col("doc_id").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_of().alias("text"))
    return given.transform(in_batches).mapInArrow(map_batches(one, schema), "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, vector array<double>")


GROUP = ["lang", "pool"]
TRIAL = [*GROUP, "start"]


def _with(rows: DataFrame, params: DataFrame, how: str = "inner", keys: list[str] = GROUP) -> DataFrame:
    return join_params(rows, params, keys, "doc_id", BROADCAST_GROUPS, how)


def _distance() -> Column:
    """Squared Mahalanobis distance of vector from mean by the flat inverse scatter."""
    off = [F.col("vector")[i] - F.col("mean")[i] for i in range(P)]
    return sum((F.col("inverse")[i * P + j] * off[i] * off[j] * (1 if i == j else 2) for i, j in combinations_with_replacement(range(P), 2)), F.lit(0.0))


_ESTIMATE = pa.schema([("lang", pa.string()), ("pool", pa.string()), ("start", pa.string()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64())])
_ESTIMATE_DDL = "lang string, pool string, start string, mean array<double>, inverse array<double>, logdet double"


def _moments(rows: DataFrame) -> DataFrame:
    parts = [F.col("vector")[i] for i in range(P)]
    return rows.groupBy(TRIAL).agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in parts]).alias("sums"), F.array(*[F.sum(parts[i] * parts[j]) for i, j in combinations_with_replacement(range(P), 2)]).alias("products"))


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre, inverse scatter and the scatter's log determinant, floors included, from n, sums and products of each group and start."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mean = np.array(r["sums"]) / r["n"]
                scatter = np.zeros((P, P))
                for (i, j), s in zip(combinations_with_replacement(range(P), 2), r["products"], strict=True):
                    scatter[i, j] = scatter[j, i] = s / r["n"] - mean[i] * mean[j]
                scatter += np.diag(np.square(list(FLOORS.values())))
                rows.append({k: r[k] for k in TRIAL} | {"mean": mean.tolist(), "inverse": np.linalg.inv(scatter).ravel().tolist(), "logdet": float(np.linalg.slogdet(scatter)[1])})
            yield pa.RecordBatch.from_pylist(rows, schema=_ESTIMATE)

    return moments.mapInArrow(over, _ESTIMATE_DDL)


def _starts(rows: DataFrame, starts: tuple[str, ...]) -> DataFrame:
    """Medians with deviations, medians with the floors alone, and moments of the rows drawn in towards the medians."""
    parts = [F.col("vector")[i] for i in range(P)]
    floors = list(FLOORS.values())
    medians = materialize(rows.groupBy(GROUP).agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in parts]).alias("mean")), "medians")
    mads = [F.percentile_approx(F.abs(x - F.col("mean")[i]), 0.5, 1000) for i, x in enumerate(parts)]
    spread = materialize(_with(rows, medians).groupBy(GROUP).agg(F.first("mean").alias("mean"), F.array(*[F.sqrt(F.pow(1.4826 * m, F.lit(2.0)) + floors[i] ** 2) for i, m in enumerate(mads)]).alias("spread")), "spread")

    def diagonal(start: str, by: list[Column]) -> DataFrame:
        inverse = F.array(*[1.0 / (by[i] * by[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
        return spread.select(*GROUP, F.lit(start).alias("start"), "mean", inverse.alias("inverse"), F.lit(float("inf")).alias("logdet"))

    drawn = F.array(*[F.col("mean")[i] + F.col("spread")[i] * F.tanh((x - F.col("mean")[i]) / F.col("spread")[i]) for i, x in enumerate(parts)])
    given = {
        "deviations": lambda: diagonal("deviations", [F.col("spread")[i] for i in range(P)]),
        "floors": lambda: diagonal("floors", [F.lit(f) for f in floors]),
        "bounded": lambda: _estimates(_moments(_with(rows, spread).select(*GROUP, F.lit("bounded").alias("start"), drawn.alias("vector")))).withColumn("logdet", F.lit(float("inf"))),
    }
    return materialize(reduce(DataFrame.unionByName, [given[k]() for k in starts]), "start")


def robust_estimates(rows: DataFrame, share: float = 0.75, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """Estimates by (lang, pool) of rows(lang, pool, doc_id, vector), of the start that ends with the least determinant, and the scale that brings their median distance to its nominal value."""
    params = _starts(rows, starts)
    tried = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in starts])))
    for step in range(MOST_STEPS):
        near = _with(tried, params.select(*TRIAL, "mean", "inverse"), keys=TRIAL).select(*TRIAL, "doc_id", "vector", _distance().alias("d"))
        limit = materialize(near.groupBy(TRIAL).agg(F.percentile_approx("d", share, 2000).alias("limit")), "limit")
        before = params.select(*TRIAL, F.col("logdet").alias("least"))
        now = _estimates(_moments(_with(near, limit, keys=TRIAL).filter("d <= limit"))).join(before, TRIAL)
        # the limits are approximate: what counts is a fall under the least so far
        params = materialize(now.withColumn("fall", F.col("least") - F.col("logdet")).withColumn("logdet", F.least("least", "logdet")).drop("least"), f"step{step}")
        if (params.agg(F.max("fall")).first()[0] or 0.0) <= FALL:
            break
    best = materialize(params.groupBy(GROUP).agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("best")).select(*GROUP, "best.*"), "best")
    scale = _with(rows, best).groupBy(GROUP).agg(F.greatest(F.lit(1.0), F.percentile_approx(_distance(), 0.5, 2000) / MEDIAN).alias("scale"))
    return materialize(best.join(scale, GROUP), "estimates")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, base_failed, distance and kept of every document(doc_id, lang, source, text, ...).

    Null lang or source count as empty, null text as no words, which fails the
    base rules. Estimates come from all rows that pass these; a group with fewer
    than LEAST of them is judged by its language's pool. Repeated rows count
    each; other columns are ignored; an empty table gives no rows.
    """
    stats = materialize(statistics(docs), "statistics")
    usable = stats.filter(~F.col("base_failed"))
    sizes = materialize(usable.groupBy("lang", "source").count().select("lang", F.col("source").alias("pool"), F.when(F.col("count") >= LEAST, F.concat(F.lit("="), F.col("source"))).otherwise("*").alias("to")), "pools")
    pooled = _with(stats.withColumn("pool", F.col("source")), sizes, "left").withColumn("pool", F.coalesce("to", F.lit("*"))).drop("to")
    params = robust_estimates(pooled.filter(~F.col("base_failed")).select("lang", "pool", "doc_id", "vector"))
    distance = _distance() / F.col("scale")
    return _with(pooled, params.drop("logdet"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(distance, F.lit(0.0)).alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
    )
