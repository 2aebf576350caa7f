"""Aggregation of keyed metric rows: by status, in pairs, over scopes, with intervals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.operators.workflow import RANGE_ROWS, ranged


def status_summary(expected: DataFrame, observed: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, n_expected, n_present, n_measured, n_missing, mean, std: values of measured rows only; sample deviation, null under two.

    expected(keys, item) says what there should be; observed(keys, item, value, status).
    """
    measured = F.col("status") == "measured"
    both = expected.join(observed, [*keys, item], "left")
    return both.groupBy(*keys).agg(F.count("*").alias("n_expected"), F.count("status").alias("n_present"), F.count_if(measured).alias("n_measured"), F.count_if(F.col("status").isNull()).alias("n_missing"), F.avg(F.when(measured, F.col("value"))).alias("mean"), F.stddev_samp(F.when(measured, F.col("value"))).alias("std"))


def scope_key(df: DataFrame, scope: Column, without: dict[str, list[str]]) -> DataFrame:
    """Columns that don't distinguish rows of a scope become null there, so these group together."""
    for name, columns in without.items():
        df = df.withColumns({c: F.when(scope != name, F.col(c)) for c in columns})
    return df


def paired_delta(rows: DataFrame, keys: list[str], condition: str, baseline: str, value: str) -> DataFrame:
    """Rows of the other conditions with base and delta against the baseline's row of the same keys; both measured."""
    seen = rows.filter(F.col(value).isNotNull())
    base = seen.filter(F.col(condition) == baseline).select(*keys, F.col(value).alias("base"))
    return seen.filter(F.col(condition) != baseline).join(base, keys).withColumn("delta", F.col(value) - F.col("base"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs; null if either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def over_scopes(df: DataFrame, scopes: dict[str, list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """scope, all scopes' columns and the aggregates for each grouping; columns that a scope doesn't group by are null."""
    columns = list(dict.fromkeys(c for cs in scopes.values() for c in cs))
    kinds = dict(df.dtypes)
    parts = []
    for name, by in scopes.items():
        out = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
        parts.append(out.select(F.lit(name).alias("scope"), *[F.col(c) if c in by else F.lit(None).cast(kinds[c]).alias(c) for c in columns], *aggregates))
    return reduce(DataFrame.unionByName, parts)


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with the average rank of value within keys, ties sharing it.

    Distinct values are sorted in ranges of about so many rows; ranks are
    running counts within a range plus the counts of the group's ranges before,
    so no task has a whole group, however large.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    placed = ranged(counts, [*keys, value], rows)
    sums = placed.groupBy(*keys, "_range").agg(F.sum("n").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    inside = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, cols: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in cols]
    ranks = placed.withColumn("inside", inside).alias("x").join(before.alias("y"), same("x", "y", [*keys, "_range"])).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col(f"x.{value}").alias(value), (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias(out))
    return df.alias("d").join(ranks.alias("k"), same("d", "k", [*keys, value])).select("d.*", F.col(f"k.{out}"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: Pearson correlation of average ranks within each group."""
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(average_rank(complete, keys, x, "rank_x"), keys, y, "rank_y")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("rank_x"), F.col("rank_y")).alias("rho"))


def delta_correlation(rows: DataFrame, keys: list[str], condition: str, baseline: str, x: str, y: str) -> DataFrame:
    """condition, n, r, rho: Pearson and Spearman correlation of the paired deltas of x and of y against the baseline, over the keys that have both."""
    a, b = (paired_delta(rows, keys, condition, baseline, v).select(*keys, condition, F.col("delta").alias(d)) for v, d in ((x, "_dx"), (y, "_dy")))
    both = a.join(b, [*keys, condition])
    linear = both.groupBy(condition).agg(F.count("*").alias("n"), pearson(F.col("_dx"), F.col("_dy")).alias("r"))
    return linear.join(spearman(both, [condition], "_dx", "_dy").select(condition, "rho"), condition, "left")


#: Rows whose weights are drawn at once and replicates they are drawn for, so that a tile stays in a core's cache.
TILE_ROWS, TILE_REPLICATES = 32, 2_500
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(range(1, i + 1) or [1])) for i in range(12)])


def _by_leading_bits() -> np.ndarray:
    """The Poisson weight that the first 16 of a hash's bits decide; 255 where they leave it open."""
    least = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    low, high = (np.searchsorted(_POISSON, (z >> np.uint64(11)) / float(1 << 53)) for z in (least, least | np.uint64((1 << 48) - 1)))
    return np.where(low == high, low, 255).astype(np.uint8)


def poisson_weights(hashes: np.ndarray, first: int, n: int) -> np.ndarray:
    """A weight for each hash and each of n replicates from the first on: 53 bits of hash and replicate, mixed, looked up in the distribution. Nearly all are known by 16 bits."""
    z = hashes[:, None] + (np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    shifted = np.empty_like(z)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(z, np.uint64(shift), out=shifted)
        np.bitwise_xor(z, shifted, out=z)
        np.multiply(z, np.uint64(by), out=z)
    w = _LEADING[np.right_shift(z, np.uint64(48), out=shifted).view(np.int64)]  # the last step leaves the first 31 bits as they are
    at = np.flatnonzero(w.ravel() == 255)
    left = z.ravel()[at]
    w.ravel()[at] = np.searchsorted(_POISSON, ((left ^ (left >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
    return w


_LEADING = _by_leading_bits()


def bootstrap_mean(df: DataFrame, keys: list[str], id_column: str, value: str, replicates: int = 10_000, seed: int = 20260823) -> DataFrame:
    """keys, n, mean, low, high: 95 % interval of the mean from a Poisson bootstrap.

    A row's weight in each replicate comes from the hash of its id, so tasks sum
    their own rows for all replicates and only the sums meet; a lost task gives
    the same weights again. Rows of one id, in several groups, share the
    weights, which are drawn once for them. For large groups this equals
    resampling rows.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    given = df.filter(F.col(value).isNotNull()).select(F.to_json(group).alias("g"), F.xxhash64(id_column, F.lit(seed)).alias("h"), F.col(value).cast("double").alias("x"))
    schema = pa.schema([("g", pa.string()), ("replicate", pa.int32()), ("w", pa.float64()), ("wx", pa.float64())])

    def over(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            hashes, of = np.unique(batch.column(1).to_numpy().view(np.uint64), return_inverse=True)
            order = np.argsort(of, kind="stable")
            of, code, x = of[order], code[order], batch.column(2).to_numpy()[order]
            for g in names:
                if g not in sums:
                    sums[g] = np.zeros((2, replicates))
            for i in range(0, len(hashes), TILE_ROWS):
                rows = slice(*np.searchsorted(of, [i, i + TILE_ROWS]))
                present, at = np.unique(code[rows], return_inverse=True)
                parts = np.zeros((2, len(present), min(TILE_ROWS, len(hashes) - i)))  # of each group and hash: rows, and the sum of their values
                np.add.at(parts[0], (at, of[rows] - i), 1.0)
                np.add.at(parts[1], (at, of[rows] - i), x[rows])
                parts = parts.reshape(-1, parts.shape[2])
                for start in range(0, replicates, TILE_REPLICATES):
                    end = min(replicates, start + TILE_REPLICATES)
                    s = (parts @ poisson_weights(hashes[i : i + TILE_ROWS], start, end - start).astype(np.float64)).reshape(2, len(present), -1)
                    for j, g in enumerate(present.tolist()):
                        sums[names[g]][:, start:end] += s[:, j]
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * replicates), pa.array(range(replicates), pa.int32()), pa.array(s[0]), pa.array(s[1])], schema=schema)

    # few bytes a row and much work: dealt to all cores
    dealt = given.repartition(df.sparkSession.sparkContext.defaultParallelism, "h").sortWithinPartitions("h")
    each = dealt.mapInArrow(over, "g string, replicate int, w double, wx double").groupBy("g", "replicate").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    interval = each.groupBy("g").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    plain = df.filter(F.col(value).isNotNull()).groupBy(F.to_json(group).alias("g"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return plain.join(interval, "g").select(*keys, "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "improvement").when(high < 0, "degradation").otherwise("uncertain")


def crosstab(df: DataFrame, keys: list[str], status: str, domain: list[str]) -> DataFrame:
    """Counts of each status of a fixed domain in its own column; 0 where there are none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(s) for s in domain])


def describe(value: str) -> list[Column]:
    """count, mean, sample deviation, least, quartiles and largest."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max")]
