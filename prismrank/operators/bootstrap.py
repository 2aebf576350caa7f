"""An exact bootstrap of means: every replicate draws as many rows as there are, with replacement, from counters.

Rows are dealt to blocks by the hash of their id. For each replicate the draws that
fall to each block are counted first, which needs the blocks' sizes only; then each
block draws its rows by itself. Which row a draw takes follows from its replicate,
block and number alone, so a lost task gives the same draws again, and SQL can
repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prismrank.sources.files import kept

#: Rows of a block, about; draws that are counted at once.
BLOCK_ROWS, DRAWS = 1 << 16, 1 << 20
#: Of the counters' mixing (fixed values), and where the counters of the two kinds of draws start.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
OF_REPLICATE, OF_BLOCK = 0xD1342543DE82EF95, 0xDA942042E4DD58B5
TO_BLOCKS, IN_BLOCK = 1, 2


def mixed(kind: int, replicate: int, block: int, counter: np.ndarray) -> np.ndarray:
    """64 bits for each counter."""
    start = (kind * SECOND + replicate * OF_REPLICATE + block * OF_BLOCK) % 2**64
    z = np.uint64(start) + counter.astype(np.uint64) * np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


_WRAP = "18446744073709551616::UHUGEINT"


def sql_mixed(rows: str, kind: int, replicate: str, block: str, counter: str) -> str:
    """SQL of `rows`, a relation, with column z: mixed() of its columns."""
    times = lambda x, by: f"(({x})::UHUGEINT * {by}::UHUGEINT % {_WRAP})"
    start = f"((({times(kind, SECOND)} + {times(block, OF_BLOCK)} + {times(replicate, OF_REPLICATE)} + {times(counter, GAMMA)}) % {_WRAP})::UBIGINT)"
    steps = f"SELECT *, {start} AS z0 FROM {rows}"
    steps = f"SELECT *, {times('xor(z0, z0 >> 30)', FIRST)}::UBIGINT AS z1 FROM ({steps})"
    steps = f"SELECT *, {times('xor(z1, z1 >> 27)', SECOND)}::UBIGINT AS z2 FROM ({steps})"
    return f"SELECT * EXCLUDE (z0, z1, z2), xor(z2, z2 >> 31) AS z FROM ({steps})"


def _blocks(df: DataFrame, keys: list[str], id_column: str, value: str, rows: int) -> DataFrame:
    """keys, n, block, size, before, values: each block's values in the order of ids, and how many rows are in the blocks before it."""
    given = df.filter(F.col(value).isNotNull() & F.col(id_column).isNotNull()).select(*keys, F.col(id_column).alias("_id"), F.col(value).cast("double").alias("_x"))
    n = given.groupBy(*keys).agg(F.count("*").alias("n"))
    h = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 15), 16, 10).cast("long")
    on = _same("l", "r", keys)
    blocks = given.alias("l").join(n.alias("r"), on).select(*[F.col(f"l.{k}") for k in keys], "n", "_id", "_x", F.pmod(h, F.ceil(F.col("n") / rows)).alias("block"))
    held = blocks.groupBy(*keys, "n", "block").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("_id", "_x"))), lambda r: r["_x"]).alias("values"))
    before = F.sum("size").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = held.select(*keys, "block", "size").withColumn("before", F.coalesce(before, F.lit(0)))  # a row a block
    return held.drop("size").alias("l").join(sizes.alias("r"), _same("l", "r", [*keys, "block"])).select(*[F.col(f"l.{k}") for k in keys], "n", "l.block", "size", "before", "values")


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equal columns, nulls too; true without any."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _dealt(blocks: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """keys, block, counts: how many draws of each replicate fall to the block. A group of one block has all of them."""
    groups = blocks.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("block", "before"))).alias("b"))
    groups = groups.select(*keys, "n", F.transform("b", lambda x: x["block"]).alias("blocks"), F.transform("b", lambda x: x["before"]).alias("starts"))
    work = groups.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))))
    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("block", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType()))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, numbers, starts, start = (row.column(len(keys) + j).to_pylist()[0] for j in range(4))
                counters, starts = np.arange(start, min(n, start + DRAWS)), np.array(starts)
                if len(numbers) == 1:
                    counts = np.full((replicates, 1), len(counters))
                else:
                    counts = np.stack([np.bincount(np.searchsorted(starts, mixed(TO_BLOCKS, r, 0, counters) % np.uint64(n), side="right") - 1, minlength=len(starts)) for r in range(replicates)])
                same = [row.column(j).take(pa.array(np.zeros(len(numbers), np.int64))) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int64()), pa.array(counts.T.tolist(), pa.list_(pa.int64()))], names=schema.names)

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = work.select(*keys, "n", "blocks", "starts", "from").repartition(cores).mapInArrow(over, schema)
    added = F.aggregate(F.collect_list("counts"), F.array_repeat(F.lit(0).cast("long"), replicates), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return parts.groupBy(*keys, "block").agg(added.alias("counts"))


def bootstrap_exact(df: DataFrame, keys: list[str], id_column: str, value: str, replicates: int = 10_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, n, mean, low, high: the 95 % interval of the mean of each group by resampling rows, n draws a replicate.

    Rows without value or id are left out; ids should be unique in a group.
    Null keys are a group. The same ids give the same draws.
    """
    blocks = kept(_blocks(df, keys, id_column, value, block_rows), "blocks")
    draws = _dealt(blocks.drop("values"), keys, replicates)
    both = blocks.alias("l").join(draws.alias("r"), _same("l", "r", [*keys, "block"])).select(*[F.col(f"l.{k}") for k in keys], "l.block", "values", "counts")
    part = max(1, replicates // 16)
    each = both.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(part))))
    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("from", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys)
        for batch in batches:
            sums = []
            for i in range(batch.num_rows):
                block, x, counts, start = batch.column(at)[i].as_py(), batch.column(at + 1)[i].values.to_numpy(), batch.column(at + 2)[i].values.to_numpy(), batch.column(at + 3)[i].as_py()
                sums.append([float(x[(mixed(IN_BLOCK, r, block, np.arange(counts[r])) % np.uint64(len(x))).astype(np.int64)].sum()) for r in range(start, min(replicates, start + part))])
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(at)], batch.column(at + 3), pa.array(sums, pa.list_(pa.float64()))], names=schema.names)

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    sums = each.select(*keys, "block", "values", "counts", "from").repartition(4 * cores).mapInArrow(over, schema)
    totals = sums.select(*keys, (F.col("from")).alias("from"), F.posexplode("sums").alias("at", "x")).groupBy(*keys, "from", "at").agg(F.sum("x").alias("x"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    n = blocks.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.aggregate("values", F.lit(0.0), lambda a, b: a + b)) / F.max("n")).alias("mean"))
    intervals = totals.alias("l").join(n.alias("r"), _same("l", "r", keys)).select(*[F.col(f"l.{k}") for k in keys], "n", "mean", (F.col("x") / F.col("n")).alias("m")).groupBy(*keys, "n", "mean").agg(p.alias("p"))
    return intervals.select(*keys, "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
