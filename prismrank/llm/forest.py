"""Approximate nearest neighbours by a forest of hash-prefix trees.

A tree is a sorted array of long hash strings, one bit for the side of each of
its random hyperplanes on which a vector lies. A query descends in every tree to
the longest prefix that any vector shares with it; then all trees ascend
together, bit by bit, and gather the vectors under each prefix until there are
enough candidates. These are ranked by exact inner product.

The rows are dealt to shards of bounded size, each with a forest of its own. A
task reads a shard's rows, builds the forest once and then lets the queries
stream past it in batches; the best of all shards are merged. A shard's forest
gathers a share of its rows, not a fixed number, so recall doesn't fall as
shards grow, and some for each neighbour, so it doesn't where they are small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.llm.common import in_batches

#: Rows of a shard, about.
SHARD_ROWS = 20_000
TREES, BITS, TABLE_BITS = 64, 32, 12
#: Candidates that a query gathers from a shard, counted in every tree that gives them: this share of its rows and so many more for each neighbour sought.
SHARE, EACH = 0.8, 15


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 1):
        self.vectors, self.bits = vectors, bits
        self.tables: dict[int, np.ndarray] = {}
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        keys = self.keys(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=1)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings by tree and vector."""
        side = (vectors.astype(np.float32) @ self.planes > 0).reshape(len(vectors), -1, self.bits)
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([side[:, t].astype(np.uint64) @ weight for t in range(side.shape[1])])

    def longest(self, keys: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each query shares with any vector of each tree."""
        out = np.zeros(keys.shape, np.int64)
        for t, (have, want) in enumerate(zip(self.sorted, keys, strict=True)):
            at = np.searchsorted(have, want)
            near = np.minimum(want ^ have[np.maximum(at - 1, 0)], want ^ have[np.minimum(at, len(have) - 1)])
            out[t] = self.bits - np.ceil(np.log2(near.astype(np.float64) + 1)).astype(np.int64)
        return out

    def ranges(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the vectors with the query's prefix of that length lie in each tree's array."""
        if length <= TABLE_BITS:  # by a table of where each prefix begins
            shift = np.uint64(self.bits - length)
            if length not in self.tables:
                self.tables[length] = np.stack([np.searchsorted(have >> shift, np.arange((1 << length) + 1, dtype=np.uint64)) for have in self.sorted])
            prefix = (keys >> shift).astype(np.int64)
            table = self.tables[length]
            return np.take_along_axis(table, prefix, 1), np.take_along_axis(table, prefix + 1, 1)
        rest = np.uint64((1 << (self.bits - length)) - 1)
        low = np.stack([np.searchsorted(have, want) for have, want in zip(self.sorted, keys & ~rest, strict=True)])
        return low, np.stack([np.searchsorted(have, want, "right") for have, want in zip(self.sorted, keys | rest, strict=True)])

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query, in turn, the rows found when the ascending trees have given at least enough (those of several trees counted in each)."""
        keys = self.keys(queries)
        low, high = np.zeros(keys.shape, np.int64), np.zeros(keys.shape, np.int64)
        todo = np.arange(len(queries))
        a, b = self.ranges(keys, TABLE_BITS)
        full = (b - a).sum(0) >= enough  # these have enough further down
        length = int(self.longest(keys[:, full]).max(initial=TABLE_BITS)) if full.any() else TABLE_BITS
        at = todo[full] if length > TABLE_BITS else todo
        while len(todo):
            a, b = self.ranges(keys[:, at], length)
            size, were = b - a, (high - low)[:, at]
            # at the last step the trees ascend one by one until there are enough
            reached = were.sum(0) + np.cumsum(size - were, 0)
            ascends = np.vstack([np.full((1, len(at)), True), reached[:-1] < enough]) if length else np.full(size.shape, True)
            low[:, at], high[:, at] = np.where(ascends, a, low[:, at]), np.where(ascends, b, high[:, at])
            done = (reached[-1] >= enough) | (length == 0)
            todo = np.setdiff1d(todo, at[done], assume_unique=True)
            length -= 1
            at = at[~done] if length > TABLE_BITS else todo
        for q in range(len(queries)):
            chosen = np.zeros(len(self.vectors), bool)
            chosen[np.concatenate([order[a:b] for order, a, b in zip(self.order, low[:, q], high[:, q], strict=True)])] = True
            yield np.flatnonzero(chosen)


def _usable(v: Column) -> Column:
    """Not null or zero, with finite parts only."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors(vec_id, embedding) with the largest inner product with each of queries(vec_id, embedding), but the query's own.

    Ties go to the smaller vec_id. Vectors that are null, zero or have null or
    non-finite parts take no part, nor do null ids; only vectors of as many parts
    as the query's are near it. Repeated rows are found each; a query's id that
    several rows have is one query, of the least vector. Other columns are
    ignored; no rows or no queries give no rows.
    """
    rows, wanted = [df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(_usable(F.col("v")) & F.col("vec_id").isNotNull()) for df in (vectors, queries)]
    shards = math.ceil(rows.count() / SHARD_ROWS) or 1
    deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")  # rows of one id are dealt, too
    cells = rows.select("vec_id", "v", F.lit(False).alias("asks"), deal.alias("shard")).unionAll(
        wanted.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))
    order = ["shard", "parts", "asks", "vec_id"]

    def answers(forest: Forest, have_ids: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        out = []
        for i, near in enumerate(forest.candidates(q, math.ceil(share * len(have_ids)) + EACH * k)):
            near = near[have_ids[near] != q_ids[i]]
            score = forest.vectors[near] @ q[i]
            best = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
            best = best[np.lexsort((have_ids[near[best]], -score[best]))][:k]
            out.append((np.full(len(best), q_ids[i]), have_ids[near[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None  # the shard in hand, its rows, and its forest once queries come
        for batch in batches:
            ids, asks = batch.column("vec_id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            key = np.stack([batch.column("shard").to_numpy(), batch.column("parts").to_numpy(), asks])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=False):
                if (shard := tuple(key[:2, a])) != now:
                    now, held, forest = shard, [], None
                v = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not asks[a]:
                    held.append((ids[a:b], v))
                elif held:
                    if forest is None:
                        have_ids, have = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
                        forest = Forest(have, trees)
                    yield answers(forest, have_ids, ids[a:b], v)

    dealt = cells.withColumn("parts", F.size("v")).repartition(shards, "shard").sortWithinPartitions(*order).select(*order, "v").transform(in_batches)
    best = dealt.mapInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
