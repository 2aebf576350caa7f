"""Ranking a corpus for queries: sparse, dense and late-interaction."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.operators import postings

#: Rows and bytes of a corpus shard, and rows of a query block, that meet in one task.
SHARD_ROWS, SHARD_BYTES, BLOCK_QUERIES = 50_000, 1 << 26, 2_048


def top_k(scored: DataFrame, k: int, tie: str) -> DataFrame:
    """Rows of the k best scores of each query_id, with rank from 1; ties by the column given."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _sound(df: DataFrame, key: str) -> DataFrame:
    """Rows with an id and a vector without null parts."""
    return df.filter(F.col(key).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def _n_shards(corpus: DataFrame) -> int:
    """Shards of bounded rows and, as vectors may be wide, bounded bytes."""
    seen = corpus.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    return max(1, math.ceil(seen["n"] / min(SHARD_ROWS, max(1, SHARD_BYTES // (8 * (seen["width"] or 1))))))


def dense(corpus: DataFrame, queries: DataFrame, k: int, cosine: bool = False, keep_self: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score: exact inner product, or cosine, of corpus(doc_id, v) and queries(query_id, v).

    Shards of the corpus meet blocks of the queries, each pair in one task, by
    one matrix product and a local top k; only k rows a query leave a task.
    Vectors have one width; rows without id or vector, or with a null part, are
    left out.
    """
    corpus, queries = _sound(corpus, "doc_id"), _sound(queries, "query_id")
    shards, blocks = _n_shards(corpus), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    docs = corpus.select(F.col("doc_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(False).alias("asks"), deal("doc_id", shards).alias("shard"), every(blocks).alias("block"))
    asks = queries.select(F.col("query_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(True).alias("asks"), every(shards).alias("shard"), deal("query_id", blocks).alias("block"))

    def cell(t: pa.Table) -> pa.Table:
        is_query, ids = t["asks"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if cosine:
            length = np.linalg.norm(v, axis=1)
            v, ids, is_query = v[length > 0] / length[length > 0, None], ids[length > 0], is_query[length > 0]
        d, d_ids, q, q_ids = v[~is_query], ids[~is_query], v[is_query], ids[is_query]
        order = np.argsort(d_ids, kind="stable")
        d, d_ids = d[order], d_ids[order]
        out: list[tuple] = []
        for i in range(0, len(q), 256):
            for s, qid in zip(q[i : i + 256] @ d.T, q_ids[i : i + 256], strict=True):
                if not keep_self:
                    s = np.where(d_ids == qid, -np.inf, s)
                best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                best = best[np.lexsort((d_ids[best], -s[best]))][:k]
                best = best[s[best] > -np.inf]
                out.append((np.full(len(best), qid), d_ids[best], s[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    found = docs.unionAll(asks).groupBy("shard", "block").applyInArrow(cell, "query_id long, doc_id long, score double")
    return top_k(found, k, "doc_id").select("query_id", "rank", "doc_id", "score")


def max_sim(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Late interaction: corpus(doc_id, v) and queries(query_id, v) have a row for each token vector. A document's score sums, over the query's tokens, the best inner product with any of its tokens.

    Shards hold whole documents, so the maxima are taken where the matrix
    product is, and only k rows a query leave a task. Rows without id or vector,
    or with a null part, are left out.
    """
    corpus, queries = _sound(corpus, "doc_id"), _sound(queries, "query_id")
    shards, blocks = _n_shards(corpus), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    docs = corpus.select(F.col("doc_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(False).alias("asks"), deal("doc_id", shards).alias("shard"), every(blocks).alias("block"))
    asks = queries.select(F.col("query_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(True).alias("asks"), every(shards).alias("shard"), deal("query_id", blocks).alias("block"))

    def cell(t: pa.Table) -> pa.Table:
        is_query, ids = t["asks"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if is_query.all() or not is_query.any():
            return schema.empty_table()
        order = np.argsort(ids, kind="stable")
        v, ids, is_query = v[order], ids[order], is_query[order]
        d, d_ids = v[~is_query], ids[~is_query]
        of, starts = np.unique(d_ids, return_index=True)
        out = []
        for qid in np.unique(ids[is_query]):
            best = np.maximum.reduceat(v[is_query & (ids == qid)] @ d.T, starts, axis=1).sum(0)
            near = np.lexsort((of, -best))[:k]
            out.append((np.full(len(near), qid), of[near], best[near]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    found = docs.unionAll(asks).groupBy("shard", "block").applyInArrow(cell, "query_id long, doc_id long, score double")
    return top_k(found, k, "doc_id").select("query_id", "rank", "doc_id", "score")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, rank, doc_id, score of corpus(doc_id, text) for queries(query_id, text) by Okapi BM25, over an index that is written for it.

    Negative inverse document frequencies become epsilon times the mean over
    all terms. Repeated query words count again. Documents without any query
    word score 0, before negative scores, in the order of doc_id.
    """
    return postings.search(postings.build(corpus, k1, b, epsilon), queries, k)


def hash_ranked_sample(df: DataFrame, id_column: str, namespace: str, n: int) -> DataFrame:
    """The n rows of the smallest sha256 of "namespace|id"."""
    return df.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(namespace), F.col(id_column).cast("string")), 256)).orderBy("digest", id_column).limit(n)


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "dense": dense, "cosine": lambda c, q, k: dense(c, q, k, cosine=True)}


def retriever(name: str) -> Callable[..., DataFrame]:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever: {name}")
    return RETRIEVERS[name]
