"""Approximate late interaction: centroids, their inverted lists, 2-bit residuals, and exact scores of the best.

Centroids are fitted on a bounded sample of the token vectors. Every token is kept
as the number of its nearest centroid and two bits a dimension of what is left. A
query's tokens each probe their nearest cells; documents with a token there are
scored from the codes, and the best of them from the vectors themselves. So a
search reads the lists of the probed cells, the codes of the documents in them and
the vectors of a bounded number of documents a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.operators.postings import best
from prismrank.sources.files import kept

#: Token vectors, by hash, that centroids and residual cuts are fitted on; steps of the fit; the most centroids.
SAMPLE_ROWS, STEPS, MOST_CENTROIDS = 20_000, 8, 4_096
#: Cells probed for each token of a query, and documents of a query that are scored exactly, as many times k.
CELLS, EXACT_TIMES = 4, 6


@dataclass(frozen=True)
class LateIndex:
    """lists(cell, doc_id) and codes(doc_id, cells, residuals), the tokens of a document in one row; centroids, cuts and levels are bounded by the fit's parameters."""

    vectors: DataFrame
    lists: DataFrame
    codes: DataFrame
    centroids: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as a matrix; flattened lists may be nested."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def nearest(v: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n centroids of the largest inner product with each row; fewer if there are fewer."""
    n = min(n, len(centroids))
    near = v @ centroids.T
    return np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(len(centroids)), (len(v), 1))


def fit(v: np.ndarray, n_centroids: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit centroids of the rows by spherical k-means from evenly spaced rows, and the cuts and mean levels of four classes of residual parts, as many parts in each."""
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centroids = unit[np.linspace(0, len(v) - 1, n_centroids).astype(int)].copy()
    for _ in range(steps):
        of = nearest(unit, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, unit)
        length = np.linalg.norm(sums, axis=1)
        centroids[length > 0] = sums[length > 0] / length[length > 0, None]
    left = np.sort((v - centroids[nearest(v, centroids)[:, 0]]).ravel())
    cuts = left[[len(left) // 4, len(left) // 2, 3 * len(left) // 4]]
    return centroids, cuts, np.array([x.mean() if len(x) else 0.0 for x in np.array_split(left, 4)])


def encode(v: np.ndarray, centroids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and its residual as two bits a part, four parts a byte."""
    cell = nearest(v, centroids)[:, 0]
    two = np.searchsorted(cuts, v - centroids[cell], side="right").astype(np.uint8)
    two = np.pad(two, ((0, 0), (0, -two.shape[1] % 4)))
    return cell, two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6


def decode(cell: np.ndarray, packed: np.ndarray, centroids: np.ndarray, levels: np.ndarray) -> np.ndarray:
    two = np.stack([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=2).reshape(len(packed), -1)
    return centroids[cell] + levels[two[:, : centroids.shape[1]]]


def build(corpus: DataFrame, n_centroids: int | None = None) -> LateIndex:
    """The index of corpus(doc_id, v), a row for each token vector, written once. Rows without doc_id, without vector or with a null part are left out; vectors have one width."""
    rows = corpus.filter("doc_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v"))
    order = F.xxhash64("doc_id", "v")
    sample = rows.orderBy(order).limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        none = rows.sparkSession.createDataFrame([], "cell int, doc_id long")
        return LateIndex(rows, none, rows.sparkSession.createDataFrame([], "doc_id long, cells array<int>, residuals binary"), np.zeros((0, 1)), np.zeros(3), np.zeros(4))
    if n_centroids is None:
        n_centroids = 1 << int(np.ceil(np.log2(2 * np.sqrt(rows.count()))))
    centroids, cuts, levels = fit(matrix(sample, len(sample[0])), min(n_centroids, MOST_CENTROIDS, len(sample)))
    width = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((centroids, cuts))
    schema = pa.schema([("doc_id", pa.int64()), ("cells", pa.list_(pa.int32())), ("residuals", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).value_lengths().to_numpy()
            cell, packed = encode(matrix(batch.column(1), width), *shared.value)
            ends = np.cumsum(size)
            codes = pa.array([packed[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary())
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, codes], schema=schema)

    docs = rows.groupBy("doc_id").agg(F.collect_list("v").alias("vs"))  # a document's tokens, which are one row in the end
    codes = kept(docs.mapInArrow(over, "doc_id long, cells array<int>, residuals binary"), "codes")
    lists = kept(codes.select("doc_id", F.explode(F.array_distinct("cells")).alias("cell")).select("cell", "doc_id").repartition("cell").sortWithinPartitions("cell"), "cells")
    return LateIndex(rows, lists, codes, centroids, cuts, levels)


def candidates(index: LateIndex, queries: DataFrame, cells: int = CELLS) -> DataFrame:
    """query_id, doc_id: documents with a token in one of the cells that the query's tokens probe."""
    centroids, width = index.centroids, index.centroids.shape[1]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(matrix(batch.column(1), width), centroids, cells)
                ids = np.repeat(batch.column(0).to_numpy(), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near.ravel(), pa.int32())], ["query_id", "cell"])

    probes = queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(over, "query_id long, cell int").distinct()
    return probes.join(index.lists, "cell").select("query_id", "doc_id").distinct()


def _pair_scores(pairs: DataFrame, index: LateIndex, coded: bool) -> DataFrame:
    """query_id, doc_id, score of pairs(query_id, doc_id, asks, ...): a document's tokens come as cells and residuals or as vectors."""
    width, centroids, levels = index.centroids.shape[1], index.centroids, index.levels
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_asks, asks = batch.column(2).value_lengths().to_numpy(), matrix(batch.column(2), width)
            n_docs = batch.column(3).value_lengths().to_numpy()
            if coded:
                packed = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(int(n_docs.sum()), -1)
                docs = decode(batch.column(3).flatten().to_numpy(), packed, centroids, levels)
            else:
                docs = matrix(batch.column(3), width)
            q, d = np.cumsum(n_asks), np.cumsum(n_docs)
            score = [(asks[b - m : b] @ docs[e - n : e].T).max(axis=1).sum() if n else -np.inf for b, m, e, n in zip(q, n_asks, d, n_docs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], schema=schema)

    return pairs.mapInArrow(over, "query_id long, doc_id long, score double")


def search(index: LateIndex, queries: DataFrame, k: int, cells: int = CELLS, exact: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score of queries(query_id, v), a row for each token: the k best documents found, with exact scores.

    Of the documents in the probed cells, the `exact` best (6 k if none is
    given) by their codes are scored from their vectors. A query whose cells
    hold fewer than k documents gets fewer; ties go to the smaller doc_id.
    """
    asks = queries.filter("query_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    if not len(index.centroids):
        return asks.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    near = exact_pairs(index, asks, k, cells, exact)
    whole = asks.groupBy("query_id").agg(F.collect_list("v").alias("asks"))
    wanted = near.select("doc_id").distinct()
    docs = index.vectors.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("v").alias("vs"))
    pairs = near.join(whole, "query_id").join(docs, "doc_id").select("query_id", "doc_id", "asks", "vs")
    return best(_pair_scores(pairs, index, False), k).select("query_id", "rank", "doc_id", "score")


def exact_pairs(index: LateIndex, asks: DataFrame, k: int, cells: int = CELLS, exact: int | None = None) -> DataFrame:
    """query_id, doc_id: the pairs that a search scores from the vectors."""
    whole = asks.groupBy("query_id").agg(F.collect_list("v").alias("asks"))
    found = candidates(index, asks, cells).join(whole, "query_id").join(index.codes, "doc_id").select("query_id", "doc_id", "asks", "cells", "residuals")
    return kept(best(_pair_scores(found, index, True), exact or EXACT_TIMES * k).select("query_id", "doc_id"), "near")
