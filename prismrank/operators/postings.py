"""An inverted index of a corpus, and BM25 search that skips the blocks that can't matter.

A task turns its documents, some thousands at a time (a part), into posting lists:
for each term of the part the documents that have it, in blocks of neighbours, with
the largest score that the term gives in each block. A search first adds up these
maxima, which bound what any document of a block can score for a query; the most
promising blocks are scored, and only blocks whose bound reaches the k-th score
found there are read for the rest. So a term that half of the documents have costs
its maxima, not its postings, and the rows are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.functions.text import tokens
from prismrank.operators.workflow import numbered
from prismrank.sources.files import kept, spread

#: Documents of a part and of a block, and words after which a part ends early.
PART_DOCS, BLOCK_DOCS, PART_WORDS = 2_048, 64, 1_000_000
#: Weights of terms in queries up to which they go to all tasks, and a part's postings are scored as matrices; beyond, terms are joined.
FEW_WEIGHTS = 1_000_000
#: Blocks of a query that are scored first, to learn what score counts.
FIRST_BLOCKS = 4
#: More than sums of a score's parts differ by their order; scores are compared in nine places (`nine`), and otherwise as they are, so that who rounds them further does it once.
SLACK = 1e-8

_LIST = pa.struct([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("dl", pa.list_(pa.int32()))])
_TOP = pa.struct([("block", pa.int32()), ("most", pa.float64())])
_SCHEMA = pa.schema([("term", pa.string()), ("part", pa.int64()), ("n", pa.int32()), ("tops", pa.list_(_TOP)), ("lists", pa.list_(_LIST))])
_DDL = "term string, part long, n int, tops array<struct<block: int, most: double>>, lists array<struct<block: int, ids: array<bigint>, tf: array<int>, dl: array<int>>>"


@dataclass(frozen=True)
class Index:
    """lists: a row for each term and part; terms(term, df, raw), raw being the inverse document frequency before negative ones are replaced."""

    ids: DataFrame
    lists: DataFrame
    terms: DataFrame
    avgdl: float
    mean_idf: float
    k1: float
    b: float
    epsilon: float


def _lists(size: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())


def part_of(ids: np.ndarray, words: pa.Array, dl: np.ndarray, part: int, saturation: tuple[float, float, float], block_docs: int = BLOCK_DOCS) -> pa.RecordBatch:
    """The posting lists of a part's documents, whose words follow each other in `words`, dl of each."""
    k1, b, avgdl = saturation
    coded = words.dictionary_encode()
    row = np.repeat(np.arange(len(ids)), dl)
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + row, return_counts=True)
    term, row = np.divmod(pair, max(1, len(ids)))
    block, length = row // block_docs, dl[row]
    most = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (avgdl or 1.0)))
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_block = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    per_block = _lists(np.diff(np.append(new_block, len(pair))))
    blocks_before = np.searchsorted(new_block, np.append(new_term, len(pair)))
    numbers = pa.array(block[new_block], pa.int32())
    tops = pa.StructArray.from_arrays([numbers, pa.array(np.maximum.reduceat(most, new_block) if len(pair) else [], pa.float64())], fields=list(_TOP))
    each = [pa.ListArray.from_arrays(per_block, pa.array(x, t)) for x, t in ((ids[row], pa.int64()), (tf, pa.int32()), (length, pa.int32()))]
    lists = pa.StructArray.from_arrays([numbers, *each], fields=list(_LIST))
    per_term = pa.array(blocks_before, pa.int32())
    names = coded.dictionary.take(pa.array(term[new_term], pa.int64()))
    made = pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), part), pa.int64()), pa.array(np.diff(np.append(new_term, len(pair))), pa.int32()), pa.ListArray.from_arrays(per_term, tops), pa.ListArray.from_arrays(per_term, lists)], schema=_SCHEMA)
    return made.take(pc.sort_indices(names))


def build(corpus: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, part_docs: int = PART_DOCS, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of corpus(doc_id, text), written once. Null texts are empty; every row is a document, so doc_id should be unique."""
    docs = spread(corpus).select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    whole = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl")).first()
    n, avgdl = whole["n"], whole["avgdl"] or 0.0

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, words_held, part = [], 0, 0, TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            ids, words = (pa.concat_arrays([batch.column(i) for batch in held]) for i in (0, 1))
            return part_of(ids.to_numpy(), words.flatten(), words.value_lengths().to_numpy(), part, (k1, b, avgdl), block_docs)

        for batch in batches:
            for start in range(0, batch.num_rows, block_docs):
                held.append(batch.slice(start, block_docs))
                docs_held, words_held = docs_held + held[-1].num_rows, words_held + len(held[-1].column(1).flatten())
                if docs_held >= part_docs or words_held >= PART_WORDS:
                    yield closed()
                    held, docs_held, words_held, part = [], 0, 0, part + 1
        if held:
            yield closed()

    lists = kept(docs.filter("doc_id IS NOT NULL").mapInArrow(over, _DDL), "postings")
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    terms = kept(df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    mean = terms.agg(F.avg("raw")).first()[0] or 0.0
    return Index(corpus.select(F.col("doc_id").cast("long").alias("doc_id")), lists, terms, avgdl, mean, k1, b, epsilon)


def weights(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, w of the queries' words that the corpus has; repeated words count again."""
    asked = queries.select("query_id", F.explode(tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.when(F.col("raw") < 0, index.epsilon * index.mean_idf).otherwise(F.col("raw"))
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * idf).alias("w"))


def bounds(index: Index, weighted: DataFrame) -> DataFrame:
    """query_id, part, block, bound: no document of the block scores more for the query. Blocks without a word of the query aren't there."""
    tops = index.lists.join(weighted.select("term").distinct(), "term", "left_semi").select("term", "part", F.explode("tops").alias("top"))
    per = tops.select("term", "part", "top.block", "top.most").join(weighted, "term")
    return per.groupBy("query_id", "part", "block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("most")).alias("bound"))


def scored(index: Index, weighted: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, doc_id, nine, score of the documents in blocks(query_id, part, block) that have a word of their query; scores other than 0 in nine places."""
    wanted = blocks.select("query_id", "part", "block").join(weighted, "query_id")
    lists = index.lists.select("term", "part", "lists").join(wanted.select("term", "part").distinct(), ["term", "part"], "left_semi")
    lists = lists.select("term", "part", F.explode("lists").alias("list")).select("term", "part", "list.*")
    each = wanted.join(lists, ["term", "part", "block"]).select("query_id", "w", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p"))
    tf: Column = F.col("p.tf")
    part = F.col("w") * tf * (index.k1 + 1) / (tf + index.k1 * (1 - index.b + index.b * F.col("p.dl") / F.lit(index.avgdl)))
    return each.groupBy("query_id", F.col("p.ids").alias("doc_id")).agg(F.sum(part).alias("score")).withColumn("nine", F.round("score", 9)).filter("nine <> 0").select("query_id", "doc_id", "nine", "score")  # the order of the sums must not break ties


def best_of(index: Index, weighted: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, nine, score: the k best of scored(), and as long as the weights are few (counted first) no more than k of a part and query leave a task."""
    if weighted.limit(FEW_WEIGHTS + 1).count() > FEW_WEIGHTS:
        return best(scored(index, weighted, blocks), k, "nine").select("query_id", "doc_id", "nine", "score")
    asked = weighted.toArrow()
    names, term = np.unique(np.array(asked["term"].to_pylist(), object), return_inverse=True) if asked.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    number = {t: i for i, t in enumerate(names)}
    q, w = asked["query_id"].to_numpy(), asked["w"].to_numpy()
    order = np.argsort(q, kind="stable")
    ids, starts = np.unique(q[order], return_index=True)
    of = {i: (term[rows], w[rows]) for i, rows in zip(ids.tolist(), np.split(order, starts[1:]), strict=True)} if len(ids) else {}
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("nine", pa.float64()), ("score", pa.float64())])
    k1, b, avgdl = index.k1, index.b, index.avgdl or 1.0

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        lists = left["lists"].combine_chunks()
        entries = lists.flatten()
        block, ids, tf, dl = (entries.field(i) for i in range(4))
        size = ids.value_lengths().to_numpy()
        terms = np.repeat(np.repeat(np.array([number[t] for t in left["term"].to_pylist()]), lists.value_lengths().to_numpy()), size)
        blocks_of, ids, tf, dl = np.repeat(block.to_numpy(), size), ids.flatten().to_numpy(), tf.flatten().to_numpy(), dl.flatten().to_numpy()
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        by_block = np.argsort(blocks_of, kind="stable")
        blocks_of = blocks_of[by_block]
        wanted, asks = right["block"].to_numpy(), right["query_id"].to_numpy()
        by_wanted = np.argsort(wanted, kind="stable")
        wanted, asks = wanted[by_wanted], asks[by_wanted]
        place, found = np.full(len(number), -1), []
        for one in np.unique(wanted).tolist():
            rows = by_block[slice(*np.searchsorted(blocks_of, [one, one + 1]))]
            there, at = np.unique(terms[rows], return_inverse=True)
            docs, doc = np.unique(ids[rows], return_inverse=True)
            parts = np.zeros((len(there), len(docs)))
            np.add.at(parts, (at, doc), impact[rows])
            place[there] = np.arange(len(there))
            for query in asks[slice(*np.searchsorted(wanted, [one, one + 1]))].tolist():
                mine, weight = of[query]
                at = place[mine]
                score = weight[at >= 0] @ parts[at[at >= 0]]
                nine = np.round(score, 9)  # the order of the sums must not break ties
                hit = np.flatnonzero(nine)
                found.append((np.full(len(hit), query), docs[hit], nine[hit], score[hit]))
            place[there] = -1
        query, doc, nine, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((doc, -nine, query))
        query, doc, nine, score = query[order], doc[order], nine[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
        few = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
        return pa.Table.from_arrays([pa.array(query[few], pa.int64()), pa.array(doc[few], pa.int64()), pa.array(nine[few], pa.float64()), pa.array(score[few], pa.float64())], schema=schema)

    lists = index.lists.select("term", "part", "lists").join(weighted.select("term").distinct(), "term", "left_semi")
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work, so not left to be merged by size
    pairs = lists.repartition(n, "part").groupBy("part").cogroup(blocks.select(F.col("query_id").cast("long"), "part", "block").repartition(n, "part").groupBy("part"))
    return best(pairs.applyInArrow(part, "query_id long, doc_id long, nine double, score double"), k, "nine").select("query_id", "doc_id", "nine", "score")


def best(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), F.asc("doc_id")))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def needed(index: Index, weighted: DataFrame, bound: DataFrame, k: int) -> DataFrame:
    """query_id, part, block, bound, reads: whether documents of the block can be among the query's k best."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "part", "block"))
    first = bound.withColumn("place", place).filter(F.col("place") <= FIRST_BLOCKS)
    found = best_of(index, weighted, first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("nine").alias("floor"))
    floors = found.filter((F.col("n") == k) & (F.col("floor") > 0)).select("query_id", "floor")
    return bound.join(floors, "query_id", "left").withColumn("reads", F.col("bound") + SLACK >= F.coalesce("floor", F.lit(0.0))).drop("floor")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each of queries(query_id, text), of equals those of the least doc_id.

    Documents without any word of the query score 0, as do those whose words
    weigh 0, and stand before negative scores, in the order of doc_id. A null
    query has no words. Fewer rows where the corpus has fewer documents.
    """
    weighted = kept(weights(index, queries), "weights")
    bound = kept(bounds(index, weighted), "bounds")
    found = kept(best_of(index, weighted, needed(index, weighted, bound, k).filter("reads"), k), "best")
    above = found.filter("nine > 0").groupBy("query_id").agg(F.count("*").alias("above"))
    lacking = queries.select("query_id").distinct().join(above, "query_id", "left").filter(F.coalesce("above", F.lit(0)) < k).select("query_id")
    return _ranked(found.unionByName(_unmatched(index, weighted, bound, found, lacking, k)), k)


def _unmatched(index: Index, weighted: DataFrame, bound: DataFrame, found: DataFrame, lacking: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, nine and score 0: for queries with fewer than k positive documents, the first by doc_id of those that score 0.

    Where no term weighs less than 0, a lacking query has fewer than k scores
    other than 0, all of them found; so k of the first 2 k documents are enough.
    Else it needs as many more as it has scores other than 0.
    """
    ids = index.ids.filter("doc_id IS NOT NULL").distinct()
    if index.epsilon * index.mean_idf >= 0:
        hit, first = found, [r["doc_id"] for r in ids.orderBy("doc_id").limit(2 * k).collect()]
        every = lacking.select("query_id", F.explode(F.lit(first).cast("array<bigint>")).alias("doc_id")) if first else found.select("query_id", "doc_id").limit(0)
    else:  # terms are, on the whole, in most documents
        hit = kept(scored(index, weighted, bound.join(lacking, "query_id", "left_semi")).select("query_id", "doc_id"), "hit")
        runs = lacking.join(hit.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.coalesce("n", F.lit(0)) + k) / PART_DOCS))).alias("run"))
        every = runs.join(numbered(ids, "doc_id", "place").select("doc_id", F.floor(F.col("place") / PART_DOCS).alias("run")), "run").select("query_id", "doc_id")
    return every.join(hit.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("nine"), F.lit(0.0).alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return best(scores, k, "nine").select("query_id", "rank", "doc_id", "score")


def skipped(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, n_blocks, n_read: the blocks that hold a word of the query, and those whose postings a search reads."""
    weighted = kept(weights(index, queries), "weights")
    bound = kept(bounds(index, weighted), "bounds")
    return needed(index, weighted, bound, k).groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.count_if("reads").alias("n_read"))
