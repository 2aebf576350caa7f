"""Metrics of retrieved lists, selected contexts and answers. Undefined values are null, never 0 or NaN."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.functions.vectors import cosine, norm


def hits(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows (query_id, rank, doc_id) with rel, 1 or 0, by qrels(query_id, doc_id)."""
    gold = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    return ranked.join(gold, ["query_id", "doc_id"], "left").fillna({"rel": 0})


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, n_gold, recall, mrr, ndcg at k for every query of qrels; null where no gold is known."""
    gold = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_gold"))
    return metrics_of(hits(ranked.filter(F.col("rank") <= k), qrels), gold, k)


def same_label(ranked: DataFrame, corpus: DataFrame, queries: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Ranked rows (query_id, rank, doc_id) with rel, and (query_id, n_gold), where the gold of queries(query_id, label) are the other documents of corpus(doc_id, label) with the same label, whose pairs aren't listed: they are counted by label."""
    asks = queries.select("query_id", F.col(label).alias("_of")).filter(F.col("_of").isNotNull()).distinct()
    docs = corpus.select("doc_id", F.col(label).alias("_is")).filter(F.col("_is").isNotNull()).distinct()
    per = docs.groupBy("_is").agg(F.count("*").alias("_n"))
    own = docs.select(F.col("doc_id").alias("query_id"), F.col("_is").alias("_of"), F.lit(1).alias("_own"))
    counts = asks.join(per, F.col("_of") == F.col("_is")).join(own, ["query_id", "_of"], "left").select("query_id", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("n_gold"))
    rel = F.coalesce((F.col("_of") == F.col("_is")) & (F.col("query_id") != F.col("doc_id")), F.lit(False)).cast("int")
    judged = ranked.join(asks, "query_id", "left").join(docs, "doc_id", "left").withColumn("rel", rel).drop("_of", "_is")
    return judged, counts.filter("n_gold > 0")


def metrics_of(judged: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, n_gold, recall, mrr, ndcg at k from judged(query_id, rank, rel) for every query of gold(query_id, n_gold)."""
    found = judged.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum("rel").alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return gold.join(found, "query_id", "left").select("query_id", "n_gold", (F.coalesce("hit", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def pairwise_diversity(items: DataFrame, keys: list[str], order: str, v: str = "v") -> DataFrame:
    """keys, n_items, diversity: mean of 1 - cosine over the pairs of each small list; null under two items. A vector without length is like none: its cosines are 0."""
    a = items.select(*keys, F.col(order).alias("i"), F.col(v).alias("x"))
    b = items.select(*keys, F.col(order).alias("j"), F.col(v).alias("y"))
    pairs = a.join(b, keys).filter("i < j").groupBy(*keys).agg(F.avg(1 - F.when((norm(F.col("x")) == 0) | (norm(F.col("y")) == 0), 0.0).otherwise(cosine(F.col("x"), F.col("y")))).alias("diversity"))
    return items.groupBy(*keys).agg(F.count("*").alias("n_items")).join(pairs, keys, "left")


def alpha_dcg(covered: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """keys, dcg of covered(keys, rank, aspect): each repetition of an aspect counts (1 - alpha) of the time before."""
    before = F.count("*").over(W.partitionBy(*keys, "aspect").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    return covered.withColumn("seen", before).groupBy(*keys).agg(F.sum(F.pow(F.lit(1 - alpha), F.col("seen")) / F.log2(F.col("rank") + 1)).alias("dcg"))


def _per_query(rows: DataFrame, key: str, fn, schema: pa.Schema, ddl: str, order: list[str]) -> DataFrame:
    """fn(key, rows) for each key's bounded rows, in order, one after another in each task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r[key] != now and held:
                    out += fn(now, held)
                    held = []
                now = r[key]
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist(fn(now, held), schema=schema)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(over, ddl)


def ideal_alpha_dcg(passages: DataFrame, alpha: float, k: int = 5) -> DataFrame:
    """query_id, idcg: greedily, the passage of the largest gain next, of equals the first by doc_id, while there is a gain; passages(query_id, doc_id, aspects)."""
    schema = pa.schema([("query_id", pa.int64()), ("idcg", pa.float64())])

    def best(query_id: int, rows: list[dict]) -> list[dict]:
        from math import log2

        seen: dict = {}
        left, total = list(rows), 0.0
        for rank in range(1, k + 1):
            gains = [sum((1 - alpha) ** seen.get(a, 0) for a in r["aspects"]) for r in left]
            if not left or max(gains) <= 0:
                break
            i = gains.index(max(gains))
            total += gains[i] / log2(rank + 1)
            for a in left.pop(i)["aspects"]:
                seen[a] = seen.get(a, 0) + 1
        return [{"query_id": query_id, "idcg": total}]

    return _per_query(passages.select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), "aspects"), "query_id", best, schema, "query_id long, idcg double", ["doc_id"])


def least_cover(masks: list[int]) -> int | None:
    """The fewest of the sets of aspects, as bit masks, that hold all aspects any of them holds; None without any aspect.

    Branch and bound. What decides nothing goes first: sets within others, and
    aspects that are held wherever another one is. Aspects no two of which
    share a set each need one, which bounds what is left from below. The search
    branches on the sets of the aspect that fewest have.
    """
    found = {m for m in masks if m}
    if not found:
        return None

    def reduced(sets: list[int]) -> tuple[list[int], dict[int, int]]:
        """Sets that aren't within others, of aspects that aren't implied, and which sets hold each aspect."""
        while True:
            sets = sorted(set(sets) - {0}, key=int.bit_count, reverse=True)
            sets = [m for i, m in enumerate(sets) if not any(m & o == m for o in sets[:i])]
            holders: dict[int, int] = {}
            for i, m in enumerate(sets):
                while m:
                    low = m & -m
                    holders[low] = holders.get(low, 0) | 1 << i
                    m ^= low
            by = sorted(holders.items(), key=lambda x: x[1].bit_count())
            implied, kept = 0, []
            for aspect, who in by:
                if any(who & w == w for w in kept):
                    implied |= aspect
                else:
                    kept.append(who)
            if not implied:
                return sets, holders
            sets = [m & ~implied for m in sets]

    best = len(found)

    def search(sets: list[int], used: int) -> None:
        nonlocal best
        sets, holders = reduced(sets)
        if not holders:
            best = min(best, used)
            return
        taken = apart = 0
        by = sorted(holders.values(), key=int.bit_count)
        for who in by:
            if not who & taken:
                taken, apart = taken | who, apart + 1
        if used + max(apart, -(-len(holders) // sets[0].bit_count())) >= best:
            return
        for i in [i for i in range(len(sets)) if by[0] >> i & 1]:  # the largest first
            search([m & ~sets[i] for m in sets], used + 1)

    search(list(found), 0)
    return best


def min_set_cover(passages: DataFrame) -> DataFrame:
    """query_id, n_aspects, cover: the fewest passages that cover all coverable aspects, exactly; null without any."""
    schema = pa.schema([("query_id", pa.int64()), ("n_aspects", pa.int32()), ("cover", pa.int32())])

    def cover(query_id: int, rows: list[dict]) -> list[dict]:
        at = {a: i for i, a in enumerate(sorted({a for r in rows for a in r["aspects"]}))}
        return [{"query_id": query_id, "n_aspects": len(at), "cover": least_cover([sum(1 << at[a] for a in set(r["aspects"])) for r in rows])}]

    return _per_query(passages.select(F.col("query_id").cast("long"), "aspects"), "query_id", cover, schema, "query_id long, n_aspects int, cover int", [])


def claim_support(labels: DataFrame) -> DataFrame:
    """answer, claim, supported, n_sources of labels(answer, claim, passage, label): label 0 of any passage supports."""
    return labels.groupBy("answer", "claim").agg(F.bool_or(F.col("label") == 0).alias("supported"), F.countDistinct(F.when(F.col("label") == 0, F.col("passage"))).alias("n_sources"))


def faithfulness(claims: DataFrame) -> DataFrame:
    """answer, n_claims, n_supported, faithfulness, hallucinated."""
    return claims.groupBy("answer").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"), F.avg(F.col("supported").cast("double")).alias("faithfulness"), F.bool_or(~F.col("supported")).alias("hallucinated"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two lists as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def overlap_summary(pairs: DataFrame, by: str) -> DataFrame:
    """by, n, jaccard, shared, identical of pairs(by, ids, other), two ordered lists each: mean overlap as a share of the union and as a number, and how many are the same list in the same order; for each `by` and, as pooled, for all. Pairs of empty lists have no share."""
    each = pairs.select(by, jaccard(F.col("ids"), F.col("other")).alias("_j"), F.size(F.array_intersect("ids", "other")).alias("_n"), (F.col("ids") == F.col("other")).cast("double").alias("_same"))
    sums = each.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), F.avg("_j").alias("jaccard"), F.avg("_n").alias("shared"), F.avg("_same").alias("identical"))
    return sums.select(F.when(F.col("_all") == 1, "pooled").otherwise(F.col(by)).alias(by), "n", "jaccard", "shared", "identical")


def claim_status(support: Column, contradict: Column, failed: Column, threshold: float = 0.5) -> Column:
    """FAILED, INCONSISTENT, SUPPORTED, CONTRADICTED or UNSUPPORTED from the largest probabilities of a claim's checks."""
    yes, no = support >= threshold, contradict >= threshold
    return F.when(failed, "FAILED").when(yes & no, "INCONSISTENT").when(yes, "SUPPORTED").when(no, "CONTRADICTED").otherwise("UNSUPPORTED")
