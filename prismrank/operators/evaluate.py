"""Metric values with status and reason, diversity of answers, claims in two stages, and embeddings that are kept."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.functions import text as X
from prismrank.functions.vectors import norm
from prismrank.operators import checks

def answer_metrics(prediction: str = "prediction", gold: str = "gold") -> dict[str, Column]:
    """Metrics of an answer by their names; words(prediction), words(gold) are columns p and g."""
    return {"exact_match": X.exact_match(F.col(prediction), F.col(gold)), "token_f1": X.token_f1(F.col("p"), F.col("g")), "rouge_l": X.rouge_l("p", "g")}


def evaluate(rows: DataFrame, registry: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """rows with metric_id, value, status and reason: a row for each row and metric of the registry.

    rows(dataset_id, context_mode, frozen, has_reference, has_evaluator,
    generation, prediction, gold, ...); registry, few rows of
    checks.REGISTRY. The first gate that a metric doesn't pass is the reason;
    then a metric without a column here is not configured, and a null
    prediction or gold, or a value that is null or not a number, is invalid.
    """
    each = rows.withColumns({"p": X.answer_words(F.col("prediction")), "g": X.answer_words(F.col("gold"))}).join(F.broadcast(registry))
    value = F.coalesce(*[F.when(F.col("metric_id") == name, c) for name, c in metrics.items()])
    bad = F.col("prediction").isNull() | F.col("gold").isNull()
    decision = F.coalesce(checks.gate(), F.when(~F.col("metric_id").isin(list(metrics)), "NOT_IMPLEMENTED").when(bad, "INVALID"))
    decided = each.withColumn("decision", decision).withColumn("value", F.when(F.col("decision").isNull(), value))
    invalid = F.col("decision").isNull() & (F.col("value").isNull() | F.isnan("value"))
    decided = decided.withColumn("decision", F.when(invalid, "INVALID").otherwise(F.col("decision")))
    told = checks.status_and_reason(F.col("decision"))
    out = decided.withColumns({"status": F.coalesce(told["status"], F.lit("measured")), "reason": told["reason"], "value": F.when(F.col("decision").isNull(), F.col("value"))})
    return out.drop("p", "g", "decision", *[f.name for f in registry.schema if f.name != "metric_id"])


def _qrels_fault(retrieved: Column, gold: Column) -> Column:
    nulls = lambda c: F.exists(c, lambda x: x.isNull())
    bad = (F.size(gold) == 0) | nulls(gold) | nulls(retrieved) | (F.size(F.array_distinct(gold)) != F.size(gold))
    return F.when(gold.isNull(), "NO_REFERENCE").when(F.coalesce(bad, F.lit(True)), "INVALID")


def _vectors_fault(vectors: Column, n: Column) -> Column:
    width = F.size(F.get(vectors, F.lit(0)))
    part = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    shape = F.exists(vectors, lambda v: v.isNull() | (F.size(v) != width) | (F.size(v) == 0))
    content = F.exists(vectors, lambda v: F.exists(v, part) | (norm(v) == 0))
    bad = F.coalesce((F.size(vectors) != n) | (F.size(vectors) == 0), F.lit(True)) | F.coalesce(shape, F.lit(True))
    return F.when(vectors.isNull(), "NO_VECTORS").when(bad, "INVALID").when(F.size(vectors) < 2, "TOO_FEW").when(F.coalesce(content, F.lit(True)), "INVALID")


def evaluate_retrieval(rows: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """rows with metric_id, value, status and reason: a row for each row and metric of the registry, of which recall_at_k, mrr_at_k and retrieval_diversity are known.

    rows(dataset_id, context_mode, frozen, has_evaluator, retrieved: ids in
    order, gold: ids or null, vectors: of the retrieved, or null, ...). Gates go
    first, with a reference where gold isn't null, and whatever became of the
    generation; then a metric that isn't known is not configured, and what a
    metric is computed of must be sound: gold without nulls, without repeats
    and not empty; as many finite vectors of one width and some length as
    there are ids, two at least.
    """
    facts = {"has_reference": F.col("gold").isNotNull(), "generation": F.lit("success")}
    each = rows.withColumns(facts).join(F.broadcast(registry))
    metric, first = F.col("metric_id"), F.slice("retrieved", 1, k)
    gold, vectors = F.col("gold"), F.col("vectors")
    hits = F.size(F.array_intersect(first, gold))
    places = F.transform(first, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    n = F.size(vectors)
    units = F.transform(vectors, lambda v: F.transform(v, lambda x: F.try_divide(x.cast("double"), norm(v))))
    whole = F.aggregate(units, F.array_repeat(F.lit(0.0), F.size(F.get(vectors, F.lit(0)))), lambda a, u: F.zip_with(a, u, lambda x, y: x + y))
    square = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)  # of the sum of unit vectors: all pairs' cosines and n
    value = (
        F.when(metric == "recall_at_k", F.try_divide(hits, F.size(gold)))
        .when(metric == "mrr_at_k", F.coalesce(1 / F.array_min(places), F.lit(0.0)))
        .when(metric == "retrieval_diversity", 1 - F.try_divide(square - n, n * (n - 1)))
    )
    fault = F.when(metric.isin("recall_at_k", "mrr_at_k"), _qrels_fault(F.col("retrieved"), gold)).when(metric == "retrieval_diversity", _vectors_fault(vectors, F.size("retrieved"))).otherwise("NOT_IMPLEMENTED")
    decided = each.withColumn("decision", F.coalesce(checks.gate(), fault))
    told = checks.status_and_reason(F.col("decision"))
    result = checks.metric_result(value, F.coalesce(told["status"], F.lit("measured")), told["reason"])
    out = decided.withColumn("result", result).withColumns({c: F.col(f"result.{c}") for c in ("value", "status", "reason")})
    return out.drop("result", "decision", *facts, *[f.name for f in registry.schema if f.name != "metric_id"])


def output_diversity(sentences: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """keys, n_items, diversity: mean of 1 - cosine over the pairs of sentences; null under two; a vector without length is like none.

    The sum of all pairs' cosines follows from the sum of the unit vectors, so
    no pairs are made: partial sums by dimension, whatever the group's size.
    """
    length = norm(F.col(v))
    units = sentences.select(*keys, F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)).alias("u"), (length > 0).cast("long").alias("long"))
    sizes = units.groupBy(*keys).agg(F.count("*").alias("n_items"), F.sum("long").alias("long"))
    sums = units.select(*keys, F.posexplode("u")).groupBy(*keys, "pos").agg(F.sum("col").alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    pairs = F.col("n_items") * (F.col("n_items") - 1)
    return sizes.join(sums, keys, "left").select(*keys, "n_items", F.when(F.col("n_items") > 1, 1 - (F.col("square") - F.col("long")) / pairs).alias("diversity"))


def diversity_summary(per: DataFrame) -> DataFrame:
    """answers, eligible, ineligible, fraction and mean over the eligible."""
    return per.agg(F.count("*").alias("answers"), F.count("diversity").alias("eligible"), F.count_if(F.col("diversity").isNull()).alias("ineligible"), (F.count("diversity") / F.count("*")).alias("fraction"), F.avg("diversity").alias("mean"))


def two_stage_status(singles: DataFrame, pairs: DataFrame, keys: list[str], entail: float = 0.5, contradict: float = 0.5) -> DataFrame:
    """keys, status, n_pairs: claims by single passages first, then by pairs of them in order.

    singles(keys, passage, p_entail, p_contradict), pairs(keys, i, j, p_entail);
    a null or non-finite probability is a failed check. Any failed single fails
    the claim. Pairs are looked at only without single support, up to the first
    that supports (n_pairs of them); without one, a failed pair fails the claim.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    one = singles.groupBy(*keys).agg(
        F.bool_or(~(finite("p_entail") & finite("p_contradict"))).alias("failed"),
        F.coalesce(F.bool_or(finite("p_entail") & (F.col("p_entail") >= entail)), F.lit(False)).alias("yes"),
        F.coalesce(F.bool_or(finite("p_contradict") & (F.col("p_contradict") >= contradict)), F.lit(False)).alias("no"))
    place = F.struct("i", "j")
    first = pairs.groupBy(*keys).agg(F.min(F.when(finite("p_entail") & (F.col("p_entail") >= entail), place)).alias("first"))
    two = pairs.join(first, keys).groupBy(*keys).agg(F.bool_or(F.col("first").isNotNull()).alias("pair"), F.count_if(F.col("first").isNull() | (place <= F.col("first"))).alias("seen"), F.bool_or(~finite("p_entail")).alias("pair_failed"))
    both = one.join(two, keys, "left").fillna({"pair": False, "pair_failed": False, "seen": 0})
    alone, support = F.col("failed") | F.col("yes"), F.col("yes") | F.col("pair")
    status = F.when(F.col("failed"), "FAILED").when(support & F.col("no"), "INCONSISTENT").when(support, "SUPPORTED").when(F.col("pair_failed"), "FAILED").when(F.col("no"), "CONTRADICTED").otherwise("UNSUPPORTED")
    return both.select(*keys, status.alias("status"), F.when(alone, 0).otherwise(F.col("seen")).cast("long").alias("n_pairs"))


def answer_faithfulness(claims: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_claims, n_success, n_failed, and the rates supported (the answer's score), contradicted, inconsistent and unsupported, of claims(keys, status) and answers(keys, has_context).

    Failed claims are counted, not scored. Rates are null without a verified
    claim, and everything but n_claims where there was no context to hold
    claims against. An answer without claims has 0 of them.
    """
    states = ["SUPPORTED", "CONTRADICTED", "INCONSISTENT", "UNSUPPORTED"]
    counts = claims.groupBy(*keys).agg(F.count("*").alias("n_claims"), F.count_if(F.col("status").isin(states)).alias("n_success"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    both = answers.select(*keys, "has_context").join(counts, keys, "left").fillna(0, ["n_claims", "n_success", "n_failed", *states])
    seen = lambda c: F.when(F.col("has_context"), c)
    return both.select(*keys, "n_claims", seen(F.col("n_success")).alias("n_success"), seen(F.col("n_failed")).alias("n_failed"), *[seen(F.try_divide(s, "n_success")).alias(s.lower()) for s in states])


#: Asks a model about (premise, claim) pairs: probabilities of entailment and of contradiction, or None for a call that failed.
Verifier = Callable[[list[tuple[str, str]]], list[tuple[float, float] | None]]


def staged_claims(claims: DataFrame, keys: list[str], verify: Verifier, entail: float = 0.5, contradict: float = 0.5) -> DataFrame:
    """keys, status, n_singles, n_pairs of claims(keys, claim_text, passages): every passage by itself first; then, only for claims that no check failed and no passage supports, pairs of passages in order, up to the first that supports.

    Pairs are made where they are asked about, one of each open claim at a
    time, so that calls are batches and no claim is asked about again. A claim
    without text or passages fails.
    """
    kinds = dict(claims.dtypes)
    ddl = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["status string", "n_singles int", "n_pairs int"])
    sound = lambda p: p is not None and all(x is not None and math.isfinite(x) for x in p)

    def judged(texts: list[str | None], passages: list[list[str]]) -> list[tuple[str, int, int]]:
        asked = [(i, p) for i, (t, ps) in enumerate(zip(texts, passages, strict=True)) if t for p in ps]
        singles: dict[int, list] = {}
        for (i, _), p in zip(asked, verify([(p, texts[i]) for i, p in asked]), strict=True):
            singles.setdefault(i, []).append(p)
        failed = {i for i in range(len(texts)) if i not in singles or not all(map(sound, singles[i]))}
        yes = {i for i in singles if i not in failed and any(p[0] >= entail for p in singles[i])}
        no = {i for i in singles if i not in failed and any(p[1] >= contradict for p in singles[i])}
        n_pairs, broken, paired = dict.fromkeys(range(len(texts)), 0), set(), set()
        rest = {i: list(combinations(passages[i], 2)) for i in range(len(texts)) if i not in failed | yes}
        while rest := {i: pairs for i, pairs in rest.items() if pairs and i not in paired}:
            for (i, pairs), p in zip(rest.items(), verify([("\n\n".join(pairs[0]), texts[i]) for i, pairs in rest.items()]), strict=True):
                n_pairs[i] += 1
                if not sound(p):
                    broken.add(i)
                elif p[0] >= entail:
                    paired.add(i)
            rest = {i: pairs[1:] for i, pairs in rest.items()}
        status = lambda i: "FAILED" if i in failed else ("INCONSISTENT" if i in no else "SUPPORTED") if i in yes | paired else "FAILED" if i in broken else "CONTRADICTED" if i in no else "UNSUPPORTED"
        return [(status(i), len(singles.get(i, [])), n_pairs[i]) for i in range(len(texts))]

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = judged(frame["claim_text"].tolist(), [[] if p is None else [x for x in p if x is not None] for p in frame["passages"]])
            yield frame[keys].assign(**{name: [f[i] for f in found] for i, name in enumerate(("status", "n_singles", "n_pairs"))})

    return claims.select(*keys, "claim_text", "passages").mapInPandas(over, ddl)


def largest_entailment(checks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entailment: the largest probability of entailment of an answer by any of its passages, of checks(keys, premise, p_entail) and answers(keys, answer); 0 for a blank answer and without passages that aren't blank."""
    filled = lambda c: F.coalesce(X.strip(F.col(c)) != "", F.lit(False))
    most = checks.filter(filled("premise")).groupBy(*keys).agg(F.max("p_entail").alias("most"))
    return answers.join(most, keys, "left").select(*keys, F.when(filled("answer"), F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("entailment"))


def kept_embeddings(corpus: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and v of the corpus as written at path, if as many as its documents; else computed by embed, scaled to unit length and written anew.

    Vectors without length stay. A stale folder isn't touched: the new one is
    beside it, named by the number of rows.
    """
    spark, n = corpus.sparkSession, corpus.count()
    at = f"{path}/rows={n}"
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.schema("doc_id long, v array<double>").parquet(at)
        if there.count() == n:
            return there
    length = norm(F.col("v"))
    unit = F.transform("v", lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
    embed(corpus).select(F.col("doc_id").cast("long"), unit.alias("v")).write.mode("overwrite").parquet(at)
    return spark.read.schema("doc_id long, v array<double>").parquet(at)


def bound(artifacts: DataFrame, manifest: DataFrame, keys: list[str], digests: list[str]) -> DataFrame:
    """artifacts with binding: BOUND, UNKNOWN where the manifest has no such key, or the first digest that differs."""
    theirs = manifest.select(*keys, F.lit(True).alias("_there"), *[F.col(d).alias(f"_{d}") for d in digests])
    both = artifacts.join(theirs, keys, "left")
    state = F.when(F.col("_there").isNull(), "UNKNOWN")
    for d in digests:
        state = state.when(~F.col(d).eqNullSafe(F.col(f"_{d}")), d)
    return both.withColumn("binding", state.otherwise("BOUND")).drop("_there", *[f"_{d}" for d in digests])
