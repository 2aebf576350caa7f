"""Joins that must hold, validation of rows, applicability of metrics, and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def require_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a row without a match is an error when it is read."""
    marked = left.join(right.withColumn("_there", F.lit(True)), keys, "left")
    return marked.filter(F.coalesce("_there", F.raise_error(F.lit(f"no match for a row by {keys}")).cast("boolean"))).drop("_there")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return observed.select(*keys).distinct().join(expected, keys, "left_anti")


def complete_pairs(expected: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected key with whether each side has it; keys are unique on each side."""
    a, b = (x.select(*keys).distinct().withColumn(n, F.lit(True)) for x, n in ((left, "has_left"), (right, "has_right")))
    return expected.select(*keys).join(a, keys, "left").join(b, keys, "left").fillna(False, ["has_left", "has_right"]).withColumn("complete", F.col("has_left") & F.col("has_right"))


def contiguity(df: DataFrame, keys: list[str], position: str, start: int = 0) -> DataFrame:
    """keys, n, contiguous: whether the positions are start, start + 1, ... once each."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ((F.min(position) == start) & (F.max(position) == F.count("*") + start - 1) & (F.countDistinct(position) == F.count("*"))).alias("contiguous"))


def descending(df: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """keys, descending: whether the score never rises along the order."""
    fell = F.coalesce(F.lag(score).over(W.partitionBy(*keys).orderBy(order)) >= F.col(score), F.lit(True))
    return df.withColumn("_ok", fell).groupBy(*keys).agg(F.bool_and("_ok").alias("descending"))


def metric_result(value: Column, status: Column, reason: Column) -> Column:
    """A value with status measured, or a reason without value."""
    return F.struct(F.when(status == "measured", value).alias("value"), status.alias("status"), F.when(status != "measured", reason).alias("reason"))


#: What keeps a metric from being measured, in the order in which it is looked for: decision, status and reason.
GATES = [
    ("WRONG_DATASET", "not_applicable", "not_defined_for_dataset"),
    ("WRONG_CONTEXT", "not_applicable", "not_defined_for_context_mode"),
    ("PROTOCOL_NOT_FROZEN", "not_computed", "protocol_not_frozen"),
    ("NO_REFERENCE", "not_computed", "reference_unavailable"),
    ("NO_EVALUATOR", "not_computed", "evaluator_unavailable"),
    ("NOT_RUN", "not_computed", "generation_not_attempted"),
    ("GENERATION_FAILED", "failed", "generation_failed"),
    ("NOT_IMPLEMENTED", "not_computed", "evaluator_not_configured"),
    ("INVALID", "failed", "invalid_metric_input"),
    ("NO_VECTORS", "not_computed", "missing_embedding"),
    ("TOO_FEW", "not_computed", "insufficient_items"),
]
#: A registry's columns: what a metric is defined for, the data sets whose protocol is frozen (null arrays: all), and what it needs.
REGISTRY = "metric_id string, datasets array<string>, contexts array<string>, frozen_datasets array<string>, needs_generation boolean, needs_reference boolean, needs_evaluator boolean"


def gate() -> Column:
    """The first gate that rows joined with a registry don't pass; null for none."""
    within = lambda c, of: F.col(of).isNull() | F.array_contains(of, F.col(c))
    return (
        F.when(~within("dataset_id", "datasets"), "WRONG_DATASET")
        .when(~within("context_mode", "contexts"), "WRONG_CONTEXT")
        .when(~within("dataset_id", "frozen_datasets") | ~F.col("frozen"), "PROTOCOL_NOT_FROZEN")
        .when(F.col("needs_reference") & ~F.col("has_reference"), "NO_REFERENCE")
        .when(F.col("needs_evaluator") & ~F.col("has_evaluator"), "NO_EVALUATOR")
        .when(F.col("needs_generation") & (F.col("generation") == "not_run"), "NOT_RUN")
        .when(F.col("needs_generation") & (F.col("generation") == "failed"), "GENERATION_FAILED")
    )


def status_and_reason(decision: Column) -> dict[str, Column]:
    """Columns status and reason of a decision: null for a metric that can be measured."""
    of = lambda i: F.create_map(*[F.lit(x) for g in GATES for x in (g[0], g[i])])[decision]
    return {"status": of(1), "reason": of(2)}


def applicability(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows(metric_id, dataset_id, context_mode, frozen, has_reference, has_evaluator, generation: success, not_run or failed) with decision, ELIGIBLE or the first gate that isn't passed, and its status and reason.

    registry has the columns of REGISTRY and few rows; a metric it doesn't have
    is an error when the row is read.
    """
    known = rows.join(F.broadcast(registry.withColumn("_there", F.lit(True))), "metric_id", "left")
    decision = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("unknown metric "), F.col("metric_id")))).otherwise(F.coalesce(gate(), F.lit("ELIGIBLE")))
    names = [f.name for f in registry.schema if f.name != "metric_id"]
    return known.withColumn("decision", decision).withColumns(status_and_reason(F.col("decision"))).drop("_there", *names)


def manifest(corpus: DataFrame, id_column: str, *texts: str) -> DataFrame:
    """id, sha256 of each text and of the row."""
    hashes = {f"{t}_sha256": F.sha2(F.coalesce(t, F.lit("")), 256) for t in texts}
    return corpus.select(id_column, *[h.alias(n) for n, h in hashes.items()], F.sha2(F.concat_ws("|", F.col(id_column).cast("string"), *hashes.values()), 256).alias("row_sha256"))


def manifest_differences(left: DataFrame, right: DataFrame, id_column: str) -> DataFrame:
    """Rows that are on one side only, or differ: id and state MISSING, EXTRA or CHANGED."""
    both = left.select(id_column, F.col("row_sha256").alias("a")).join(right.select(id_column, F.col("row_sha256").alias("b")), id_column, "full")
    state = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(F.col("a") != F.col("b"), "CHANGED")
    return both.select(id_column, state.alias("state")).filter("state IS NOT NULL")


def shard_digests(entries: DataFrame, id_column: str, rows: int) -> DataFrame:
    """shard, n, digest: sha256 over the rows' hashes, in the order of ids, of each run of so many ids. A digest of the digests stands for the whole."""
    shard = F.floor(F.col(id_column) / rows).cast("long")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(id_column, "row_sha256"))), lambda r: r["row_sha256"])
    return entries.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


TRANSITIONS = {"PLANNED": ["RUNNING"], "RUNNING": ["RUNNING", "COMPLETE", "FAILED"], "COMPLETE": [], "FAILED": []}


def latest(log: DataFrame, run: str, order: list[str], *columns: str) -> DataFrame:
    """The last record of each run, by one aggregate without sorting."""
    return log.groupBy(run).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(run, "last.*")


def illegal_transitions(log: DataFrame, run: str, order: list[str], status: str, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Records whose status can't follow the one before; a run begins with the first status."""
    before = F.lag(status).over(W.partitionBy(run).orderBy(*order))
    first = next(iter(transitions))
    legal = F.when(before.isNull(), F.col(status) == first)
    for at, to in transitions.items():
        legal = legal.when(before == at, F.col(status).isin(to) if to else F.lit(False))
    return log.withColumn("before", before).withColumn("legal", legal.otherwise(False)).filter("NOT legal")


def inspect_outputs(planned: DataFrame, found: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """keys, state: VALID, INVALID or MISSING for what is planned, EXTRA for what is found besides."""
    a, b = planned.select(*keys).distinct().withColumn("_p", F.lit(True)), found.withColumn("_v", valid).groupBy(*keys).agg(F.bool_and("_v").alias("_v"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_p").isNull(), "EXTRA").when(F.col("_v").isNull(), "MISSING").when(F.col("_v"), "VALID").otherwise("INVALID").alias("state"))
