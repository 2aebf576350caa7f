"""What a run begins with and goes on from: pinned sources, caches named by what they were made of, rows that are there already, and selections that hold what they must."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.operators import checks
from prismrank.sources import sealed
from prismrank.sources.files import write_new


def pinned(source: DataFrame, manifest: DataFrame, revision: str, key: str, text: str) -> DataFrame:
    """manifest(position, key, text_sha256) with the text of source(revision, key, text) at that revision only.

    A key that the revision lacks, or whose text has another digest, is an
    error when the row is read; a key that the revision has twice is one at
    once, and so is a revision without rows.
    """
    at = source.filter(F.col("revision") == revision).select(key, F.col(text).alias("_text"))
    if not at.limit(1).count():
        raise ValueError(f"the source has no revision {revision}")
    if twice := checks.duplicates(at, [key]).first():
        raise ValueError(f"{key} {twice[key]} is there {twice['n']} times at revision {revision}")
    both = manifest.join(at.withColumn("_there", F.lit(True)), key, "left")
    fault = F.when(F.col("_there").isNull(), "is missing from the pinned source").when(~F.sha2(F.col("_text"), 256).eqNullSafe(F.col("text_sha256")), "has another text at the pinned revision")
    told = F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" "), fault)
    return both.filter(F.when(fault.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).withColumnRenamed("_text", text).drop("_there")


def cache_identity(corpus_sha256: str, n_documents: int, config: dict, version: str) -> str:
    """The fingerprint of a cache: sha256 over the compact JSON, with keys in order, of the corpus it is of, how it is made and the version of that rule. Nothing of the machine or the files takes part."""
    if len(corpus_sha256) != 64 or set(corpus_sha256) - set("0123456789abcdef"):
        raise ValueError("a corpus is named by a sha256 in lower case")
    if not version.strip():
        raise ValueError("a cache needs the version of its rule")
    payload = {"config": config, "corpus": {"n_documents": n_documents, "sha256": corpus_sha256}, "version": version}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, name: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, written once under the fingerprint and read from there after; other fingerprints stay beside it. A cache that was left unfinished is no cache."""
    path = f"{folder}/{name}_{fingerprint}"
    if not sealed.there(spark, f"{path}/_SUCCESS"):
        made = make()
        made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def n_completed(there: DataFrame, role: str, pool: int, expected: int) -> int:
    """How many rows of there(position, role, candidates) a run has done: their positions must be 0, 1, ... once each, all of the role and with as many candidates as asked, and no more than expected. Anything else is an error, so that nothing is added to what is wrong."""
    seen = there.agg(
        F.count("*").alias("n"),
        F.countDistinct("position").alias("distinct"),
        F.min("position").alias("low"),
        F.max("position").alias("high"),
        F.count_if(~F.col("role").eqNullSafe(F.lit(role))).alias("role"),
        F.count_if(F.coalesce(F.size("candidates"), F.lit(-1)) != pool).alias("short"),
    ).first()
    if not seen["n"]:
        return 0
    if (seen["low"], seen["high"], seen["distinct"]) != (0, seen["n"] - 1, seen["n"]):
        raise ValueError("the rows that are there aren't contiguous")
    if seen["role"]:
        raise ValueError(f"{seen['role']} rows that are there have another role than {role}")
    if seen["short"]:
        raise ValueError(f"{seen['short']} rows that are there don't have {pool} candidates")
    if seen["n"] > expected:
        raise ValueError(f"{seen['n']} rows are there, {expected} expected")
    return seen["n"]


def resume(rows: DataFrame, path: str, role: str, pool: int, expected: int) -> int:
    """Append those of rows(position, role, candidates, ...) that aren't there yet, after what is there has been looked over; the number that was there."""
    spark = rows.sparkSession
    if not sealed.there(spark, path):
        write_new(rows, path)
        return 0
    done = n_completed(spark.read.schema(rows.schema).parquet(path), role, pool, expected)
    rows.filter(F.col("position") >= done).write.mode("append").parquet(path)
    return done


def selection_faults(pool: DataFrame, selected: DataFrame, conditions: list[str], k: int, native: str = "none") -> DataFrame:
    """query_id, condition, fault for every query of pool(query_id, doc_id, rank) and condition: null, or the first of MISSING, COUNT (not k), RANKS (not 1 to k), REPEATED, OUTSIDE (not of the pool) and NOT_NATIVE (the native condition isn't the pool's first k), of selected(query_id, condition, selected_rank, doc_id)."""
    place = F.struct("query_id", "doc_id")
    held = pool.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    per = (
        selected.join(held, ["query_id", "doc_id"], "left")
        .groupBy("query_id", "condition")
        .agg(
            F.count("*").alias("n"),
            F.countDistinct("selected_rank").alias("n_ranks"),
            F.min("selected_rank").alias("low"),
            F.max("selected_rank").alias("high"),
            F.countDistinct(place).alias("n_docs"),
            F.count_if(F.col("rank").isNull()).alias("outside"),
            F.bool_and(F.col("selected_rank") == F.col("rank")).alias("same"),
        )
    )
    every = pool.select("query_id").distinct().withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    fault = (
        F.when(F.col("n").isNull(), "MISSING")
        .when(F.col("n") != k, "COUNT")
        .when((F.col("n_ranks") != k) | (F.col("low") != 1) | (F.col("high") != k), "RANKS")
        .when(F.col("n_docs") != k, "REPEATED")
        .when(F.col("outside") > 0, "OUTSIDE")
        .when((F.col("condition") == native) & ~F.col("same"), "NOT_NATIVE")
    )
    return every.join(per, ["query_id", "condition"], "left").select("query_id", "condition", fault.alias("fault"))
