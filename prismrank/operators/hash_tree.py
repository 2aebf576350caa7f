"""An ordered hash tree over positions: two corpora are compared from the root down, and only below what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.sources.files import kept

#: Children of a node.
FANOUT = 1_000


def row_digest(position: str, columns: list[str]) -> Column:
    """sha256 over the position and the sha256 of each column, nulls as empty texts."""
    return F.sha2(F.concat_ws("|", F.col(position).cast("string"), *[F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256) for c in columns]), 256)


def leaves(rows: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """level 0: a leaf for each position, with the number of its rows; a repeated position has a digest over that number and the least and largest digest. A row without position is an error when it is read."""
    at = F.coalesce(F.col(position).cast("long"), F.raise_error(F.lit("a row without position")).cast("long"))
    per = rows.select(at.alias("node"), row_digest(position, columns).alias("d")).groupBy("node").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("z"))
    digest = F.when(F.col("n") == 1, F.col("a")).otherwise(F.sha2(F.concat_ws("|", "n", "a", "z"), 256))
    return per.select(F.lit(0).alias("level"), "node", "n", F.col("node").alias("low"), F.col("node").alias("high"), digest.alias("digest"))


def build(rows: DataFrame, position: str, columns: list[str], fanout: int = FANOUT) -> DataFrame:
    """level, node, n, low, high, digest: the tree of rows, written once, up to a level of one node at most.

    A node holds the positions from node * fanout^level on, and its digest is
    that of its children's digests in order: fanout of them at most, whatever
    the rows. Positions are 0 or more.
    """
    level = kept(leaves(rows, position, columns), "tree")
    levels, number = [level], 0
    while level.limit(2).count() > 1:
        number += 1
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])
        up = level.groupBy(F.expr(f"node DIV {fanout}").alias("node")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
        level = kept(up.select(F.lit(number).alias("level"), "node", "n", "low", "high", "digest"), "tree")
        levels.append(level)
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionAll(more)
    return tree


def height(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def differences(expected: DataFrame, found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """position, state, n_expected, n_found of the leaves that differ: MISSING, EXTRA, REPEATED (more rows than expected), FEWER or CHANGED.

    From the top, nodes are joined with what hangs below a difference only; the
    lower tree has nothing above its root, so the comparison begins with all
    nodes of that level.
    """
    top = min(height(expected), height(found))
    differ: DataFrame | None = None
    for level in range(top, -1, -1):
        sides = []
        for tree, name in ((expected, "expected"), (found, "found")):
            nodes = tree.filter(F.col("level") == level)
            if differ is not None:
                nodes = nodes.withColumn("up", F.expr(f"node DIV {fanout}")).join(differ.select(F.col("node").alias("up")), "up", "left_semi")
            sides.append(nodes.select("node", F.col("n").alias(f"n_{name}"), F.col("digest").alias(f"digest_{name}")))
        both = sides[0].join(sides[1], "node", "full")
        differ = kept(both.filter(~F.col("digest_expected").eqNullSafe(F.col("digest_found"))), "differ")
    state = (
        F.when(F.col("n_found").isNull(), "MISSING")
        .when(F.col("n_expected").isNull(), "EXTRA")
        .when(F.col("n_found") > F.col("n_expected"), "REPEATED")
        .when(F.col("n_found") < F.col("n_expected"), "FEWER")
        .otherwise("CHANGED")
    )
    return differ.select(F.col("node").alias("position"), state.alias("state"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_expected", "n_found")])


def edges(shards: DataFrame) -> DataFrame:
    """shard, low, high, n, edge, missing of shards(shard, low, high, n), a row for each: against all shards before it by low, START, JOINED, GAP (missing positions) or OVERLAP (positions less than 0 are shared)."""
    before = F.max("high").over(W.orderBy("low", "high", "shard").rowsBetween(W.unboundedPreceding, -1))  # a row a shard
    apart = F.col("low") - before - 1
    edge = F.when(before.isNull(), "START").when(apart == 0, "JOINED").when(apart > 0, "GAP").otherwise("OVERLAP")
    return shards.select("shard", "low", "high", "n", edge.alias("edge"), F.coalesce(apart, F.lit(0)).alias("missing"))
