"""Connected components of an edge table, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import materialize

#: Rounds after which labels that still change are an error; labels spread by doubling, so a chain of 2^n nodes takes about n.
MOST_ROUNDS = 60


def star_edges(members: list[int]) -> list[tuple[int, int]]:
    """Edges that connect the members, each with the first: groups that overlap give the same edges again, which distinct() drops."""
    return [(m, members[0]) for m in members[1:]]


class Union:
    """Components of a few nodes, in memory."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def members(self) -> list[list[int]]:
        found: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            found.setdefault(self.find(i), []).append(i)
        return list(found.values())


def components(edges: DataFrame) -> DataFrame:
    """node and component, its least node, of each node in edges(a long, b long).

    Every node points to a node of its component. In a round it looks at what
    its neighbours' targets point to; the least of these is offered to it and
    to its own target, so that whole trees hook onto others, and it moves to
    its target's target, which halves paths. Aggregates combine in each task
    first; every round is written, so a lost executor repeats one.
    """
    one_way = edges.filter("a <> b").select("a", "b")
    both = materialize(one_way.unionAll(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        aimed = materialize(labels.join(far, "component").select("node", "component", "far"), "aimed")
        beside = both.join(aimed.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("least"))
        offers = aimed.join(beside, "node").select("node", "component", F.least("far", "least").alias("offer"), "least")
        told = offers.select("node", F.col("offer").alias("to")).unionAll(offers.select(F.col("component").alias("node"), F.col("least").alias("to")))
        moved = labels.join(told.groupBy("node").agg(F.min("to").alias("to")), "node")
        after = materialize(moved.select("node", F.least("component", "to").alias("component"), (F.col("to") < F.col("component")).alias("changed")), "labels")
        labels = after.select("node", "component")
        if not after.filter("changed").limit(1).count():
            return labels
    raise RuntimeError("components didn't settle")
