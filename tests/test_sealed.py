"""Files by position and their seal: lost, altered, repeated and added rows, edges of shards, and lookups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prismrank.operators import hash_tree
from prismrank.sources import sealed

SCHEMA = "id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_tree_by_hand(spark):
    rows = [(i, f"t{i}") for i in (0, 1, 3, 8, 9)]
    tree = {(r["level"], r["node"]): r for r in hash_tree.build(table(spark, rows), "id", ["text"], 3).collect()}
    leaf = {i: digest(f"{i}|{digest(t)}") for i, t in rows}
    one = {0: digest(leaf[0] + leaf[1]), 1: digest(leaf[3]), 2: digest(leaf[8]), 3: digest(leaf[9])}
    two = {0: digest(one[0] + one[1] + one[2]), 1: digest(one[3])}
    assert {n: r["digest"] for (level, n), r in tree.items() if level == 1} == one
    assert {n: r["digest"] for (level, n), r in tree.items() if level == 2} == two
    assert tree[3, 0]["digest"] == digest(two[0] + two[1]) and (tree[3, 0]["n"], tree[3, 0]["low"], tree[3, 0]["high"]) == (5, 0, 9)
    assert max(level for level, _ in tree) == 3


@pytest.mark.parametrize("seed", range(3))
def test_differences_are_traced_to_their_leaf(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"t{i % 5}") for i in range(200)]
    lost, altered, twice = (set(rng.sample(range(200), 4)) for _ in range(3))
    other = [(i, t + "!" if i in altered else t) for i, t in rows if i not in lost]
    other += [r for r in other if r[0] in twice] + [(5000 + seed, "new")]
    a, b = (hash_tree.build(table(spark, x), "id", ["text"], 4) for x in (rows, other))
    got = {r["position"]: r["state"] for r in hash_tree.differences(a, b, 4).collect()}
    want = dict.fromkeys(altered, "CHANGED") | dict.fromkeys(twice, "REPEATED") | dict.fromkeys(lost, "MISSING") | {5000 + seed: "EXTRA"}
    assert got == want
    assert hash_tree.differences(a, a, 4).count() == 0
    back = {r["position"]: (r["state"], r["n_expected"], r["n_found"]) for r in hash_tree.differences(b, a, 4).collect()}
    assert all(back[i] == ("FEWER", 2, 1) for i in twice - lost)


def test_empty_and_bad_rows(spark):
    none = hash_tree.build(table(spark, []), "id", ["text"], 4)
    some = hash_tree.build(table(spark, [(3, None)]), "id", ["text"], 4)
    assert none.count() == 0
    assert [tuple(r) for r in hash_tree.differences(some, none, 4).collect()] == [(3, "MISSING", 1, 0)]
    assert [tuple(r) for r in hash_tree.differences(none, some, 4).collect()] == [(3, "EXTRA", 0, 1)]
    with pytest.raises(Exception, match="without position"):
        hash_tree.build(table(spark, [(None, "x")]), "id", ["text"], 4)


def test_edges(spark):
    shards = spark.createDataFrame([("a", 0, 9, 10), ("b", 10, 19, 10), ("c", 25, 30, 6), ("d", 28, 29, 2), ("e", 31, 40, 10)], "shard string, low long, high long, n long")
    assert {r["shard"]: (r["edge"], r["missing"]) for r in hash_tree.edges(shards).collect()} == {"a": ("START", 0), "b": ("JOINED", 0), "c": ("GAP", 5), "d": ("OVERLAP", -3), "e": ("JOINED", 0)}


def test_lookup_opens_few_files(spark, tmp_path):
    at = f"{tmp_path}/p"
    sealed.write_positions(table(spark, [(i * 2, f"t{i}") for i in range(100)]).withColumn("extra", F.lit(1)), at, "id", 20)
    assert [(r["run"], r["low"], r["high"], r["n"]) for r in sealed.runs(spark, at).orderBy("run").limit(2).collect()] == [(0, 0, 18, 10), (1, 20, 38, 10)]
    wanted = spark.createDataFrame([(2, "a"), (198, "b"), (2, "c")], "id long, mark string")
    found = sealed.lookup(spark, at, SCHEMA, wanted, "id")
    assert sorted((r["mark"], r["text"]) for r in found.collect()) == [("a", "t1"), ("b", "t99"), ("c", "t1")]
    assert sum("run_of_positions" in f for f in found.inputFiles()) == 2
    for missing in (3, 9999):
        with pytest.raises(Exception, match="no match"):
            sealed.lookup(spark, at, SCHEMA, spark.createDataFrame([(missing,)], "id long"), "id").collect()
    assert sealed.lookup(spark, at, SCHEMA, wanted.limit(0), "id").count() == 0


def test_repeated_or_missing_positions_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="position 4 is there 2 times"):
        sealed.write_positions(table(spark, [(4, "a"), (5, "b"), (4, "c")]), f"{tmp_path}/p", "id", 3)
    assert not sealed.there(spark, f"{tmp_path}/p/runs")
    with pytest.raises(Exception, match="without position"):
        sealed.write_positions(table(spark, [(None, "a")]), f"{tmp_path}/q", "id", 3)


def test_tables_by_name(spark, tmp_path):
    paths = {n: f"{tmp_path}/{n}" for n in "ab"}
    for n, path in paths.items():
        sealed.write_positions(table(spark, [(i, n + str(i)) for i in range(5)]), path, "id", 2)
    wanted = spark.createDataFrame([("a", 1), ("b", 1), ("b", 4)], "name string, id long")
    assert sorted(r["text"] for r in sealed.lookup_in(spark, paths, SCHEMA, wanted, "id").collect()) == ["a1", "b1", "b4"]
    with pytest.raises(KeyError, match="no table of the name c"):
        sealed.lookup_in(spark, paths, SCHEMA, wanted.union(spark.createDataFrame([("c", 1)], wanted.schema)), "id")


def test_seal_is_kept_and_broken(spark, tmp_path):
    at, rows = f"{tmp_path}/s", [(i, f"t{i}") for i in range(50)]
    sealed.seal(table(spark, rows), at, "id", 10, 4)
    sealed.seal(table(spark, rows), at, "id", 10, 4)
    with pytest.raises(FileExistsError):
        sealed.seal(table(spark, rows[:-1]), at, "id", 10, 4)
    assert sealed.read_verified(spark, at, SCHEMA, "id", 4).count() == 50
    spark.createDataFrame([(33, "t33", 3)], SCHEMA + ", run_of_positions long").write.partitionBy("run_of_positions").mode("append").parquet(f"{at}/rows")
    with pytest.raises(ValueError, match="position 33 of .* is REPEATED"):
        sealed.read_verified(spark, at, SCHEMA, "id", 4)
