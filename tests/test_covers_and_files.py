"""Least covers against trying all, also of many aspects, and files of JSON objects."""

import itertools
import json
import os
import random
import time

import pytest

from prismrank.operators import aggregate, metrics, retrieval, workflow
from prismrank.sources import files


@pytest.mark.parametrize("seed", range(60))
def test_least_cover_by_brute_force(seed):
    rng = random.Random(seed)
    masks = [rng.getrandbits(9) & rng.getrandbits(9) for _ in range(rng.randrange(0, 10))]
    full = 0
    for m in masks:
        full |= m
    want = None
    if full:
        for want in range(1, len(masks) + 1):
            if any(_union(c) == full for c in itertools.combinations(masks, want)):
                break
    assert metrics.least_cover(masks) == want


def _union(masks):
    out = 0
    for m in masks:
        out |= m
    return out


def test_many_aspects_end_soon():
    rng = random.Random(3)
    began = time.time()
    planted = [sum(1 << i for i in range(64) if i % 8 == k) for k in range(8)]  # eight sets without overlap, among others
    others = [sum(1 << i for i in rng.sample(range(64), rng.randrange(3, 8))) for _ in range(42)]
    assert metrics.least_cover(planted + others) == 8
    for _ in range(5):
        masks = [sum(1 << i for i in rng.sample(range(64), rng.randrange(4, 14))) for _ in range(50)]
        assert metrics.least_cover(masks) >= len([i for i in range(64) if _union(masks) >> i & 1]) // 13
    assert time.time() - began < 60


def test_covers_of_queries(spark):
    rows = [(1, ["a", "b"]), (1, ["b", "c"]), (1, ["c", "a"]), (2, []), (3, ["x", "x"]), (3, ["x", "y"])]
    got = {r["query_id"]: (r["n_aspects"], r["cover"]) for r in metrics.min_set_cover(spark.createDataFrame(rows, "query_id long, aspects array<string>")).collect()}
    assert got == {1: (3, 2), 2: (0, None), 3: (2, 1)}


def test_files_of_objects(spark, tmp_path):
    whole = {
        "one.json": json.dumps({"id": 1, "parts": [{"k": "a"}, {"k": "b"}]}, indent=2),
        "two.json": json.dumps([{"id": 2, "parts": []}, {"id": 3, "parts": None, "more": 5}]),
        "broken.json": '[{"id": 4}, {"id": 5, "pa',
        "empty.json": "[]",
        "sub/unnamed.json": '{"parts": []}',
        "sub/nothing.json": "",
    }
    (tmp_path / "sub").mkdir()
    for name, text in whole.items():
        (tmp_path / name).write_text(text)
    schema = "id long, parts array<struct<k: string>>"
    got = {r["file"].rpartition("/")[2]: (r["n_objects"], r["state"]) for r in files.inspect_documents(spark, str(tmp_path), schema, "id").collect()}
    assert got == {"one.json": (1, "ARTIFACT"), "two.json": (2, "SEVERAL"), "broken.json": (0, "BROKEN"), "empty.json": (0, "EMPTY"), "unnamed.json": (1, "UNNAMED")}
    rows = files.json_documents(spark, str(tmp_path), schema).collect()
    assert sorted(r["id"] for r in rows if r["id"]) == [1, 2, 3] and [r["broken"] for r in rows if r["broken"]] == [whole["broken.json"]]
    assert [[p["k"] for p in r["parts"]] for r in rows if r["id"] == 1] == [["a", "b"]]


@pytest.mark.parametrize("rows", [7, 1000])
def test_ranks_and_positions_in_small_ranges(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(40)), i * 17 % 301) for i in range(301)]
    df = spark.createDataFrame(data, "k string, x double, i long").repartition(5)
    got = {r["i"]: r["rank"] for r in aggregate.average_rank(df, ["k"], "x", "rank", rows).collect()}
    for k, x, i in data:
        mine = [y for g, y, _ in data if g == k]
        assert got[i] == sum(y < x for y in mine) + (sum(y == x for y in mine) + 1) / 2
    assert {r["i"]: r["at"] for r in workflow.numbered(df, "i", "at", rows).collect()} == {i: i for i in range(301)}
    sizes = [r["count"] for r in workflow.ranged(df, ["i"], rows).groupBy("_range").count().collect()]
    assert max(sizes) <= max(3 * rows, 20) and sum(sizes) == 301
    assert workflow.numbered(df.limit(0), "i").count() == aggregate.average_rank(df.limit(0), ["k"], "x", "r").count() == 0


def test_what_is_written_in_between_can_be_removed(spark):
    held = files.kept(spark.range(5), "held")
    folder = held.inputFiles()[0].split("/held-")[0]
    assert spark.sparkContext.applicationId in folder and held.count() == 5
    files.clear(spark)
    assert not os.path.exists(folder.removeprefix("file://"))
    assert files.kept(spark.range(3), "held").count() == 3


def test_wide_and_unsound_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(9)] + [(None, [9.0, 9.0]), (20, None), (21, [None, 9.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, v array<double>")
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, v array<double>")
    small = retrieval.SHARD_BYTES
    try:
        retrieval.SHARD_BYTES = 32  # two vectors of two parts
        assert retrieval._n_shards(retrieval._sound(corpus, "doc_id")) == 5
        assert [(r["query_id"], r["doc_id"]) for r in retrieval.dense(corpus, asks, 3).orderBy("rank").collect()] == [(1, 8), (1, 7), (1, 6)]
        assert [(r["query_id"], r["doc_id"]) for r in retrieval.max_sim(corpus, asks, 2).orderBy("rank").collect()] == [(1, 8), (1, 7)]
    finally:
        retrieval.SHARD_BYTES = small
