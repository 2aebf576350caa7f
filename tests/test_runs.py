"""Pinned sources, caches by identity, resumed runs, invariants of selections, and gold groups: what they refuse."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from prismrank.operators import runs
from prismrank.operators import workflow as V


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_pinned_source(spark):
    source = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 3, None)], "revision string, id long, text string")
    manifest = lambda *rows: spark.createDataFrame(rows, "position long, id long, text_sha256 string")
    assert [tuple(r) for r in runs.pinned(source, manifest((0, 2, sha("y"))), "a", "id", "text").select("position", "id", "text").collect()] == [(0, 2, "y")]
    for rows, revision, why in (([(0, 1, sha("x"))], "b", "id 1 has another text"), ([(0, 3, sha("x"))], "a", "id 3 is missing"), ([(0, 3, sha(""))], "b", "id 3 has another text")):
        with pytest.raises(Exception, match=why):
            runs.pinned(source, manifest(*rows), revision, "id", "text").collect()
    with pytest.raises(ValueError, match="no revision c"):
        runs.pinned(source, manifest(), "c", "id", "text")
    with pytest.raises(ValueError, match="id 2 is there 2 times"):
        runs.pinned(source.unionAll(source.filter("id = 2")), manifest(), "a", "id", "text")


def test_cache_identity(spark, tmp_path):
    config = {"b": [1, 2], "a": "é"}
    one = runs.cache_identity("0" * 64, 3, config, "1")
    payload = {"config": config, "corpus": {"n_documents": 3, "sha256": "0" * 64}, "version": "1"}
    assert one == sha(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    assert one == runs.cache_identity("0" * 64, 3, dict(reversed(config.items())), "1")
    assert len({one, runs.cache_identity("1" * 64, 3, config, "1"), runs.cache_identity("0" * 64, 4, config, "1"), runs.cache_identity("0" * 64, 3, config, "2"), runs.cache_identity("0" * 64, 3, {}, "1")}) == 5
    for bad in (("ABC", 3, config, "1"), ("0" * 64, 3, config, " "), ("0" * 64, 3, {"x": float("nan")}, "1")):
        with pytest.raises(ValueError):
            runs.cache_identity(*bad)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert runs.cached(spark, str(tmp_path), "v", one, make).count() == runs.cached(spark, str(tmp_path), "v", one, make).count() == 3 and len(made) == 1
    (tmp_path / f"v_{one}" / "_SUCCESS").unlink()
    assert runs.cached(spark, str(tmp_path), "v", one, make).count() == 3 and len(made) == 2


def rows(spark, *positions, role="test", pool=2):
    return spark.createDataFrame([(p, role, list(range(pool))) for p in positions], "position long, role string, candidates array<int>")


def test_resumed_runs(spark, tmp_path):
    path = f"{tmp_path}/run"
    assert runs.resume(rows(spark, 0, 1, 2), path, "test", 2, 5) == 0
    assert runs.resume(rows(spark, *range(5)), path, "test", 2, 5) == 3
    assert runs.resume(rows(spark, *range(5)), path, "test", 2, 5) == 5
    assert sorted(r["position"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    assert runs.n_completed(rows(spark), "test", 2, 5) == 0
    wrong = {"contiguous": [rows(spark, 0, 2), rows(spark, 1, 2), rows(spark, 0, 1, 1), rows(spark, None, 0)], "role": [rows(spark, 0, role="x"), rows(spark, 0, role=None)], "candidates": [rows(spark, 0, pool=3), rows(spark, 0).withColumn("candidates", F.lit(None).cast("array<int>"))], "expected": [rows(spark, *range(6))]}
    for why, all_ in wrong.items():
        for there in all_:
            with pytest.raises(ValueError, match=why):
                runs.n_completed(there, "test", 2, 5)


def test_faults_of_selections(spark):
    pool = spark.createDataFrame([(q, q * 10 + i, i) for q in (1, 2, 3) for i in (1, 2, 3, 4)], "query_id long, doc_id long, rank int")
    good = {1: [11, 12], 2: [21, 22], 3: [31, 32]}
    chosen = lambda lists, condition: [(q, condition, i, d) for q, ds in lists.items() for i, d in enumerate(ds, 1)]
    data = chosen(good, "none") + chosen({1: [14, 11], 2: [23], 3: [33, 33]}, "a") + chosen({1: [12, 11], 2: [21, 31]}, "b") + [(3, "b", 1, 31), (3, "b", 3, 32)]
    selected = spark.createDataFrame(data, "query_id long, condition string, selected_rank int, doc_id long")
    got = {(r["query_id"], r["condition"]): r["fault"] for r in runs.selection_faults(pool, selected, ["none", "a", "b"], 2).collect()}
    assert got == {(1, "none"): None, (2, "none"): None, (3, "none"): None, (1, "a"): None, (2, "a"): "COUNT", (3, "a"): "REPEATED", (1, "b"): None, (2, "b"): "OUTSIDE", (3, "b"): "RANKS"}
    other = runs.selection_faults(pool, selected.filter("condition = 'b'").withColumn("condition", F.lit("none")), ["none", "c"], 2)
    assert {(r["query_id"], r["condition"]): r["fault"] for r in other.collect() if r["query_id"] == 1} == {(1, "none"): "NOT_NATIVE", (1, "c"): "MISSING"}


def test_gold_groups(spark):
    samples = lambda *r: spark.createDataFrame(r, "id long, body array<string>, kind array<string>")
    documents, groups = V.gold_groups(samples((7, [" a ", "b"], ["x", "y"]), (3, ["c"], ["z"]), (5, [], [])), "id", "body", "kind")
    assert [tuple(r) for r in documents.select("corpus_position", "sample", "section", "label", "text").orderBy("corpus_position").collect()] == [(0, 3, 0, "z", "c"), (1, 7, 0, "x", "a"), (2, 7, 1, "y", "b")]
    assert {r["sample"]: r["gold_ids"] for r in groups.collect()} == {3: [0], 5: [], 7: [1, 2]}
    for bad, why in (((1, ["a"], []), "differ in number"), ((1, ["a", " \n"], ["x", "y"]), "blank"), ((1, [None], ["x"]), "blank"), ((1, None, ["x"]), "differ in number")):
        with pytest.raises(Exception, match=why):
            V.gold_groups(samples(bad), "id", "body", "kind")[1].collect()
    with pytest.raises(ValueError, match="none of the columns"):
        V.first_column(groups, "x", "y")
