"""Steps whose memory or time grew faster than they need: they give what plain versions give, in bounded pieces."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.operators import aggregate, metrics, postings, workflow
from prismrank.sources import files


def test_poisson_weights_by_leading_bits():
    hashes = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    z = hashes[:, None] + (np.arange(70, 1070, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    plain = np.searchsorted(aggregate._POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
    assert (aggregate.poisson_weights(hashes, 70, 1000) == plain).all() and plain.max() > 4
    assert (aggregate._LEADING == 255).sum() <= len(aggregate._POISSON)


def test_bootstrap_of_ids_in_several_groups(spark):
    """Rows of one id share the weights, whatever their number and groups; values that are null are left out."""
    rng = np.random.default_rng(2)
    rows = [(int(i), str(g), float(v)) for i in range(90) for g, v in zip(rng.choice(list("abc"), 3), rng.normal(3, 1, 3), strict=True)] + [(1, "a", None)]
    df = spark.createDataFrame(rows, "i long, k string, x double")
    got = {r["k"]: r for r in aggregate.bootstrap_mean(df, ["k"], "i", "x", 100, 7).collect()}
    hashes = {r["i"]: r["h"] for r in df.select("i", F.xxhash64("i", F.lit(7)).alias("h")).distinct().collect()}
    for g in "abc":
        mine = [(i, v) for i, of, v in rows if of == g and v is not None]
        w = aggregate.poisson_weights(np.array([hashes[i] for i, _ in mine]).view(np.uint64), 0, 100).astype(float)
        low, high = np.percentile(np.array([v for _, v in mine]) @ w / w.sum(0), [2.5, 97.5])
        assert got[g]["n"] == len(mine) and (got[g]["low"], got[g]["high"]) == (pytest.approx(low), pytest.approx(high))


def test_ranges_of_wide_rows(spark, monkeypatch):
    """Few rows with long texts make several ranges, so that no task has all texts."""
    monkeypatch.setattr(workflow, "RANGE_BYTES", 20_000)
    docs = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("y")).alias("a"))
    sizes = [r["count"] for r in workflow.ranged(docs, ["id"]).groupBy("_range").count().collect()]
    assert len(sizes) >= 5 and sum(sizes) == 100
    assert [r["at"] for r in workflow.numbered(docs, "id", "at").orderBy("id").collect()] == list(range(100))


def test_parts_of_an_index_are_small(spark):
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    assert max(r["n"] for r in postings.build(docs).lists.collect()) <= 2048
    long = spark.range(64).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40_000).alias("text"))
    assert postings.build(long, block_docs=8).lists.count() > 1


def test_gold_by_label_without_pairs(spark):
    rng = np.random.default_rng(3)
    labels = [None if x == 4 else int(x) for x in rng.integers(0, 5, 60)] + [9]
    corpus = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label long")
    queries = corpus.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "label").unionAll(spark.createDataFrame([(1000, 2)], "query_id long, label long"))
    ranked = spark.createDataFrame([(q, r, int(d)) for q in [*range(0, 61, 5), 1000] for r, d in enumerate(rng.permutation(61)[:8], 1)], "query_id long, rank int, doc_id long")
    pairs = queries.join(corpus, "label").filter("query_id <> doc_id").select("query_id", "doc_id")
    judged, gold = metrics.same_label(ranked, corpus, queries)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(metrics.retrieval_metrics(ranked, pairs, 5))
    assert rows(metrics.metrics_of(judged, gold, 5)) == want and 5 < len(want) < 14
    assert judged.count() == ranked.count()


@pytest.mark.parametrize("rows", [7, 1000])
def test_running_sums(spark, rows):
    df = spark.range(101).select((F.col("id") * 37 % 101).alias("i")).withColumn("n", F.when(F.col("i") % 4 == 0, 0).otherwise(F.col("i") % 5))
    amounts = [0 if i % 4 == 0 else i % 5 for i in range(101)]
    assert [r["at"] for r in workflow.running(df, ["i"], "n", "at", rows).orderBy("i").collect()] == [sum(amounts[:i]) for i in range(101)]


def test_gold_groups_of_repeated_samples(spark):
    """Sections of rows with one id are one sample's; every position is one document's."""
    samples = spark.createDataFrame([(2, ["c", "d"], [3, 4]), (1, ["a"], [1]), (1, ["b", "e"], [2, 5]), (4, [], [])], "id long, body array<string>, kind array<int>")
    documents, groups = workflow.gold_groups(samples, "id", "body", "kind")
    assert {r["sample"]: r["gold_ids"] for r in groups.collect()} == {1: [0, 1, 2], 2: [3, 4], 4: []}
    assert [(r["corpus_position"], r["sample"]) for r in documents.orderBy("corpus_position").collect()] == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_files_are_inspected_in_one_scan(spark, tmp_path):
    """Sums of a file's objects come with its state; files are put in place by name."""
    at = str(tmp_path / "out")
    texts = [(1, '[{"id": 1, "x": 4},\n{"id": 2, "x": 9}]'), (2, '[{"id": 3, "x"'), (3, "[ ]"), (4, '[{"x": 5}]')]
    files.write_texts(spark.createDataFrame(texts, "name long, value string"), at, "name")
    found = files.inspect_documents(spark, at, "id long, x long", "id", most=F.max("x"))
    assert {r["file"].split("name=")[1][0]: (r["n_objects"], r["state"], r["most"]) for r in found.collect()} == {"1": (2, "SEVERAL", 9), "2": (0, "BROKEN", None), "3": (0, "EMPTY", None), "4": (1, "UNNAMED", 5)}


def test_files_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """Many small files are written by many tasks, although they have few bytes, and each file is there once."""
    monkeypatch.setattr(files, "FILES_A_TASK", 25, raising=False)
    at = tmp_path / "out"
    files.write_texts(spark.range(300).select(F.col("id").alias("name"), F.concat(F.lit("text "), "id").alias("value")), str(at), "name")
    written = sorted(at.rglob("name=*/part-*.txt"))
    assert {f.parent.name: f.read_text() for f in written} == {f"name={i}": f"text {i}\n" for i in range(300)} and len(written) == 300
    tasks = Counter(f.name.split("-")[1] for f in written)
    assert len(tasks) >= 9 and max(tasks.values()) <= 75


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    """More folders than tasks; the session's setting is as before."""
    at, key = str(tmp_path / "out"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    files.write_texts(spark.range(100).select(F.col("id").alias("name"), F.format_string('{"id": %d}', "id").alias("value")), at, "name")
    before, sc = spark.conf.get(key), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        states = files.inspect_documents(spark, at, "id long", "id")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 8 * sc.defaultParallelism < 100
    assert spark.conf.get(key) == before
    assert [tuple(r) for r in states.groupBy("state").count().collect()] == [("ARTIFACT", 100)]


def test_folders_are_inspected_one_at_a_time(spark, tmp_path, monkeypatch):
    """No listing has the files of all folders; states are those of one look at all. Without files there are no states."""
    monkeypatch.setattr(files, "FILES_A_FOLDER", 20)
    listed, inspect = [], files.inspect_documents
    monkeypatch.setattr(files, "inspect_documents", lambda spark, path, *a, **more: listed.append(path) or inspect(spark, path, *a, **more))
    text = F.when(F.col("id") % 3 == 0, "[ ]").when(F.col("id") % 3 == 1, '[{"id": 1,').otherwise(F.format_string('[{"id": %d, "x": 1}, {"id": 0, "x": %d}]', "id", "id"))
    at, none = str(tmp_path / "out"), str(tmp_path / "none")
    files.write_texts(spark.range(100).select(F.col("id").alias("name"), text.alias("value")), at, "name")
    rows = lambda df: sorted((r["file"].rpartition("name=")[2].split("/")[0], r["n_objects"], r["state"], r["most"] or 0) for r in df.collect())
    got = rows(files.inspect_folders(spark, at, "id long, x long", "id", most=F.max("x")))
    assert got == rows(inspect(spark, at, "id long, x long", "id", most=F.max("x"))) and len(got) == 100
    assert got == sorted((str(i), [0, 0, 2][i % 3], ["EMPTY", "BROKEN", "SEVERAL"][i % 3], i if i % 3 == 2 else 0) for i in range(100))
    assert len(listed) >= 4 and all("folder=" in p for p in listed)
    files.write_texts(spark.range(0).select(F.col("id").alias("name"), F.lit("").alias("value")), none, "name")
    assert files.inspect_folders(spark, none, "id long", "id").collect() == []
