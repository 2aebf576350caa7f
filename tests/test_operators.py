import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.functions import text as X
from prismrank.operators import aggregate, checks, metrics, retrieval, selection
from prismrank.sources import files
from prismrank.streaming import progress


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_normalisers_differ_in_their_order(spark):
    t = F.col("t")
    assert one(spark, X.normalize_answer(t), t="a-b") == "b" and one(spark, X.normalize_answer_official(t), t="a-b") == "ab"
    assert one(spark, X.normalize_answer(t), t=" The  Cat! ") == "cat"


@pytest.mark.parametrize(("p", "g", "f1", "rouge"), [("", "", 1.0, 0.0), ("x", "", 0.0, 0.0), ("b c d", "c d e", 2 / 3, 2 / 3), ("x x y", "x y y", 2 / 3, 2 / 3), ("d c", "c d", 1.0, 0.5)])
def test_answer_scores(spark, p, g, f1, rouge):
    words = spark.createDataFrame([(p, g)], "p string, g string").select(X.answer_words(F.col("p")).alias("p"), X.answer_words(F.col("g")).alias("g"))
    row = words.select(X.token_f1(F.col("p"), F.col("g")).alias("f"), X.rouge_l("p", "g").alias("r")).first()
    assert row["f"] == pytest.approx(f1) and row["r"] == pytest.approx(rouge)


def test_longest_common_subsequence_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert X.longest_common(a, b) == table[-1][-1]


def test_parsers_and_status(spark):
    t = F.col("t")
    parse = X.parse_line(t, "Decision", ["yes", "no", "maybe"])
    assert one(spark, parse, t="x\r\nDecision: yes \t\r\ny") == "yes"
    assert one(spark, parse, t="Decision: yes\nDecision: no") is None and one(spark, parse, t="Decision: so") is None
    assert one(spark, X.parse_whole(t, "Answer"), t=" answer: a\nb ") == "a\nb"
    status = X.classify_response(F.lit(None).cast("string"), F.lit(" LENGTH "), t, t)
    assert one(spark, status, t="x") == "TRUNCATED"
    assert one(spark, X.classify_response(F.lit(None).cast("string"), F.lit("stop"), t, F.lit(None)), t="I cannot help with that.") == "REFUSAL"


def test_sentences_go_on_after_abbreviations(spark):
    assert one(spark, X.sentences(F.col("t")), t="See e.g. this. J. R. Smith came etc. Next. Done!") == ["See e.g. this.", "J. R. Smith came etc. Next.", "Done!"]
    assert one(spark, X.sentences(F.col("t")), t="  ") == []


def test_context_round_trip(spark):
    block = X.context_block(F.split("t", ";"))
    assert one(spark, block, t="a;b") == "[Document 1]\na\n\n[Document 2]\nb"
    assert one(spark, X.split_context(block), t="a;b") == ["a", "b"]


def test_conditions():
    assert selection.parse_condition("mmr_0.25") == selection.Condition("mmr", 0.25)
    for bad in ("mmr_2", "kmeans_k0", "nothing", "dpp_seed"):
        with pytest.raises(ValueError):
            selection.parse_condition(bad)
    assert not selection.is_diversified("none") and selection.is_diversified("dpp_map")


def pool(n=20, seed=0):
    rng = np.random.default_rng(seed)
    return np.sort(rng.random(n))[::-1].copy(), rng.standard_normal((n, 8))


@pytest.mark.parametrize("seed", range(5))
def test_selection_by_brute_force(seed):
    score, v = pool(seed=seed)
    assert selection.select_one("mmr_1", score, v, 5) == selection.select_one("none", score, v, 5) == [0, 1, 2, 3, 4]
    assert selection.select_one("kmeans_k1", score, v, 5) == [0, 1, 2, 3, 4]
    unit, rel = selection.unit_rows(v), selection.scaled(score)
    got, want = selection.select_one("mmr_0.5", score, v, 5), [0]
    while len(want) < 5:
        want.append(max((i for i in range(20) if i not in want), key=lambda i: (0.5 * rel[i] - 0.5 * max(float(unit[i] @ unit[j]) for j in want), -i)))
    assert got == want
    kernel = selection.dpp_kernel(rel, unit)
    want = []
    while len(want) < 5:
        want.append(max((i for i in range(20) if i not in want), key=lambda i: np.linalg.det(kernel[np.ix_([*want, i], [*want, i])])))
    assert selection.select_one("dpp_map", score, v, 5) == want
    for name in ("kmeans_k3", "agglo_k3", "dpp_seed1"):
        chosen = selection.select_one(name, score, v, 5)
        assert len(set(chosen)) == 5 and set(chosen) <= set(range(20))


def test_ward_merges_what_is_close():
    v = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [50, 50]])
    labels = selection.ward_labels(v, 3)
    assert labels[0] == labels[1] != labels[2] == labels[3] != labels[4]
    with pytest.raises(ValueError):
        selection.ward_labels(v, 6)


def test_k_dpp_samples_by_determinant():
    kernel = np.diag([1.0, 2.0, 3.0])
    count = {}
    for seed in range(3000):
        s = tuple(sorted(selection.dpp_sample(kernel, 2, seed)))
        count[s] = count.get(s, 0) + 1
    for s, d in {(0, 1): 2, (0, 2): 3, (1, 2): 6}.items():
        assert count[s] / 3000 == pytest.approx(d / 11, abs=0.03)


def test_bad_vectors_and_equal_scores():
    score, v = pool(5)
    with pytest.raises(ValueError):
        selection.select_one("mmr_0", score, np.zeros((5, 8)), 3)
    assert selection.scaled(np.full(4, 7.0)).tolist() == [1.0] * 4
    assert selection.select_one("mmr_0.5", np.full(5, 1.0), v, 3)[0] == 0


def test_bm25_pads_with_unmatched_documents(spark):
    corpus = spark.createDataFrame([(0, "x y"), (1, "z"), (2, "q"), (3, None), (4, "z z w")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "z"), (8, "nothing")], "query_id long, text string")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.bm25(corpus, queries, 4).collect()}
    assert [got[8, i] for i in range(1, 5)] == [0, 1, 2, 3]
    assert {got[7, 1], got[7, 2]} == {1, 4} and [got[7, 3], got[7, 4]] == [0, 2]


def test_dense_ties_and_self(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)] + [(9, [0.0, 1.0])], "doc_id long, v array<double>")
    queries = corpus.filter("doc_id = 1").select(F.col("doc_id").alias("query_id"), "v")
    assert [r["doc_id"] for r in retrieval.dense(corpus, queries, 3).orderBy("rank").collect()] == [0, 2, 3]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 6), (1, 9), (2, 4)], "query_id long, doc_id long")
    got = {r["query_id"]: r for r in metrics.retrieval_metrics(ranked, qrels, 3).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and got[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[2]["recall"] == got[2]["mrr"] == got[2]["ndcg"] == 0
    passages = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"]), (1, 3, ["b", "c"]), (1, 4, ["d"])], "query_id long, doc_id long, aspects array<string>")
    assert metrics.min_set_cover(passages).first()["cover"] == 3
    assert metrics.ideal_alpha_dcg(passages, 0.0).first()["idcg"] == pytest.approx(2 + 2 / math.log2(3) + 1 / 2 + 1 / math.log2(5))
    single = spark.createDataFrame([(1, 1, [1.0])], "q int, r int, v array<double>")
    assert metrics.pairwise_diversity(single, ["q"], "r").first()["diversity"] is None


def test_aggregates(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, item int")
    observed = spark.createDataFrame([("a", 1, 1.0, "measured"), ("a", 2, None, "failed")], "k string, item int, value double, status string")
    got = {r["k"]: r for r in aggregate.status_summary(expected, observed, ["k"], "item").collect()}
    assert (got["a"]["n_expected"], got["a"]["n_present"], got["a"]["n_measured"], got["a"]["n_missing"], got["a"]["mean"], got["a"]["std"]) == (3, 2, 1, 1, 1.0, None)
    assert got["b"]["mean"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.select(aggregate.pearson(F.col("x"), F.col("y")).alias("r")).first()["r"] is None
    rng = np.random.default_rng(3)
    rows = [(int(i), float(x)) for i, x in enumerate(rng.normal(1.0, 1.0, 400))]
    interval = aggregate.bootstrap_mean(spark.createDataFrame(rows, "id long, x double"), [], "id", "x", 400).first()
    half = 1.96 * np.std([x for _, x in rows]) / 20
    assert interval["low"] == pytest.approx(interval["mean"] - half, abs=0.03) and interval["high"] == pytest.approx(interval["mean"] + half, abs=0.03)


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [3, 1, 3, 2, 3]] + [(None, 5.0)], "k string, x double")
    got = sorted((str(r["k"]), r["x"], r["rank"]) for r in aggregate.average_rank(df, ["k"], "x", "rank").collect())
    assert got == [("None", 5.0, 1.0), ("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 3.0, 4.0), ("g", 3.0, 4.0), ("g", 3.0, 4.0)]


def test_checks(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        checks.require_match(left, right, ["k"]).collect()
    assert checks.unknown(left, right, ["k"]).first()["k"] == 2
    log = spark.createDataFrame([("r", 1, "PLANNED"), ("r", 2, "RUNNING"), ("r", 3, "PLANNED"), ("s", 1, "COMPLETE")], "run string, seq int, status string")
    assert {(r["run"], r["seq"]) for r in checks.illegal_transitions(log, "run", ["seq"], "status").collect()} == {("r", 3), ("s", 1)}
    assert {(r["run"], r["status"]) for r in checks.latest(log, "run", ["seq"], "status").collect()} == {("r", "PLANNED"), ("s", "COMPLETE")}


def test_files_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string")
    files.write_shards(rows, f"{tmp_path}/shards", "id", 3)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 10
    files.write_same_or_new(rows, f"{tmp_path}/same", "id")
    files.write_same_or_new(rows, f"{tmp_path}/same", "id")
    with pytest.raises(FileExistsError):
        files.write_same_or_new(rows.limit(3), f"{tmp_path}/same", "id")
    with pytest.raises(Exception, match="exists"):
        files.write_new(rows, f"{tmp_path}/same")
    files.append_missing(rows.union(spark.createDataFrame([(99, "new")], rows.schema)), f"{tmp_path}/same", ["id"])
    assert spark.read.parquet(f"{tmp_path}/same").count() == 11
    rows.write.json(f"{tmp_path}/j")
    assert files.jsonl(spark, f"{tmp_path}/j", "id long, text string").count() == 10
    (tmp_path / "in").mkdir()
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/t.parquet")
    for _ in range(2):
        stream = progress.read_table(spark, f"{tmp_path}/in", "t", rows.schema)
        progress.produce_missing(stream, f"{tmp_path}/out", ["id"], lambda d: d.withColumn("n", F.length("text")), f"{tmp_path}/log").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_matching_words(spark):
    from prismrank.functions import matching
    from prismrank.operators import workflow

    assert matching.normal_tokens("O’Connor's (dog-house) 'x' É") == ["O'Connor's", "dog", "house", "x", "É"]
    assert matching.normal_tokens(None) == [] and matching.normal_tokens("é") == ["é"]
    df = spark.createDataFrame([("In May we may go", "May", True), ("we may go", "May", False), ("STRASSE eins", "Straße Eins", True), ("a bc", "b c", False), ("x", "", False)], "p string, a string, want boolean")
    got = df.select("want", matching.alias_matches(matching.tokens_udf("p"), matching.folded_udf("p"), matching.tokens_udf("a"), matching.folded_udf("a")).alias("got"))
    assert all(r["got"] == r["want"] for r in got.collect())
    ids = spark.createDataFrame([("wiki:12",), ("7",), ("x",)], "i string").select(workflow.plain_id(F.col("i")).alias("n"))
    assert [r["n"] for r in ids.collect()] == [12, 7, None]
    positions = {r["id"]: r["corpus_position"] for r in workflow.numbered(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "id long"), "id").collect()}
    assert positions == {i: i for i in range(50)}


def test_model_calls_are_tried_again_on_lost_connections_only(spark):
    from prismrank.operators import workflow

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, q string").coalesce(1)
    assert {r["o"] for r in workflow.map_model(rows, lambda qs: [q.upper() for q in qs], "q", "o").collect()} == {"A", "B"}

    def lost(_):
        raise ConnectionError

    assert {r["o"] for r in workflow.map_model(rows, lost, "q", "o").collect()} == {None}
    score = spark.createDataFrame([("OK",), ("REFUSAL",), ("ERROR",)], "s string").select(workflow.row_score(F.lit(0.5), F.col("s")).alias("v"))
    assert [r["v"] for r in score.collect()] == [0.5, 0.0, None]
