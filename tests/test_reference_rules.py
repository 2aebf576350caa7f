"""Rules that must hold to the letter: refusals, sentences, masking, ids, contexts, candidates, claims, embeddings."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismrank.functions import matching
from prismrank.functions import text as X
from prismrank.operators import aggregate, evaluate, postings, retrieval
from prismrank.operators import workflow as V


def each(spark, expression, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", expression.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_refusals_need_a_verb(spark):
    yes = ["I cannot answer that.", "  i can't  help", "I am\nunable to provide an answer", "I won't answer", "I must decline.", "I have to refuse", "Sorry, I can't help", "sorry I am unable to answer"]
    no = ["I cannot imagine a nicer town", "I'm sorry to hear it", "Unable to answer", "We must decline", "He said: I must decline", "", "Sorry, I won't help"]
    assert each(spark, X.is_refusal(F.col("t")), *yes) == [True] * len(yes)
    assert each(spark, X.is_refusal(F.col("t")), *no) == [False] * len(no)


def test_sentences_by_terminal_token(spark):
    got = each(spark, X.sentences(F.col("t")), "See (eq. 3). Mt. Etna (cf. \"Dr. Who\").  Next!", "He met J.R. Smith at No. 5? Yes. The U.S. team", "al. Inc. ends. x", "One.\x1eTwo.")
    assert got == [["See (eq. 3).", "Mt. Etna (cf.", "\"Dr. Who\").", "Next!"], ["He met J.R. Smith at No. 5?", "Yes.", "The U.S. team"], ["al.", "Inc.", "ends.", "x"], ["One.", "Two."]]


def test_masking_keeps_what_stands_before(spark):
    got = each(spark, X.redact_keys(F.col("t")), "api_key=abc,next", "Authorization: Bearer x.y;z", "bearer tok/en= end", "sk-abcdefgh1234", "API-KEY : s " + "x" * 2000)
    assert got[:4] == ["api_key=[REDACTED],next", "Authorization: Bearer [REDACTED];z", "bearer [REDACTED] end", "sk-abcdefgh1234"] and len(got[4]) < 1010
    assert len(each(spark, X.redact_keys(F.col("t"), None), "x" * 2000)[0]) == 2000


def test_controls_stay_in_words():
    assert matching.normal_tokens("a​b c\x07d ‘e’f' g\nh") == ["a​b", "c\x07d", "e'f", "g", "h"]


def test_stable_ids(spark):
    ids = spark.createDataFrame([(1, "1"), (2, "x")], "n long, t string")
    assert [tuple(r) for r in ids.select(X.stable_id(F.col("n"), "bigint"), X.stable_id(F.col("t"), "string")).collect()] == [('{"id":1}', '{"id":"1"}'), ('{"id":2}', '{"id":"x"}')]
    with pytest.raises(TypeError):
        X.stable_id(F.col("n"), "boolean")
    with pytest.raises(PySparkException):
        each(spark, X.stable_id(F.col("t"), "string"), " ")


def test_contexts_of_exactly_so_many(spark):
    with pytest.raises(PySparkException):
        each(spark, X.split_context(F.col("t"), 5), "[Document 1]\na")
    assert each(spark, X.split_context(F.col("t"), 2), "[Document 1]\na\n\n[Document 2]\nb") == [["a", "b"]]


def test_candidates_are_looked_up_again(spark):
    corpus = spark.createDataFrame([(0, 10, "a"), (1, 11, "b")], "corpus_position long, doc_id long, content string")
    hashed = corpus.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "corpus_position", "doc_id", F.sha2("content", 256).alias("content_sha256"))
    assert V.checked_candidates(hashed, corpus).count() == 2
    for bad in (hashed.withColumn("doc_id", F.lit(12)), hashed.withColumn("content_sha256", F.lit("x")), hashed.withColumn("corpus_position", F.lit(7))):
        with pytest.raises(PySparkException):
            V.checked_candidates(bad, corpus).collect()


def test_first_by_hash_is_exact(spark):
    import hashlib

    rows = V.first_by_hash(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", "split", 123).collect()
    first = sorted(range(500), key=lambda i: hashlib.sha256(f"split|{i}".encode()).hexdigest())[:123]
    assert {r["doc_id"] for r in rows if r["first"]} == set(first) and len(rows) == 500


def test_claims_in_two_stages(spark):
    nan = float("nan")
    singles = {"s": [(0.9, 0.1), (0.1, 0.1)], "i": [(0.9, 0.1), (0.1, 0.8)], "f": [(None, 0.1), (0.9, 0.1)], "p": [(0.1, 0.1)] * 2, "q": [(0.1, 0.9), (0.1, 0.1)], "c": [(0.1, 0.9), (0.1, 0.1)], "u": [(0.1, 0.1)] * 2, "x": [(0.1, 0.1)] * 2}
    pairs = {"p": [0.1, None, 0.7, 0.1], "q": [0.1, 0.1, 0.9, 0.1], "c": [0.1] * 4, "u": [0.2] * 4, "x": [0.1, nan, 0.2, 0.1]}
    one = spark.createDataFrame([(k, i, e, c) for k, v in singles.items() for i, (e, c) in enumerate(v)], "claim string, passage int, p_entail double, p_contradict double")
    two = spark.createDataFrame([(k, 0, j + 1, e) for k, v in pairs.items() for j, e in enumerate(v)], "claim string, i int, j int, p_entail double")
    got = {r["claim"]: (r["status"], r["n_pairs"]) for r in evaluate.two_stage_status(one, two, ["claim"]).collect()}
    assert got == {"s": ("SUPPORTED", 0), "i": ("INCONSISTENT", 0), "f": ("FAILED", 0), "p": ("SUPPORTED", 3), "q": ("INCONSISTENT", 3), "c": ("CONTRADICTED", 4), "u": ("UNSUPPORTED", 4), "x": ("FAILED", 4)}


def test_diversity_without_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(a, rng.standard_normal(5).tolist() if i else [0.0] * 5) for a, n in ((1, 1), (2, 2), (3, 6)) for i in range(n)]
    got = {r["a"]: r["diversity"] for r in evaluate.output_diversity(spark.createDataFrame(rows, "a long, v array<double>"), ["a"]).collect()}
    for a in (1, 2, 3):
        u = np.array([v for b, v in rows if b == a])
        u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
        pairs = [1 - u[i] @ u[j] for i in range(len(u)) for j in range(i)]
        assert got[a] == (pytest.approx(np.mean(pairs)) if pairs else None)


def test_embeddings_are_kept_while_the_corpus_is_as_large(spark, tmp_path):
    corpus = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "doc_id long, v array<double>")
    at, calls = str(tmp_path / "v"), []
    embed = lambda c: calls.append(1) or c
    assert {tuple(r["v"]) for r in evaluate.kept_embeddings(corpus, at, embed).collect()} == {(0.6, 0.8), (0.0, 0.0)}
    evaluate.kept_embeddings(corpus, at, embed)
    assert len(calls) == 1
    evaluate.kept_embeddings(corpus.unionAll(corpus.withColumn("doc_id", F.col("doc_id") + 2)), at, embed)
    assert len(calls) == 2


def test_intervals_agree_with_resampling(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1.0, 2.0, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    got = aggregate.bootstrap_mean(df, [], "i", "v").first()
    plain = np.percentile(rng.choice(x, (10_000, 300)).mean(1), [2.5, 97.5])
    assert got["low"] == pytest.approx(plain[0], abs=0.03) and got["high"] == pytest.approx(plain[1], abs=0.03)


def test_bm25_by_both_ways(spark):
    """Scores from large parts equal those from small ones, of which blocks are skipped, with repeated words, texts without hits and empty ones."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 40, rng.integers(0, 30)))) for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 60, 6))) for i in range(20)] + [(20, ""), (21, "none here"), (22, None)], "query_id long, text string")
    by_large = retrieval.bm25(docs, queries, 7).collect()
    by_small = postings.search(postings.build(docs, part_docs=30, block_docs=3), queries, 7).collect()
    rows = lambda found: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in found)
    assert rows(by_large) == rows(by_small) and len(by_large) == 23 * 7
