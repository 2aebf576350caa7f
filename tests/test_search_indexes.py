"""The postings index and the late-interaction index against scoring everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.operators import late, postings, retrieval


def okapi(corpus, query, k, epsilon=0.25):
    """doc_id and score of the k best, from the formula."""
    docs = {i: (t or "").lower().split() for i, t in corpus}
    n, avgdl = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(w for words in docs.values() for w in set(words))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: epsilon * mean if x < 0 else x for w, x in raw.items()}
    scores = {}
    for i, words in docs.items():
        tf = Counter(words)
        scores[i] = round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avgdl)) for w in (query or "").lower().split() if tf[w]), 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def zipf_corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    return [(i * 3, " ".join([*(word() for _ in range(rng.randrange(0, 40))), *(["often"] if i % 2 else [])])) for i in range(n)]


def held(spark, corpus, queries, k, **options):
    c = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("score", F.lit("x"))
    q = spark.createDataFrame(queries, "query_id long, text string").withColumn("term", F.lit(1))
    got = {}
    for r in postings.search(postings.build(c, **options), q, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    for i, text in queries:
        want = okapi(corpus, text, k)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=1e-8)


@pytest.mark.parametrize(("part", "block", "few"), [(40, 8, 0), (40, 8, 10**6), (8192, 64, 10**6), (3, 1, 10**6)])
def test_bm25_against_the_formula(spark, monkeypatch, part, block, few):
    monkeypatch.setattr(postings, "FEW_WEIGHTS", few)
    corpus = zipf_corpus(300)
    rng = random.Random(2)
    queries = [(i, " ".join(rng.choice([f"w{rng.randrange(40)}", "often", "never"]) for _ in range(rng.randrange(0, 7)))) for i in range(15)] + [(99, None), (98, "often"), (97, "W3 w3 often")]
    held(spark, corpus, queries, 7, part_docs=part, block_docs=block)


@pytest.mark.parametrize("corpus", [[(0, "x"), (1, "x"), (2, "y"), (3, "z")], [(0, "a b"), (1, "a b c"), (2, "a b"), (3, "a d b"), (4, None)], [(5, "")], []])
def test_bm25_where_words_weigh_nothing_or_less(spark, corpus):
    """A term in half of the documents, terms in most of them, and no terms or documents at all."""
    held(spark, corpus, [(1, "x"), (2, "a"), (3, "a b c"), (4, "q"), (5, "x y")], 4)


@pytest.mark.parametrize("few", [0, 10**6])
def test_bm25_scores_are_not_rounded_twice(spark, monkeypatch, few):
    """Nine places only compare; a score that was rounded to them and then to six could end in another digit."""
    monkeypatch.setattr(postings, "FEW_WEIGHTS", few)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x y"), (3, "p q"), (4, "r s t u"), (5, "v")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in postings.search(postings.build(docs), spark.createDataFrame([(1, "a b")], "query_id long, text string"), 2).collect()}
    idf, weigh = lambda df: math.log(5 - df + 0.5) - math.log(df + 0.5), lambda dl: 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / 3))
    assert got == {1: pytest.approx((idf(2) + idf(1)) * weigh(5), abs=1e-13), 2: pytest.approx(idf(2) * weigh(3), abs=1e-13)}


def test_blocks_are_skipped(spark):
    corpus = [(i, "often " + ("rare rare" if i in (100, 101, 102) else f"w{i % 7} w{i % 11}")) if i % 2 == 0 or i > 97 else (i, "other words here") for i in range(400)]
    index = postings.build(spark.createDataFrame(corpus, "doc_id long, text string"), part_docs=64, block_docs=4)
    queries = spark.createDataFrame([(1, "often rare")], "query_id long, text string")
    row = postings.skipped(index, queries, 3).first()
    assert row["n_blocks"] >= 90 and row["n_read"] < 10
    assert [r["doc_id"] for r in postings.search(index, queries, 3).orderBy("rank").collect()] == [d for d, _ in okapi(corpus, "often rare", 3)]


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, width))
    v = centres[rng.integers(0, 30, n)] + 0.4 * rng.standard_normal((n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", ["clusters", "none"])
def test_recall_of_probed_search(spark, spread):
    v = clustered(3000, 17, 3) if spread == "clusters" else np.random.default_rng(4).standard_normal((3000, 17))
    tokens = spark.createDataFrame([(i // 10, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>")
    asks = tokens.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v")
    index = late.build(tokens)
    found = late.search(index, asks, 10).collect()
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.max_sim(tokens, asks, 10).collect()}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in found}
    both = got.keys() & exact.keys()
    assert len(both) / len(exact) >= 0.9
    assert all(got[p] == pytest.approx(exact[p]) for p in both)
    assert late.exact_pairs(index, asks, 10).count() <= 60 * 15 < 300 * 15  # vectors of a fifth of the documents


def test_codes_keep_what_they_can():
    v = clustered(500, 10, 5)
    centroids, cuts, levels = late.fit(v, 16)
    cell, packed = late.encode(v, centroids, cuts)
    assert packed.shape == (500, 3)
    again = late.decode(cell, packed, centroids, levels)
    assert np.linalg.norm(v - again) < 0.5 * np.linalg.norm(v - centroids[cell])


def test_probed_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, None), (None, [1.0, 1.0]), (2, [None, 1.0]), (3, [0.0, 1.0])], "doc_id long, v array<double>")
    asks = rows.select(F.col("doc_id").alias("query_id"), "v")
    assert late.search(late.build(none), asks, 3).collect() == []
    assert late.search(late.build(rows), asks.limit(0), 3).collect() == []
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in late.search(late.build(rows), asks, 3).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 1)]
