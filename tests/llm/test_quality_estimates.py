"""Duplicate lines are junk by themselves, and the estimates are the best of their starts."""

import random

import numpy as np
from pyspark.sql import functions as F

from prismrank.llm import quality


def duplicate_lines(seed, n=60, distinct=20):
    """Two-word lines of which two thirds are copies, in an order that repeats few runs of three words."""
    rng = random.Random(seed)
    lines = [f"w{rng.randrange(3000)} v{rng.randrange(3000)}" for _ in range(distinct)]
    order, used = list(range(distinct)), set()
    while len(order) < n:
        order.append(rng.choice([i for i in range(distinct) if (order[-1], i) not in used]))
        used.add((order[-2], order[-1]))
    return "\n".join(lines[i] for i in order)


def test_duplicate_line_junk_goes(spark):
    rng = random.Random(1)
    clean = ["\n".join(f"w{rng.randrange(3000)} v{rng.randrange(3000)}" for _ in range(40 + i % 40)) for i in range(200)]
    junk = [duplicate_lines(i) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*clean, *junk])], "doc_id long, text string, lang string, source string")
    got = quality.judge(docs).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in got)
    assert all(r["kept"] for r in got[:200]) and not any(r["kept"] for r in got[200:])


def test_least_determinant_of_all_starts(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.standard_normal((140, quality.P)), 6 + 0.1 * rng.standard_normal((60, quality.P))])
    rows = spark.createDataFrame([("en", f"p{i % 2}", i, v.tolist()) for i, v in enumerate(points)], "lang string, pool string, doc_id long, vector array<double>")
    best = {r["pool"]: r["logdet"] for r in quality.robust_estimates(rows).collect()}
    for start in quality.STARTS:
        one = {r["pool"]: r["logdet"] for r in quality.robust_estimates(rows, starts=(start,)).collect()}
        assert all(best[p] <= one[p] + 1e-9 for p in best) and set(one) == set(best)
    assert quality.robust_estimates(rows.filter(F.lit(False))).count() == 0
