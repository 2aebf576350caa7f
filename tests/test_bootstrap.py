"""The exact bootstrap: what it draws, and its interval."""

import numpy as np
import pytest

from prismrank.operators import bootstrap


def test_each_replicate_draws_as_many_as_there_are(spark):
    rows = [(g, i, float(i)) for g, n in (("a", 130), ("b", 7), (None, 40)) for i in range(n)] + [("a", 999, None), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, x double")
    blocks = bootstrap._blocks(df, ["k"], "id", "x", 16)
    sizes = {(r["k"], r["block"]): (r["n"], r["size"], r["before"], len(r["values"])) for r in blocks.collect()}
    assert {k: sum(s[1] for (g, _), s in sizes.items() if g == k) for k in ("a", "b", None)} == {"a": 130, "b": 7, None: 40}
    assert all(s[1] == s[3] for s in sizes.values()) and len([1 for g, _ in sizes if g == "a"]) > 5
    dealt = bootstrap._dealt(blocks.drop("values"), ["k"], 50).collect()
    for g, n in (("a", 130), ("b", 7), (None, 40)):
        counts = np.array([r["counts"] for r in dealt if r["k"] == g])
        assert (counts.sum(0) == n).all()
    counts = np.array([r["counts"] for r in sorted((r for r in dealt if r["k"] == "a"), key=lambda r: r["block"])])
    shares = np.array([s[1] for (g, _), s in sorted((x for x in sizes.items() if x[0][0] == "a"), key=lambda x: x[0][1])]) / 130
    assert np.abs(counts.mean(1) / 130 - shares).max() < 0.03


def test_interval_is_that_of_resampling(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(2.0, 300)
    got = bootstrap.bootstrap_exact(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double"), [], "id", "x", 1500, 64).first()
    means = x[rng.integers(0, 300, (1500, 300))].mean(1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert got["n"] == 300 and got["mean"] == pytest.approx(x.mean())
    assert got["low"] == pytest.approx(low, abs=0.04) and got["high"] == pytest.approx(high, abs=0.04)


def test_blocks_of_any_size_and_odd_groups(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("same", 1, 2.0), ("same", 2, 2.0), ("none", 1, None)], "k string, id long, x double")
    got = {r["k"]: tuple(r)[1:] for r in bootstrap.bootstrap_exact(df, ["k"], "id", "x", 20, 1).collect()}
    assert got == {"one": (1, 5.0, 5.0, 5.0), "same": (2, 2.0, 2.0, 2.0)}
    assert bootstrap.bootstrap_exact(df.limit(0), ["k"], "id", "x", 20).collect() == []


def test_counters_are_even():
    z = bootstrap.mixed(bootstrap.TO_BLOCKS, 3, 0, np.arange(200_000)) % np.uint64(10)
    assert np.abs(np.bincount(z.astype(int)) / 200_000 - 0.1).max() < 0.003
    assert len(set(bootstrap.mixed(1, 1, 0, np.arange(1000)).tolist()) & set(bootstrap.mixed(1, 2, 0, np.arange(1000)).tolist())) == 0
