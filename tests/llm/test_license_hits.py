"""Licence hits against a plain scan: places, base counts and suppression; and texts of very many matches."""

import random
import time

import pytest
import regex

from prismrank.llm import licenses

PARTS = ["mit license", "apache license", "general public license", "licensed under the apache license version 2 0", "gnu general public license version 3", "mit", "license", "cc by 4 0", "spdx license identifier mit", "permission is hereby granted free of charge", "Apache License, Version 2.0", "under", "the", "bsd 3 clause license", "GPL", "é"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS found", "'x' AS kept", "0 AS n_words")


def plain(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm = f" {' '.join(words)} "
    hits = []
    for r in licenses.signature_rules():
        if r.keyword in norm:
            for m in regex.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                hits.append((start, start + m.group().count(" ") + 1, r.label, r.priority, r.base))
    kept = [x for x in hits if not any(y[0] <= x[0] and y[1] >= x[1] and (y[3] > x[3] or y[3] == x[3] and y[1] - y[0] > x[1] - x[0]) for y in hits)]
    base = [x[0] for x in hits if x[4]]
    return len(words), sorted(hits), sorted(kept), (len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x[2] for x in hits if x[4]})), ",".join(sorted({x[2] for x in [*(h for h in hits if h[4]), *kept]})))


@pytest.mark.parametrize("seed", range(3))
def test_hits_and_suppression_by_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "mit license"] + [rng.choice([" ", ", ", "\n"]).join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(25)]
    scanned = licenses.scan(table(spark, texts))
    row = lambda x: (x["start"], x["end"], x["label"], x["priority"], x["base"])
    got = {r["doc_id"]: (r["n_words"], sorted(map(row, r["found"])), sorted(map(row, r["kept"]))) for r in scanned.collect()}
    told = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in licenses.digest(scanned).collect()}
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i] == want[:3] and told[i] == want[3]


def test_very_many_matches(spark):
    licenses.digest(licenses.scan(table(spark, ["mit license"]))).collect()
    n = 100_000
    began = time.time()
    r = licenses.digest(licenses.scan(table(spark, ["mit license " * n]))).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (2 * n, n, 0, 2 * n - 2)
    assert time.time() - began < 30
