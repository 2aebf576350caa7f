"""Near duplicates where a doc_id names several texts, or none is given."""

import random

import pytest

from prismrank.llm import neardup

A, B = ("alpha " * 3 + " ".join(f"{c}{i}" for i in range(40)) for c in "ab")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "'x' AS node", "doc_id AS least").repartition(3)


def test_two_texts_under_one_id_are_two_classes(spark):
    docs = table(spark, [(1, A), (1, B), (2, B), (3, A)])
    assert sorted(map(tuple, neardup.link(docs).collect())) == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0)]
    kept = neardup.keep_first(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, A), (1, B)]) and kept.columns == docs.columns


def similar(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (x, y))]
    return bool(sets[0]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


@pytest.mark.parametrize("seed", range(2))
def test_nothing_is_lost_or_joined_by_ids(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " "]
    for g in range(6):
        base = [f"{g}w{i}" for i in range(60)]
        texts += [" ".join(base)] * 2
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = [(rng.choice([None, *range(8)]), t) for t in texts] + [(4, texts[5]), (4, texts[5])]
    linked = [[j for j in range(len(rows)) if j != i and similar(rows[i][1], rows[j][1])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        others = {rows[j][1] for j in linked[i]} - {rows[i][1]}
        want.append((str(doc_id), str(min(ids, default=None)), len(linked[i]), len(others)))
    got = neardup.link(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_texts"]) for r in got) == sorted(want)
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_first(table(spark, rows)).collect()]
    groups = {group[i] for i, (doc_id, _) in enumerate(rows) if doc_id is not None}
    blank = {r for r in rows if r[0] is not None and not (r[1] or "").strip()}
    of_words = [k for k in kept if k[0] is not None and (k[1] or "").strip()]
    assert sorted(group[rows.index(k)] for k in of_words) == sorted(g for g in groups if (rows[g][1] or "").strip())
    assert {k for k in kept if k[0] is not None} - set(of_words) <= blank
    assert sorted(str(k) for k in kept if k[0] is None) == sorted(str(r) for r in rows if r[0] is None)


def test_rows_without_id(spark):
    rows = [(None, A), (5, A), (None, B), (None, None)]
    got = sorted(map(str, (tuple(r) for r in neardup.link(table(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 5, 1, 0), (5, 5, 1, 0), (None, None, 0, 0), (None, None, 0, 0)]))
