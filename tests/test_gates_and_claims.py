"""Gates of metrics, statuses of responses, and claims verified in stages."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from prismrank.functions import text as X
from prismrank.operators import checks, evaluate, metrics
from prismrank.operators import workflow as V

FACTS = {"dataset_id": "a", "context_mode": "with", "frozen": True, "has_reference": True, "has_evaluator": True, "generation": "success"}


def decide(spark, metric, **facts):
    row = {"metric_id": "m", **FACTS, **facts}
    kinds = "metric_id string, dataset_id string, context_mode string, frozen boolean, has_reference boolean, has_evaluator boolean, generation string"
    rows = spark.createDataFrame([tuple(row[k.split()[0]] for k in kinds.split(", "))], kinds)
    r = checks.applicability(rows, spark.createDataFrame([("m", *metric)], checks.REGISTRY)).first()
    return r["decision"], r["status"], r["reason"]


ALL, NONE = (True, True, True), (False, False, False)


@pytest.mark.parametrize(
    ("metric", "facts", "want"),
    [
        ((None, None, None, *ALL), {}, ("ELIGIBLE", None, None)),
        ((["b"], ["x"], [], *ALL), {}, ("WRONG_DATASET", "not_applicable", "not_defined_for_dataset")),
        ((["a", "b"], ["x"], [], *ALL), {}, ("WRONG_CONTEXT", "not_applicable", "not_defined_for_context_mode")),
        ((None, None, ["b"], *ALL), {"has_reference": False}, ("PROTOCOL_NOT_FROZEN", "not_computed", "protocol_not_frozen")),
        ((None, None, ["a"], *ALL), {"frozen": False}, ("PROTOCOL_NOT_FROZEN", "not_computed", "protocol_not_frozen")),
        ((None, None, None, *ALL), {"has_reference": False, "has_evaluator": False}, ("NO_REFERENCE", "not_computed", "reference_unavailable")),
        ((None, None, None, *ALL), {"has_evaluator": False, "generation": "failed"}, ("NO_EVALUATOR", "not_computed", "evaluator_unavailable")),
        ((None, None, None, *ALL), {"generation": "not_run"}, ("NOT_RUN", "not_computed", "generation_not_attempted")),
        ((None, None, None, *ALL), {"generation": "failed"}, ("GENERATION_FAILED", "failed", "generation_failed")),
        ((None, None, None, *NONE), {"has_reference": False, "has_evaluator": False, "generation": "failed"}, ("ELIGIBLE", None, None)),
    ],
)
def test_gates(spark, metric, facts, want):
    assert decide(spark, metric, **facts) == want


def test_unknown_metric_is_an_error(spark):
    with pytest.raises(Exception, match="unknown metric other"):
        decide(spark, (None, None, None, *ALL), metric_id="other")


def status(spark, error, finish, text, parsed, refused=None):
    df = spark.createDataFrame([(error, finish, text, parsed, refused)], "e string, f string, t string, p string, r boolean")
    return df.select(X.classify_response(*map(F.col, "eftpr")).alias("x")).first()["x"]


def test_statuses_of_responses(spark):
    assert status(spark, "lost", None, None, None) == "ERROR"
    assert status(spark, None, "\tMax_Tokens\n", "x", "x", True) == "TRUNCATED"
    assert status(spark, None, "stop", "x", "x", True) == "REFUSAL"
    assert status(spark, None, None, "I must decline.", "x") == "REFUSAL"
    assert status(spark, None, "stop", "x", None, False) == "PARSE_FAILURE"
    assert status(spark, None, "stop", "x", "x") == "OK"
    for contradiction in (("lost", None, "x", "x"), (None, "stop", None, None)):
        with pytest.raises(Exception, match="text"):
            status(spark, *contradiction)


def test_decisions_in_any_case(spark):
    texts = ["Decision: Yes", "Decision:  MAYBE ", "Decision: yes\nDecision: no", "decision: yes", "Decision:", "Decision: so"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["d"] for r in df.select("i", X.parse_line(F.col("t"), "Decision", ["yes", "no", "maybe"]).alias("d")).collect()}
    assert got == {0: "yes", 1: "maybe", 2: None, 3: None, 4: None, 5: None}
    assert df.select(X.parse_line(F.lit("Answer: Yes, it is"), "Answer").alias("a")).first()["a"] == "Yes, it is"


def test_a_vector_without_length_is_like_none(spark):
    rows = [(1, i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])]
    got = metrics.pairwise_diversity(spark.createDataFrame(rows, "q int, i int, v array<double>"), ["q"], "i").first()
    assert got["diversity"] == pytest.approx(2 / 3)


def plain(passages, single, pair):
    """Status and calls on pairs of one claim, step by step."""
    ps = [single[p] for p in passages]
    if not ps or any(p is None for p in ps):
        return "FAILED", 0
    no, n, support, broken = any(c >= 0.5 for _, c in ps), 0, any(e >= 0.5 for e, _ in ps), False
    if not support:
        for a, b in itertools.combinations(passages, 2):
            n += 1
            p = pair[a, b]
            broken |= p is None
            if p is not None and p[0] >= 0.5:
                support = True
                break
    return ("INCONSISTENT" if no else "SUPPORTED") if support else "FAILED" if broken else "CONTRADICTED" if no else "UNSUPPORTED", n


def test_staged_claims_step_by_step(spark, tmp_path):
    rng = random.Random(7)
    chance = lambda: None if rng.random() < 0.06 else (rng.random() * 0.65, rng.random() * 0.6)
    names = [f"p{i}" for i in range(12)]
    single, pair = {p: chance() for p in names}, {(a, b): chance() for a in names for b in names}
    answers = single | {f"{a}\n\n{b}": p for (a, b), p in pair.items()}
    log = str(tmp_path / "calls")

    def verify(asked):
        with open(log, "a") as f:
            f.writelines(f"{claim}\n" for _, claim in asked)
        return [answers[premise] for premise, _ in asked]

    rows = [(i // 4, f"c{i}", rng.sample(names, rng.choice([0, 1, 3, 5]))) for i in range(60)] + [(99, None, ["p1"]), (99, "c-null", None)]
    claims = spark.createDataFrame(rows, "answer int, claim_text string, passages array<string>").withColumn("status", F.lit("x")).repartition(3)
    got = {(r["answer"], r["claim_text"]): (r["status"], r["n_pairs"], r["n_singles"]) for r in evaluate.staged_claims(claims.withColumn("claim_id", F.col("claim_text")), ["answer", "claim_id"], verify).withColumnRenamed("claim_id", "claim_text").collect()}
    assert {k: v[:2] for k, v in got.items() if k[0] != 99} == {(a, c): plain(ps, single, pair) for a, c, ps in rows if a != 99}
    assert got[99, None][0] == got[99, "c-null"][0] == "FAILED"
    with open(log) as f:
        asked = f.read().split()
    assert len(asked) == sum(s + p for _, p, s in got.values())  # nothing is asked for that isn't counted


def test_scores_of_answers(spark):
    claims = [(1, s) for s in ("SUPPORTED", "SUPPORTED", "FAILED", "UNSUPPORTED", "INCONSISTENT")] + [(2, "FAILED")] + [(3, "SUPPORTED")]
    answers = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "a int, has_context boolean")
    got = {r["a"]: tuple(r)[1:] for r in evaluate.answer_faithfulness(spark.createDataFrame(claims, "a int, status string"), answers, ["a"]).collect()}
    assert got == {1: (5, 4, 1, 0.5, 0.0, 0.25, 0.25), 2: (1, 0, 1, None, None, None, None), 3: (1, None, None, None, None, None, None), 4: (0, 0, 0, None, None, None, None)}


def test_largest_entailment(spark):
    probed = spark.createDataFrame([(1, "p", 0.2), (1, "q", 0.7), (2, " \t", 0.9), (3, "p", 0.8), (5, "p", None)], "a int, premise string, p_entail double")
    answers = spark.createDataFrame([(1, "x"), (2, "x"), (3, " \n"), (4, "x"), (5, "x"), (6, None)], "a int, answer string")
    assert {r["a"]: r["entailment"] for r in evaluate.largest_entailment(probed, answers, ["a"]).collect()} == {1: 0.7, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_unsound_retrieval_inputs(spark):
    kinds = "id int, dataset_id string, context_mode string, frozen boolean, has_evaluator boolean, retrieved array<long>, gold array<long>, vectors array<array<double>>"
    good = [[1.0, 0.0], [0.0, 1.0]]
    rows = [
        (1, [1, 2], [2, 9], good), (2, [1, 2], None, None), (3, [], [], []), (4, [1, 2], [3], [[1.0, 0.0]]), (5, [1], [1], [[1.0]]),
        (6, [1, 2], [1], [[1.0, 0.0], [0.0]]), (7, [1, 2], [1], [[1.0, 0.0], [0.0, 0.0]]), (8, [1, None], [1], [[1.0, None], [1.0, 1.0]]), (9, [1, 2], [1, 1], [None, [1.0]]),
    ]
    df = spark.createDataFrame([(i, "a", "with", True, True, r, g, v) for i, r, g, v in rows], kinds)
    registry = spark.createDataFrame([(m, None, None, None, True, False, False) for m in ("recall_at_k", "retrieval_diversity")], checks.REGISTRY)
    got = {(r["id"], r["metric_id"]): r["reason"] or r["value"] for r in evaluate.evaluate_retrieval(df, registry, 2).collect()}
    bad, none = "invalid_metric_input", "reference_unavailable"
    assert [got[i, "recall_at_k"] for i in range(1, 10)] == [0.5, none, bad, 0.0, 1.0, 1.0, 1.0, bad, bad]
    assert [got[i, "retrieval_diversity"] for i in range(1, 10)] == [pytest.approx(1.0), "missing_embedding", bad, bad, "insufficient_items", bad, bad, bad, bad]


def test_subsets_of_a_manifest(spark):
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position long, id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    of = lambda **o: [r["id"] for r in V.manifest_subset(queries, "id", **o).orderBy("position").collect()]
    assert of(ids=ids("c", "a")) == ["a", "c"] and of(most=2) == ["a", "b"] and of() == ["a", "b", "c"]
    for wrong, why in (({"ids": ids("a", "a")}, "2 times"), ({"ids": ids("x")}, "isn't in the manifest"), ({"most": 0}, "above 0"), ({"ids": ids(), "most": 1}, "either")):
        with pytest.raises(ValueError, match=why):
            of(**wrong)


def test_calls_without_text_and_missing_explanations(spark):
    calls = spark.createDataFrame([(1, "a"), (1, " a\n"), (1, "a"), (2, "a"), (2, None), (2, "a"), (3, "a"), (3, "a")], "k int, t string")
    assert tuple(V.repeatability(calls, "k", "t", enough=1).first()) == (3, 1, True)
    answers = lambda t: spark.createDataFrame([("OK", t), ("REFUSAL", "no")], "status string, t string")
    assert [r["claim_text"] for r in V.explained_claims(answers("x Explanation: One. Two."), "t").collect()] == ["One.", "Two."]
    for wrong in ("nothing", "Explanation:  "):
        with pytest.raises(Exception, match="without explanation"):
            V.explained_claims(answers(wrong), "t").collect()
