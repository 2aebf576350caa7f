"""The registry of runs: each rule, and batches that come one after another."""

import pytest
from pyspark.sql import functions as F

from prismrank.streaming import registry

PLAN, RUN, DONE = ("i", "PLANNED", 0, "e", "r", None), ("i", "RUNNING", 1, "e", "r", None), ("i", "COMPLETE", 1, "e", "r", None)


@pytest.mark.parametrize(
    ("latest", "record", "want"),
    [
        (None, PLAN, "ACCEPTED"),
        (None, RUN, "NOT_PLANNED"),
        (None, ("i", "QUEUED", 0, "e", "r", None), "INVALID_RECORD"),
        (PLAN, PLAN, "DUPLICATE"),
        (PLAN, ("i", "PLANNED", 0, "e2", "r", None), "DUPLICATE"),
        (PLAN, ("j", "RUNNING", 1, "e", "r", None), "OTHER_IDENTITY"),
        (PLAN, DONE, "INVALID_TRANSITION"),
        (PLAN, ("i", "RUNNING", 0, "e", "r", None), "NOT_STARTED"),
        (PLAN, ("i", "RUNNING", 1, "e2", "r", None), "OTHER_ENVIRONMENT"),
        (RUN, ("i", "RUNNING", 2, "e", "r", "7"), "ACCEPTED"),
        (RUN, ("i", "RUNNING", 2, "e", "r", None), "NOT_RESUMED"),
        (RUN, ("i", "RUNNING", 3, "e", "r", "7"), "ATTEMPT_SKIPPED"),
        (RUN, ("i", "COMPLETE", 0, "e", "r", None), "ATTEMPT_FELL"),
        (RUN, ("i", "FAILED", 2, "e", "r", None), "ATTEMPT_CHANGED"),
        (RUN, DONE, "ACCEPTED"),
        (DONE, ("i", "RUNNING", 2, "e", "r", "7"), "INVALID_TRANSITION"),
    ],
)
def test_rules(latest, record, want):
    assert registry.decide(7, latest, record) == want


def test_state_outlives_a_call(spark, tmp_path):
    schema = "run_id long, seq long, identity string, status string, attempt int, environment string, runtime string, resume_of string"
    first = [(7, 2, *RUN), (7, 1, *PLAN), (8, 1, *RUN)]
    then = [(7, 4, *RUN), (7, 3, *DONE), (8, 2, *PLAN), (9, 1, "i", "PLANNED", None, "e", "r", None)]
    (tmp_path / "in").mkdir()
    for rows in (first, then):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        registry.append(stream, ["seq"], f"{tmp_path}/log", f"{tmp_path}/state")
    got = {(r["run_id"], r["seq"]): r["decision"] for r in registry.read(spark, f"{tmp_path}/log", "run_id long, seq long, decision string").collect()}
    assert got == {(7, 1): "ACCEPTED", (7, 2): "ACCEPTED", (8, 1): "NOT_PLANNED", (7, 3): "ACCEPTED", (7, 4): "INVALID_TRANSITION", (8, 2): "ACCEPTED", (9, 1): "INVALID_RECORD"}
    assert spark.read.parquet(f"{tmp_path}/log/accepted").filter(F.col("decision") != "ACCEPTED").count() == 0
