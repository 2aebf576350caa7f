"""A drained stream counts every event, those of the last days included."""

from datetime import datetime, timedelta

import __spark_entry__


def test_all_days_are_counted(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), "ab"[i % 2]) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string")
    for name, kept in (("some", events), ("none", events.limit(0))):
        kept.write.parquet(f"{tmp_path}/{name}/events.parquet")
    query = __spark_entry__.queries()["streamed_status_counts"]
    got = {(r["start"].day, r["event_type"]): r["n"] for r in query(spark, f"{tmp_path}/some").collect()}
    assert got == {(1, "a"): 12, (1, "b"): 12, (2, "a"): 8, (2, "b"): 8}
    assert query(spark, f"{tmp_path}/none").count() == 0
