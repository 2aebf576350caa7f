"""A registry of runs that refuses what may not follow, record by record, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prismrank.operators.checks import TRANSITIONS

#: What a record has besides run_id and the columns it is ordered by: its identity is fixed before the run starts, environment and runtime are digests, resume_of is the run that an attempt goes on with.
FIELDS = {"identity": "string", "status": "string", "attempt": "int", "environment": "string", "runtime": "string", "resume_of": "string"}
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(run_id: object, latest: tuple | None, record: tuple) -> str:
    """ACCEPTED, DUPLICATE (nothing new, nothing wrong), or why the record can't follow the latest accepted one of its run; both in the order of FIELDS."""
    identity, status, attempt, environment, runtime, resume_of = record
    if status not in TRANSITIONS or attempt is None or attempt < 0 or identity is None:
        return "INVALID_RECORD"
    if latest is None:
        return "ACCEPTED" if status == "PLANNED" else "NOT_PLANNED"
    was_identity, was_status, was_attempt, was_environment, was_runtime, _ = latest
    if latest == record:
        return "DUPLICATE"
    if was_identity != identity:
        return "OTHER_IDENTITY"
    if was_status == status == "PLANNED":
        return "DUPLICATE"
    if status not in TRANSITIONS[was_status]:
        return "INVALID_TRANSITION"
    if (was_environment, was_runtime) != (environment, runtime):
        return "OTHER_ENVIRONMENT"
    if attempt < was_attempt:
        return "ATTEMPT_FELL"
    if was_status == "RUNNING" and status == "RUNNING":
        if attempt != was_attempt + 1:
            return "ATTEMPT_SKIPPED"
        return "ACCEPTED" if resume_of == str(run_id) else "NOT_RESUMED"
    if was_status == "RUNNING":
        return "ACCEPTED" if attempt == was_attempt else "ATTEMPT_CHANGED"
    return "ACCEPTED" if attempt >= 1 else "NOT_STARTED"


class _Registry(StatefulProcessor):
    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", ", ".join(f"{f} {t}" for f, t in FIELDS.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.latest.get() if self.latest.exists() else None
        latest = None if latest is None else tuple(latest)
        told = latest
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        decisions = []
        for record in frame[list(FIELDS)].itertuples(index=False, name=None):
            record = tuple(None if pd.isna(x) else int(x) if i == 2 else x for i, x in enumerate(record))
            decision = decide(key[0], latest, record)
            decisions.append(decision)
            if decision == "ACCEPTED":
                latest = record
        if latest is not told:
            self.latest.update(latest)
        yield frame[["run_id", *self.order]].assign(decision=decisions)

    def close(self) -> None:
        pass


def decided(records: DataFrame, order: list[str]) -> DataFrame:
    """run_id, the columns of order, and decision of records(run_id, order..., FIELDS), a stream: each record against the latest accepted one of its run.

    Records of one micro-batch go in the given order, those of later ones after
    them. The state is one record a run. What a task holds are one run's
    records of one micro-batch, which the source's maxFilesPerTrigger or
    maxBytesPerTrigger bounds.
    """
    kinds = dict(records.dtypes)
    out = ", ".join([f"{c} {kinds[c]}" for c in ("run_id", *order)] + ["decision string"])
    return records.groupBy("run_id").transformWithStateInPandas(_Registry(order), out, "append", "none")


def append(records: DataFrame, order: list[str], path: str, checkpoint: str) -> None:
    """Append what has come to the registry at `path`, which keeps accepted and refused records apart (and records that change nothing with the refused), in folders accepted and refused.

    A micro-batch overwrites its own folder, so one that is tried again after a
    loss isn't there twice. The stream ends when all that is there is read, and
    goes on from the checkpoint when it is called again.
    """
    spark = records.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        ok = F.col("decision") == "ACCEPTED"
        df.filter(ok).write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        df.filter(~ok).write.mode("overwrite").parquet(f"{path}/refused/batch={number}")
        df.unpersist()

    try:
        query = decided(records, order).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All decided records of the registry, with whether they were accepted."""
    kinds = [spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{kind}").drop("batch") for kind in ("accepted", "refused")]
    return kinds[0].unionAll(kinds[1])
