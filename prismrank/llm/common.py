"""What the corpus operators share: reading, shared storage and grouped scans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one that driver and executors share, from spark.checkpoint.dir. A local session without one has a temporary folder; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local_dir()
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="prismrank-")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once in the shared folder and read it back, so that a lost executor
    costs a reread and no later job runs what stands above again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files give work to half of them or fewer, as a table of one row group does; others stay as they are, without a shuffle. Counted from the files' metadata."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    used = df.select(F.spark_partition_id().alias("_p")).distinct().count()
    return df.repartition(cores) if 2 * used <= cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of a batch that goes to Python: texts can be long, and each executor has several batches in hand.
BATCH_ROWS = 1_000


def in_batches(df: DataFrame) -> DataFrame:
    """The DataFrame, which will go to Python in batches of that many rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_batches(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that makes one batch, given as columns, of each batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(fn(batch), schema=schema)

    return over


def join_params(rows: DataFrame, params: DataFrame, keys: list[str], by: str, most: int = 20_000, how: str = "inner") -> DataFrame:
    """Rows with the parameters of their group. Up to `most` groups are counted and broadcast; more are joined by their keys and a salt from column `by`, which splits the rows of a large group."""
    if params.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(params), keys, how)
    salts = shuffle_width(rows.sparkSession)
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")
