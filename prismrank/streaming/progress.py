"""Run logs as streams: counts by status and time, and only what isn't done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Parquet files or a folder of files of that name, as they appear."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parq*")


def status_counts(events: DataFrame, ts: str, status: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by status and tumbling window; rows later than the watermark are dropped."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", every).alias("window"), status).agg(F.count("*").alias("n")).select("window.start", status, "n")


def produce_missing(stream: DataFrame, output: str, keys: list[str], produce: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that appends produce() of the rows whose keys aren't in the output yet, batch by batch."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(output)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            df = df.join(spark.read.parquet(output).select(*keys), keys, "left_anti")
        produce(df.dropDuplicates(keys)).write.mode("append").parquet(output)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(counts: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Run a stream of counts over all that is there now, into Parquet, and read that: all windows, those the watermark hasn't closed included."""
    spark = counts.sparkSession
    spark.createDataFrame([], counts.schema).write.parquet(output)  # for a stream without rows

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(output)

    query = counts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(output)
