"""Reading and writing the library's files through Spark, so that any store Spark knows will do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_A_TASK = 200
FILES_A_FOLDER = 50_000
LISTINGS_A_CORE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files give work to half of them or fewer, as a table of one row group does; others stay as they are, without a shuffle. Counted from the files' metadata."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    used = df.select(F.spark_partition_id().alias("_p")).distinct().count()
    return df.repartition(cores) if 2 * used <= cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the folder that driver and executors share. What is there stays until clear() is called."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has written in between. DataFrames that come from it can't be read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_shared(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _shared(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir. A local session without one has a temporary folder; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local()
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once, for the steps that read it."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="prismrank-")


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole files of one object or a list of objects each, nested as the schema says: a row an object, with its file. Of a file that is no JSON the row is its text, as broken, without anything else."""
    read = spark.read.schema(f"{schema}, broken string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken", recursiveFileLookup=True)
    return read.json(path).select("*", F.col("_metadata.file_path").alias("file"))


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in some tasks a core. Spark's own 10,000 take a folder or a few each, and longer to start than to list."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), LISTINGS_A_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_texts(df: DataFrame, path: str, by: str) -> None:
    """A new folder with a file for each value of `by`, in folder=number/by=value, of df(by, value). Files are dealt by their number, as they cost much time and few bytes: Spark merges parts by bytes unless their number is given. Tasks put their files in place and clear up after themselves, as the driver would move and remove one after another."""
    n = df.agg(F.approx_count_distinct(by)).first()[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_A_TASK))
    committer = {"algorithm.version": "2", "task.cleanup.enabled": "true"}
    dealt = df.repartition(parts, by).withColumn("folder", F.pmod(F.hash(by), F.lit(-(-n // FILES_A_FOLDER) or 1)))
    dealt.write.options(**{f"mapreduce.fileoutputcommitter.{k}": v for k, v in committer.items()}).partitionBy("folder", by).text(path)


def inspect_documents(spark: SparkSession, path: str, schema: str, name: str, **more: Column) -> DataFrame:
    """file, n_objects, state of every file and, from the same scan, more sums of its objects (null where there are none or the file is broken): BROKEN, EMPTY, UNNAMED (an object lacks the field that names it), ARTIFACT (one object, as an artifact should be) or SEVERAL. The files are listed without reading them, so that those without an object are there too; Spark passes over files of no bytes."""
    with _listing(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
        objects = json_documents(spark, path, schema)
    sums = [F.count("*").alias("n"), F.count(name).alias("named"), F.bool_or(F.col("broken").isNotNull()).alias("bad")]
    found = objects.groupBy("file").agg(*sums, *[c.alias(n) for n, c in more.items()])
    state = F.when(F.col("bad"), "BROKEN").when(F.col("n").isNull(), "EMPTY").when(F.col("named") < F.col("n"), "UNNAMED").when(F.col("n") == 1, "ARTIFACT").otherwise("SEVERAL")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  listings and scans name local files in two ways
    a, b = listed.select(plain("file").alias("file")), found.withColumn("file", plain("file"))
    return a.join(b, "file", "left").select("file", F.when(F.col("bad"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_objects"), state.alias("state"), *[F.when(~F.col("bad"), F.col(n)).alias(n) for n in more])


def inspect_folders(spark: SparkSession, path: str, schema: str, name: str, **more: Column) -> DataFrame:
    """inspect_documents of what write_texts has written, folder by folder, kept: the driver lists the files of one folder at a time, not of all."""
    pattern, at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folder=*"), scratch(spark, "states")
    there = [s.getPath().toString() for s in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)]
    for folder in there or [path]:
        states = inspect_documents(spark, folder, schema, name, **more)
        states.write.mode("append").parquet(at)
    return spark.read.schema(states.schema).parquet(at)


def csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def text_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All or nothing; what is there already stays and is an error."""
    df.write.format(fmt).mode("errorifexists").save(path)


def write_same_or_new(df: DataFrame, path: str, key: str) -> None:
    """Write, unless the same rows are there; other rows there are an error."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return write_new(df, path)
    there = spark.read.schema(df.schema).parquet(path)
    if df.exceptAll(there).limit(1).count() or there.exceptAll(df).limit(1).count():
        raise FileExistsError(path)
    return None


def write_shards(df: DataFrame, path: str, order: str, rows: int = 1_000_000) -> None:
    """Files of at most so many rows, in ranges of the order column."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)


def write_summary(df: DataFrame, path: str, keys: list[str]) -> None:
    """A small summary as one CSV file with a header, sorted by its keys."""
    df.orderBy(*keys).coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't there yet, to go on after an interruption."""
    there = df.sparkSession.read.schema(df.schema).parquet(path).select(*keys)
    df.join(there, keys, "left_anti").write.mode("append").parquet(path)
