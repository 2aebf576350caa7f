"""Rows by position in files that hold runs of positions: found by opening few files, and sealed by a hash tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.operators import checks, hash_tree
from prismrank.sources.files import write_new

#: Positions of a file. As no position repeats, a file has no more rows.
FILE_ROWS = 1_000_000
_RUN = "run_of_positions"


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_positions(df: DataFrame, path: str, position: str, rows: int = FILE_ROWS) -> None:
    """df in files of runs of positions, sorted, and a table of what positions each run has; a repeated or missing position is an error, and then there is no table of runs, so nothing reads the files."""
    at = F.coalesce(F.col(position), F.raise_error(F.lit("a row without position")).cast("long"))
    run = df.withColumn(_RUN, F.expr(f"`{position}` DIV {rows}")).filter(at.isNotNull())
    run.repartition(_RUN).sortWithinPartitions(_RUN, position).write.partitionBy(_RUN).mode("errorifexists").parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(df.select(position).schema.add(_RUN, "long")).parquet(f"{path}/rows")
    if twice := checks.duplicates(written, [position]).first():
        raise ValueError(f"position {twice[position]} is there {twice['n']} times")
    runs = written.groupBy(F.col(_RUN).alias("run")).agg(F.min(position).alias("low"), F.max(position).alias("high"), F.count("*").alias("n"))
    write_new(runs.withColumn("rows", F.lit(rows)), f"{path}/runs")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run, low, high, n, rows (positions of a run)."""
    return spark.read.schema("run long, low long, high long, n long, rows int").parquet(f"{path}/runs")


def read_runs(spark: SparkSession, path: str, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """The rows, or those of the runs given: other files aren't opened, or even listed."""
    if wanted is not None and not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/rows"] if wanted is None else [f"{path}/rows/{_RUN}={run}" for run in sorted(wanted)]
    return spark.read.option("basePath", f"{path}/rows").schema(f"{schema}, {_RUN} long").parquet(*paths).drop(_RUN)


def lookup(spark: SparkSession, path: str, schema: str, wanted: DataFrame, position: str) -> DataFrame:
    """wanted(position, ...) with the columns of the row at each position; a position that isn't there is an error when it is read.

    The runs that are asked for, of which there are no more than files, come
    to the driver; their files alone are scanned.
    """
    all_runs = runs(spark, path)
    size = all_runs.first()
    asked = wanted.select(F.expr(f"`{position}` DIV {size['rows']}").alias("run")).distinct() if size else all_runs.select("run")
    found = [r["run"] for r in asked.join(all_runs, "run", "left_semi").select("run").collect()]
    return checks.require_match(wanted, read_runs(spark, path, schema, found), [position])


def lookup_in(spark: SparkSession, paths: dict[str, str], schema: str, wanted: DataFrame, position: str, name: str = "name") -> DataFrame:
    """The same over several tables: wanted(name, position, ...) says in which table each position is; only tables that are asked for are opened, and an unknown name is an error."""
    names = [r[name] for r in wanted.select(name).distinct().limit(len(paths) + 1).collect()]
    if unknown := set(names) - set(paths):
        raise KeyError(f"no table of the name {sorted(map(str, unknown))[0]}")
    each = [lookup(spark, paths[x], schema, wanted.filter(F.col(name) == x), position) for x in sorted(names)]
    out = each[0] if each else wanted.join(spark.createDataFrame([], schema), position)
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def seal(df: DataFrame, path: str, position: str, rows: int = FILE_ROWS, fanout: int = hash_tree.FANOUT) -> None:
    """Write df by position with its hash tree. What is there already with the same tree stays; another tree is an error."""
    spark, columns = df.sparkSession, sorted(c for c in df.columns if c != position)
    if there(spark, f"{path}/tree"):
        tree = hash_tree.build(df, position, columns, fanout)
        if hash_tree.differences(_tree(spark, path), tree, fanout).limit(1).count():
            raise FileExistsError(path)
        return
    write_positions(df, path, position, rows)
    # of the rows as they were read again, so that what the tree says is there
    written = read_runs(spark, path, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))
    write_new(hash_tree.build(written, position, columns, fanout), f"{path}/tree")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, node long, n long, low long, high long, digest string").parquet(f"{path}/tree")


def verify(spark: SparkSession, path: str, schema: str, position: str, fanout: int = hash_tree.FANOUT) -> DataFrame:
    """position, state and counts of the rows that aren't as they were sealed."""
    rows = read_runs(spark, path, schema)
    tree = hash_tree.build(rows, position, sorted(c for c in rows.columns if c != position), fanout)
    return hash_tree.differences(_tree(spark, path), tree, fanout)


def read_verified(spark: SparkSession, path: str, schema: str, position: str, fanout: int = hash_tree.FANOUT) -> DataFrame:
    """The rows, if they are as they were sealed; else an error that names a position."""
    if bad := verify(spark, path, schema, position, fanout).orderBy("position").first():
        raise ValueError(f"position {bad['position']} of {path} is {bad['state']}")
    return read_runs(spark, path, schema)
