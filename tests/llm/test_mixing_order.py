"""The mixed documents are written in the order of the plan."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from prismrank.llm import mixing


def test_files_are_in_the_order_of_blocks(spark, tmp_path):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 50)).alias("text"), F.when(F.col("id") < 450, "hot").otherwise("small").alias("source"), F.lit("x").alias("block"))
    options = {"limit": 3.0, "block_tokens": 2000}
    mixing.mixed(docs, **options).write.parquet(f"{tmp_path}/mixed")
    written = [pq.ParquetFile(f).read().column("doc_id").to_pylist() for f in sorted(Path(f"{tmp_path}/mixed").glob("part-*.parquet"))]
    plan = mixing.plan(docs, **options).orderBy("block", "place").collect()
    assert len({r["block"] for r in plan}) > 5 and sum(map(bool, written)) > 0
    assert [i for ids in written for i in ids] == [r["doc_id"] for r in plan]
    assert mixing.mixed(docs, **options).columns == docs.columns
