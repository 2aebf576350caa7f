"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.llm import audit, collocations, forest, huffman, licenses, lines, mixing, neardup, packing, pages, quality, secrets, toxicity
from prismrank.llm.common import read, spread


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(spread(read(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.piece_digests(pieces)


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(spread(read(spark, sf_dir, "documents"))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(spread(read(spark, sf_dir, "documents"))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spread(read(spark, sf_dir, "documents")))


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return forest.search(rows, rows.filter("vec_id % 20 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spread(read(spark, sf_dir, "documents")))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_shared_lines(spread(read(spark, sf_dir, "documents"))))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_packing": op2_packing,
    "op3_pages": op3_pages,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_huffman": op8_huffman,
    "op9_forest": op9_forest,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_lines": op12_lines,
    "op13_audit": op13_audit,
}

ORACLES: dict[str, str] = {
    "op6_mixing": mixing.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_lines": lines.ORACLE,
    "op13_audit": audit.ORACLE,
}
