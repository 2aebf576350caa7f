"""A training corpus from documents: five stages, each written and read again by the next.

toxicity drops what scores as toxic, near duplicates keeps one document of each
group, secrets replaces secrets by their kinds, mixing repeats documents of small
sources until the weights are met, packing deals the tokens to sequences. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismrank.llm import mixing, neardup, packing, secrets, toxicity
from prismrank.llm.common import materialize, read, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go; null texts are scored as empty. The model learns from the labelled rows of the given tables, and judges the stage's own rows."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the document of the least doc_id stays, of rows with one doc_id one; rows without doc_id and texts without words stay."""
    return neardup.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with [kind] for each secret and n_chars of the new text; null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or, of small sources, up to twice, in the order of the plan's blocks; null sources are one source, rows without doc_id stay once."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row in sequences of 2048 tokens; a null or empty text is its end id alone, a document that is there twice is packed twice."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenising and the learned stages have no SQL; tests hold the operators behind them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
