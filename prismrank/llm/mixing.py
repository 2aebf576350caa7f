"""Mixing sources to target weights by temperature, in DataFrame operations alone.

A source's share of all tokens, to the power of an exponent, is its weight
before normalisation. The exponent is bisected: the largest that is flat enough
for a target entropy, and at least so large that no source is repeated more
often than allowed. The budget lets every document appear at least once; sources
of small shares run through several epochs, each a permutation of its own.
The stream of each source is laid over the blocks evenly, so every block holds
all sources by their weights, and is permuted by itself.

A source may hold any share of all rows: its permutation is cut into buckets of
about BUCKET_ROWS rows by the hash that orders it, and running sums of tokens are
taken in each bucket and over the buckets' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.llm.common import join_params, materialize, text_of

#: Halvings in one pass over the sources, and passes.
HALVINGS, PASSES = 5, 6
BUCKET_ROWS = 1_000
BLOCK_TOKENS = 1 << 18
REPETITION_LIMIT = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def order_hash(*parts) -> Column:
    """60 bits of the md5 of the parts, which orders a permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens (words that white space separates). Rows of one doc_id are one document; a null source is empty; rows without doc_id are left out."""
    counted = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("tokens"))
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))


def exponent(sources: DataFrame, limit: float | None = REPETITION_LIMIT, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for sources(source, tokens): the largest at which the weights' entropy (in nats) is at least the target, then raised as far as the limit of repetitions needs. Each pass narrows the bracket by HALVINGS bisections at once."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    p = sources.filter("tokens > 0").select((F.col("tokens").cast("double") / F.lit(float(total or 1))).alias("p"))

    def bisect(holds: Column, rising: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            steps = 1 << HALVINGS
            probes = [low + (high - low) * i / steps for i in range(1, steps)]
            at = p.select("p", F.explode(F.array(*[F.lit(x) for x in probes])).alias("a")).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l"), F.max("p").alias("most"), F.min("p").alias("least"))
            good = {r["a"] for r in at.filter(holds).select("a").collect()}  # at most 31 numbers
            below = [x for x in probes if (x in good) != rising]  # those under the exponent sought
            low, high = max([low, *below]), min([high, *(x for x in probes if (x in good) == rising)])
        return high if rising else low

    # the weights' entropy falls and the repetitions fall as the exponent rises
    found = 1.0
    if entropy is not None:
        found = bisect(F.log("z") - F.col("a") * F.col("l") / F.col("z") >= entropy, rising=False)
    if limit is not None:
        least = bisect(F.pow(F.col("most") / F.col("least"), 1 - F.col("a")) <= limit, rising=True)
        found = max(found, least) if entropy is not None else least
    return found


def plan(docs: DataFrame, limit: float | None = REPETITION_LIMIT, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """doc_id, source, tokens, weight (of its source), epoch, block and place (from 0) of every appearance of each document.

    Every document appears in epoch 0, those of sources with repetitions left
    again; documents without tokens once. An empty table gives no rows.
    """
    tokens = materialize(document_tokens(docs), "tokens")
    sources = materialize(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    a = exponent(sources, limit, entropy)
    raw = sources.filter("tokens > 0").withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(a)))
    whole = raw.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("once")).first()
    z, once = whole["z"] or 1.0, whole["once"] or 1.0
    blocks = max(1, round(z * once / block_tokens))
    per_source = sources.select(
        "source", F.col("tokens").alias("all"), F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / z).otherwise(0.0).alias("weight"),
        F.greatest(F.pow(F.col("tokens").cast("double"), F.lit(a)) * once, F.col("tokens").cast("double")).alias("stream"), F.ceil(F.col("docs") / BUCKET_ROWS).cast("int").alias("buckets"),
    )
    epochs = F.greatest(F.lit(1), F.ceil(F.round(F.try_divide("stream", "all"), 9))).cast("int")
    shown = join_params(tokens, per_source.withColumn("epochs", F.coalesce(epochs, F.lit(1))), ["source"], "doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    hashed = shown.withColumn("h", order_hash("doc_id", "epoch", F.lit(seed))).withColumn("bucket", F.floor(F.col("h") / float(1 << 60) * F.col("buckets")).cast("int"))
    group = ["source", "epoch", "bucket"]
    sums = hashed.groupBy(group).agg(F.sum("tokens").alias("sum"))
    before = sums.select(*group, F.coalesce(F.sum("sum").over(W.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy(group).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = hashed.withColumn("inside", inside).join(before, group).withColumn("at", F.col("epoch") * F.col("all") + F.col("before") + F.col("inside"))
    kept = at.filter((F.col("epoch") == 0) | (F.col("at") < F.col("stream")))
    block = F.least(F.lit(blocks - 1), F.coalesce(F.floor(F.try_divide(F.col("at"), F.col("stream")) * blocks), F.lit(0))).cast("long")
    place = F.row_number().over(W.partitionBy("block").orderBy(order_hash("doc_id", "epoch", F.lit(seed), F.lit("place")), "doc_id", "epoch")) - 1
    return kept.withColumn("block", block).withColumn("place", place.cast("long")).select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the plan has it, in files ordered by block; all columns. Rows without doc_id stay once."""
    placed = plan(docs, **options).select("doc_id", "block", "place")
    # the order's columns get names of their own, as docs can have any
    placed = placed.select("doc_id", F.col("block").alias("_mix_block"), F.col("place").alias("_mix_place"))
    order = ["_mix_block", "_mix_place"]
    again = docs.filter("doc_id IS NOT NULL").join(placed, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
    return again.unionByName(docs.filter("doc_id IS NULL"))


#: The same plan in DuckDB's SQL, with the default options.
ORACLE = rf"""
WITH RECURSIVE tok AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), src AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS t, count(*) AS docs FROM tok GROUP BY source
), ends AS (
  SELECT max(t)::DOUBLE / min(t) AS spread FROM src WHERE t > 0
), bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(spread, 1 - (lo + hi) / 2) <= {REPETITION_LIMIT} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(spread, 1 - (lo + hi) / 2) <= {REPETITION_LIMIT} THEN (lo + hi) / 2 ELSE hi END
  FROM bisect, ends WHERE i < {HALVINGS * PASSES}
), a AS (
  SELECT hi AS a FROM bisect WHERE i = {HALVINGS * PASSES}
), tot AS (
  SELECT sum(pow(t::DOUBLE, a)) AS z, max(t / pow(t::DOUBLE, a)) AS once FROM src, a WHERE t > 0
), per AS (
  SELECT source, t, docs, CASE WHEN t > 0 THEN pow(t::DOUBLE, a) / z ELSE 0.0 END AS weight, greatest(pow(t::DOUBLE, a) * once, t::DOUBLE) AS stream,
    greatest(1, round(z * once / {BLOCK_TOKENS}))::BIGINT AS blocks FROM src, a, tot
), shown AS (
  SELECT tok.*, per.t, per.weight, per.stream, per.blocks, CAST(e.epoch AS INTEGER) AS epoch
  FROM tok JOIN per USING (source), LATERAL (SELECT unnest(range(0, greatest(1, CASE WHEN per.t > 0 THEN ceil(round(per.stream / per.t, 9)) ELSE 1 END)::BIGINT)) AS epoch) AS e
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws('|', doc_id, epoch, 1)), 1, 15) AS BIGINT) AS h FROM shown
), placed AS (
  SELECT *, epoch * t + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM hashed
), kept AS (
  SELECT *, CAST(least(blocks - 1, CASE WHEN stream > 0 THEN floor(at_ / stream * blocks) ELSE 0 END) AS BIGINT) AS block FROM placed WHERE epoch = 0 OR at_ < stream
)
SELECT doc_id, source, tokens, round(weight, 9) AS weight, epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY CAST('0x' || substr(md5(concat_ws('|', doc_id, epoch, 1, 'place')), 1, 15) AS BIGINT), doc_id, epoch) - 1 AS place
FROM kept
"""
