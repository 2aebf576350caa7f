"""Queries that aggregate keyed rows: by status, in pairs, over scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.operators import aggregate as A
from prismrank.operators import bootstrap
from prismrank.plans.registry import Query, registrar
from prismrank.sources.files import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)

STATUSES = ["COMPLETE", "FAILED", "RUNNING"]


@register("""WITH o AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'failed' ELSE 'measured' END AS status, CASE WHEN l_discount < 0.08 THEN l_quantity END AS value FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n_expected, count(*) FILTER (l_linestatus IS NOT NULL) AS n_present, count(*) FILTER (status = 'measured') AS n_measured, count(*) FILTER (status IS NULL) AS n_missing, round(avg(value) FILTER (status = 'measured'), 6) AS mean, round(stddev_samp(value) FILTER (status = 'measured'), 6) AS std FROM o GROUP BY ALL""")
def status_aware_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a high discount stand for failed measurements; every line is expected."""
    rows = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_discount") >= 0.08, "failed").otherwise("measured")).withColumn("value", F.when(F.col("status") == "measured", F.col("l_quantity")))
    measured = F.col("status") == "measured"
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_expected"), F.count("status").alias("n_present"), F.count_if(measured).alias("n_measured"), F.count_if(F.col("status").isNull()).alias("n_missing"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@register("""WITH e AS (SELECT doc_id, lang FROM documents), o AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT lang, count(*) AS n_expected, count(quality) AS n_present, count(*) FILTER (toxic = 0) AS n_measured, count(*) FILTER (quality IS NULL) AS n_missing, round(avg(quality) FILTER (toxic = 0), 6) AS mean, round(stddev_samp(quality) FILTER (toxic = 0), 6) AS std FROM e LEFT JOIN o USING (doc_id) GROUP BY lang""")
def expected_against_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents; those of toxic ones aren't measured."""
    expected = table(spark, sf_dir, "documents").select("lang", "doc_id")
    seen = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("value"), F.max("toxic").alias("toxic"))
    observed = expected.join(seen, "doc_id").select("lang", "doc_id", F.col("value").cast("double").alias("value"), F.when(F.col("toxic") == 0, "measured").otherwise("failed").alias("status"))
    out = A.status_summary(expected, observed, ["lang"], "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@register("""WITH r AS (SELECT o_custkey, o_orderpriority AS condition, avg(o_totalprice) AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey, v AS base FROM r WHERE condition = '1-URGENT')
SELECT condition, count(*) AS n_pairs, round(avg(v - base), 4) AS mean_delta, count(*) FILTER (v > base) AS n_up FROM r JOIN b USING (o_custkey) WHERE condition <> '1-URGENT' GROUP BY condition""")
def paired_delta_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("v"))
    deltas = A.paired_delta(per, ["o_custkey"], "condition", "1-URGENT", "v")
    return deltas.groupBy("condition").agg(F.count("*").alias("n_pairs"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("n_up"))


_SCOPES = {"overall": [], "flag": ["l_returnflag"], "status": ["l_linestatus"], "flag_x_status": ["l_returnflag", "l_linestatus"]}


@register("""SELECT CASE grouping_id(l_returnflag, l_linestatus) WHEN 3 THEN 'overall' WHEN 1 THEN 'flag' WHEN 2 THEN 'status' ELSE 'flag_x_status' END AS scope, l_returnflag, l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pearson_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.over_scopes(table(spark, sf_dir, "lineitem"), _SCOPES, {"n": F.count("*"), "r": A.pearson(F.col("l_quantity"), F.col("l_extendedprice"))})
    return out.withColumn("r", F.round("r", 6))


@register("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@register("""WITH p AS (SELECT o_custkey, o_orderpriority AS c, avg(o_totalprice) AS v, count(*)::DOUBLE AS w FROM orders GROUP BY ALL), b AS (SELECT o_custkey, v AS bv, w AS bw FROM p WHERE c = '1-URGENT')
SELECT c AS condition, count(*) AS n, round(corr(v - bv, w - bw), 6) AS r FROM p JOIN b USING (o_custkey) WHERE c <> '1-URGENT' GROUP BY c""")
def paired_delta_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("v"), F.count("*").cast("double").alias("w"))
    return A.delta_correlation(per, ["o_custkey"], "condition", "1-URGENT", "v", "w").select("condition", "n", F.round("r", 6).alias("r"))


@register("""WITH p AS (SELECT o_custkey, o_orderpriority AS c, round(avg(o_totalprice), 2) AS v, count(*)::DOUBLE AS w FROM orders GROUP BY ALL), d AS (SELECT p.c, round(p.v - b.v, 2) AS x, p.w - b.w AS y FROM p JOIN p b ON b.o_custkey = p.o_custkey AND b.c = '1-URGENT' WHERE p.c <> '1-URGENT'),
r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / 2.0 AS ry FROM d)
SELECT c AS condition, count(*) AS n, round(corr(x, y), 5) AS r, round(corr(rx, ry), 5) AS rho FROM r GROUP BY c""")
def paired_delta_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and rank correlation of the differences from the urgent orders of the same customer, in price and in number."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"), F.count("*").cast("double").alias("w"))
    found = A.delta_correlation(per, ["o_custkey"], "condition", "1-URGENT", "v", "w")
    return found.select("condition", "n", F.round("r", 5).alias("r"), F.round("rho", 5).alias("rho"))


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def p50_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"), F.count("*").alias("n"))


@register("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'X') AS X FROM lineitem GROUP BY l_returnflag")
def status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crosstab(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F", "X"])


@register("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('UNKNOWN')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def value_counts_fixed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(s,) for s in ("F", "O", "P", "UNKNOWN")], "status string")
    return domain.join(counts, F.col("status") == F.col("o_orderstatus"), "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT source, round(max(m) FILTER (lang = 'en'), 4) AS en, round(max(m) FILTER (lang = 'de'), 4) AS de, round(max(m) FILTER (lang = 'fr'), 4) AS fr, round(max(m) FILTER (lang = 'es'), 4) AS es FROM (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY source")
def pivot_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.avg("n_chars"))
    return wide.select("source", *[F.round(c, 4).alias(c) for c in ("en", "de", "fr", "es")])


@register("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS min, quantile_cont(n_chars::DOUBLE, 0.25) AS q25, quantile_cont(n_chars::DOUBLE, 0.5) AS q50, quantile_cont(n_chars::DOUBLE, 0.75) AS q75, max(n_chars) AS max FROM documents GROUP BY lang")
def describe_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(*A.describe("n_chars"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@register("SELECT n_turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) GROUP BY n_turns")
def frequency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns")).groupBy("n_turns").agg(F.count("*").alias("n"))


@register("SELECT lang, count(*) AS expected_n, count(quality) AS measured_n, round(avg(quality), 6) AS mean_quality, round(avg(CAST(quality IS NOT NULL AS INTEGER)), 6) AS measurable_rate FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang")
def expected_measured_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("expected_n"), F.count("quality").alias("measured_n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg(F.col("quality").isNotNull().cast("int")), 6).alias("measurable_rate"))


@register("SELECT quality AS gold, count(*) AS n, round(avg(CAST((n_chars >= 300) = (quality = 1) AS INTEGER)), 6) AS class_recall FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a rule on length agrees with the label, by label."""
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    agree = ((F.col("n_chars") >= 300) == (F.col("quality") == 1)).cast("int")
    return both.groupBy(F.col("quality").alias("gold")).agg(F.count("*").alias("n"), F.round(F.avg(agree), 6).alias("class_recall"))


@register("SELECT lang, source, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def diagnostic_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang", "source", "quality", "toxic").agg(F.count("*").alias("n"))


@register("SELECT l_returnflag, round(avg(m), 6) AS within_then_across, round(avg(a), 6) AS across FROM (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m, sum(l_quantity) / count(*) AS a FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def within_then_across_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_quantity").alias("m"), (F.sum("l_quantity") / F.count("*")).alias("a"))
    return per.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("within_then_across"), F.round(F.avg("a"), 6).alias("across"))


@register()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval and verdict of the mean difference of orders' prices from the urgent ones of the same customer."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("v"))
    deltas = A.paired_delta(per, ["o_custkey"], "condition", "1-URGENT", "v")
    out = A.bootstrap_mean(deltas, ["condition"], "o_custkey", "delta", 10_000)
    return out.withColumn("verdict", A.verdict(F.col("low"), F.col("high")))


_REPLICATES, _BLOCK = 200, 256


@register(f"""WITH per AS (SELECT o_custkey, o_orderpriority AS condition, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
d AS (SELECT a.condition, a.o_custkey AS id, a.v - b.v AS x FROM per a JOIN per b ON a.o_custkey = b.o_custkey AND b.condition = '1-URGENT' WHERE a.condition <> '1-URGENT'),
s AS (SELECT *, count(*) OVER (PARTITION BY condition) AS n FROM d),
b AS (SELECT *, CAST('0x' || substr(md5(id::VARCHAR), 1, 15) AS BIGINT) % CAST(ceil(n / {_BLOCK}) AS BIGINT) AS block FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY condition, block ORDER BY id) - 1 AS place FROM b),
z AS (SELECT condition, n, block, count(*) AS size FROM p GROUP BY ALL),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY condition ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM z),
r AS (SELECT CAST(r AS BIGINT) AS r FROM range(0, {_REPLICATES}) t(r)),
j AS (SELECT condition, n, r, unnest(range(0, n)) AS j FROM (SELECT DISTINCT condition, n FROM z), r),
first AS ({bootstrap.sql_mixed("j", bootstrap.TO_BLOCKS, "r", "0", "j")}),
dealt AS (SELECT condition, r, block, count(*) AS m FROM (SELECT f.condition, f.r, c.block FROM (SELECT *, (z % n::UBIGINT)::BIGINT AS at FROM first) f JOIN c ON c.condition = f.condition AND f.at >= c.before AND f.at < c.before + c.size) GROUP BY ALL),
i AS (SELECT condition, r, block, unnest(range(0, m)) AS i FROM dealt),
second AS ({bootstrap.sql_mixed("i", bootstrap.IN_BLOCK, "r", "block", "i")}),
means AS (SELECT s.condition, s.r, sum(p.x) / any_value(p.n) AS m FROM second s JOIN c ON c.condition = s.condition AND c.block = s.block JOIN p ON p.condition = s.condition AND p.block = s.block AND p.place = (s.z % c.size::UBIGINT)::BIGINT GROUP BY ALL)
SELECT condition, any_value(q.n) AS n, round(any_value(q.mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high,
  CASE WHEN quantile_cont(m, 0.025) > 0 THEN 'improvement' WHEN quantile_cont(m, 0.975) < 0 THEN 'degradation' ELSE 'uncertain' END AS verdict
FROM means JOIN (SELECT condition, count(*) AS n, avg(x) AS mean FROM d GROUP BY condition) q USING (condition) GROUP BY condition""")
def bootstrap_exact_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals by resampling exactly, in blocks of 256 rows, so that the draws are dealt to several."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("v"))
    deltas = A.paired_delta(per, ["o_custkey"], "condition", "1-URGENT", "v")
    out = bootstrap.bootstrap_exact(deltas, ["condition"], "o_custkey", "delta", _REPLICATES, _BLOCK)
    rounded = {c: F.round(c, 4) for c in ("mean", "low", "high")}
    return out.withColumn("verdict", A.verdict(F.col("low"), F.col("high"))).withColumns(rounded)


@register("""SELECT n_name AS retriever, o_orderpriority AS condition, count(*) AS n, round(avg(o_totalprice), 4) AS mean, NULL::VARCHAR AS none FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def master_results_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries joined on their dimensions; the dimension tables are small beside the facts, and Spark broadcasts what it measures as small."""
    facts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.groupBy(F.col("n_name").alias("retriever"), F.col("o_orderpriority").alias("condition")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.lit(None).cast("string").alias("none"))
