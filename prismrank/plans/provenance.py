"""Queries on joins that must hold, manifests, run logs and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.operators import checks, hash_tree, runs
from prismrank.operators import workflow as V
from prismrank.plans.registry import Query, registrar
from prismrank.sources import sealed
from prismrank.sources.files import scratch, table
from prismrank.streaming import progress, registry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)

_LOG = "log AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'view' THEN 'PLANNED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAILED' END AS status FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "PLANNED").when(kind == "click", "RUNNING").when(kind == "purchase", "COMPLETE").otherwise("FAILED")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", status.alias("status"))


@register("SELECT doc_id, sha256(text) AS text_sha256, sha256(doc_id || '|' || sha256(text)) AS row_sha256 FROM documents")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("SELECT doc_id // 100 AS shard, count(*) AS n, sha256(string_agg(sha256(doc_id || '|' || sha256(text)), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.shard_digests(corpus_manifest(spark, sf_dir), "doc_id", 100)


_LEAF = "sha256(doc_id || '|' || sha256(lang) || '|' || sha256(text))"


@register(f"""WITH l AS (SELECT doc_id, {_LEAF} AS d FROM documents), a AS (SELECT doc_id // 50 AS node, count(*) AS n, sha256(string_agg(d, '' ORDER BY doc_id)) AS digest FROM l GROUP BY 1),
b AS (SELECT node // 50 AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM a GROUP BY 1)
SELECT 0 AS level, doc_id AS node, 1 AS n, d AS digest FROM l UNION ALL SELECT 1, node, n, digest FROM a UNION ALL SELECT 2, node, n, digest FROM b""")
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower three levels of the hash tree that seals the documents' files, as written and read again."""
    at = scratch(spark, "sealed")
    sealed.seal(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), at, "doc_id", 200, 50)
    sealed.read_verified(spark, at, "doc_id long, lang string, text string", "doc_id", 50)
    return spark.read.parquet(f"{at}/tree").filter("level <= 2").select("level", "node", "n", "digest")


@register("""SELECT doc_id AS position, CASE WHEN doc_id % 97 = 5 THEN 'MISSING' WHEN doc_id % 101 = 7 THEN 'REPEATED' ELSE 'CHANGED' END AS state, 1 AS n_expected, CASE WHEN doc_id % 97 = 5 THEN 0 WHEN doc_id % 101 = 7 THEN 2 ELSE 1 END AS n_found
FROM documents WHERE doc_id % 97 = 5 OR doc_id % 101 = 7 OR doc_id % 89 = 3
UNION ALL SELECT doc_id + 1000000000, 'EXTRA', 0, 1 FROM documents WHERE doc_id % 211 = 1""")
def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a copy in which rows are lost, repeated, altered and added: each is named, from the trees of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    n = F.col("doc_id")
    kept = docs.filter(n % 97 != 5)
    altered = kept.withColumn("text", F.when((n % 89 == 3) & (n % 101 != 7), F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    other = altered.unionAll(altered.filter(n % 101 == 7)).unionAll(docs.filter(n % 211 == 1).withColumn("doc_id", n + 1_000_000_000))
    trees = [hash_tree.build(x, "doc_id", ["lang", "text"], 50) for x in (docs, other)]
    return hash_tree.differences(*trees, 50)


@register("""WITH r AS (SELECT doc_id, doc_id // 100 AS shard FROM documents WHERE NOT (doc_id // 100 % 4 = 2 AND doc_id % 100 < 7) UNION ALL SELECT doc_id, doc_id // 100 + 1 FROM documents WHERE doc_id // 100 % 5 = 3 AND doc_id % 100 > 94),
s AS (SELECT shard, min(doc_id) AS low, max(doc_id) AS high, count(*) AS n FROM r GROUP BY shard), b AS (SELECT *, max(high) OVER (ORDER BY low, high, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT shard, low, high, n, CASE WHEN before IS NULL THEN 'START' WHEN low = before + 1 THEN 'JOINED' WHEN low > before THEN 'GAP' ELSE 'OVERLAP' END AS edge, coalesce(low - before - 1, 0) AS missing FROM b""")
def shard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards as written, of which some lack their first rows and some begin with the last of the shard before: the edges of each, from its file."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id DIV 100").alias("shard"))
    rows = docs.filter(~((F.col("shard") % 4 == 2) & (n % 100 < 7))).unionAll(docs.filter((F.col("shard") % 5 == 3) & (n % 100 > 94)).withColumn("shard", F.col("shard") + 1))
    at = scratch(spark, "shards")
    rows.repartition("shard").write.partitionBy("shard").parquet(at)
    written = spark.read.schema("doc_id long, shard long").parquet(at)
    return hash_tree.edges(written.groupBy("shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")))


@register("""WITH w AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id // 40 % 7 = 3 GROUP BY doc_id)
SELECT doc_id, quality, sha256(text) AS text_sha256, (SELECT count(DISTINCT doc_id // 40) FROM w JOIN documents USING (doc_id)) AS n_opened, (SELECT count(DISTINCT doc_id // 40) FROM documents) AS n_files FROM w JOIN documents USING (doc_id)""")
def position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of some regions, looked up by position in files of 40 positions, with the numbers of files opened and there."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "positions")
    sealed.write_positions(docs, at, "doc_id", 40)
    wanted = table(spark, sf_dir, "labels").filter("doc_id DIV 40 % 7 = 3").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(docs.select("doc_id"), "doc_id", "left_semi")
    found = sealed.lookup(spark, at, "doc_id long, text string", wanted, "doc_id")
    opened = sum(at in f for f in found.inputFiles())
    counts = {"n_opened": F.lit(opened).cast("long"), "n_files": F.lit(sealed.runs(spark, at).count()).cast("long")}
    return found.select("doc_id", "quality", F.sha2("text", 256).alias("text_sha256")).withColumns(counts)


@register("""SELECT lang AS name, doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 3 = 1""")
def lookup_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several tables, one a language, by the table's name and position."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), scratch(spark, "tables")
    paths = {r["lang"]: f"{at}/{i}" for i, r in enumerate(docs.select("lang").distinct().orderBy("lang").collect())}
    for name, path in paths.items():
        sealed.write_positions(docs.filter(F.col("lang") == name).select("doc_id", "text"), path, "doc_id", 500)
    wanted = docs.filter("doc_id % 3 = 1").select(F.col("lang").alias("name"), "doc_id")
    return sealed.lookup_in(spark, paths, "doc_id long, text string", wanted, "doc_id").select("name", "doc_id", F.sha2("text", 256).alias("text_sha256"))


@register("""WITH a AS (SELECT doc_id, sha256(doc_id || '|' || sha256(text)) AS h FROM documents), l AS (SELECT doc_id, bool_or(quality = 1 AND toxic = 0) AS same FROM labels GROUP BY doc_id), b AS (SELECT l.doc_id, sha256(l.doc_id || '|' || sha256(CASE WHEN same THEN text ELSE 'mended' END)) AS h FROM l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'MISSING' WHEN a.doc_id IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest against that of the labelled ones, in which those of bad or toxic text have another text."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("same"))
    mended = labels.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.when(F.col("same"), F.col("text")).otherwise("mended"))
    return checks.manifest_differences(checks.manifest(docs, "doc_id", "text"), checks.manifest(mended, "doc_id", "text"), "doc_id")


@register("SELECT text_sha256, count(*) AS n FROM (SELECT sha256(text) AS text_sha256 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256")), ["text_sha256"])


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def manifest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unknown(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@register("SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality >= 1) GROUP BY lang")
def qrels_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = table(spark, sf_dir, "labels").filter("quality >= 1")
    return table(spark, sf_dir, "documents").join(relevant, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def required_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order without its customer is an error."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return checks.require_match(table(spark, sf_dir, "orders"), customers, ["o_custkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_nations"))


@register("""WITH k AS (SELECT DISTINCT conv_id FROM conversations), a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'), b AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')
SELECT a.conv_id IS NOT NULL AS has_left, b.conv_id IS NOT NULL AS has_right, count(*) AS n FROM k LEFT JOIN a USING (conv_id) LEFT JOIN b ON b.conv_id = k.conv_id GROUP BY ALL""")
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = checks.complete_pairs(turns.select("conv_id").distinct(), turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), ["conv_id"])
    return pairs.groupBy("has_left", "has_right").agg(F.count("*").alias("n"))


@register("SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def turn_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.contiguity(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@register(f"WITH {_LOG} SELECT run_id, arg_max(status, struct_pack(t := ts, e := event_id)) AS status, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM log GROUP BY run_id")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.latest(_log(spark, sf_dir), "run_id", ["ts", "event_id"], "status", "event_id")


@register(f"""WITH {_LOG}, l AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before FROM log)
SELECT before, status, count(*) AS n FROM l WHERE NOT CASE WHEN before IS NULL THEN status = 'PLANNED' WHEN before = 'PLANNED' THEN status = 'RUNNING' WHEN before = 'RUNNING' THEN status IN ('RUNNING', 'COMPLETE', 'FAILED') ELSE false END GROUP BY ALL""")
def registry_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = checks.illegal_transitions(_log(spark, sf_dir), "run_id", ["ts", "event_id"], "status")
    return bad.groupBy("before", "status").agg(F.count("*").alias("n"))


_RECORDS = """
kinds AS (
  SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'view' THEN 'PLANNED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAILED' END AS status FROM events
), records AS (
  SELECT *, CASE WHEN event_id % 11 = 3 THEN 'other' ELSE 'run' END AS identity, CASE WHEN event_id % 13 = 5 THEN 'env2' ELSE 'env1' END AS environment, 'r' AS runtime,
    CASE WHEN event_id % 7 = 2 THEN NULL ELSE run_id::VARCHAR END AS resume_of,
    CASE WHEN event_id % 17 = 4 THEN NULL WHEN status = 'PLANNED' THEN 0 WHEN status = 'RUNNING' THEN 1 + event_id % 2 ELSE 1 END::INTEGER AS attempt,
    row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS place
  FROM kinds
), steps AS (
  SELECT run_id, 0::BIGINT AS place, NULL::BIGINT AS event_id, NULL::VARCHAR AS decision, NULL::VARCHAR AS i, NULL::VARCHAR AS s, NULL::INTEGER AS a, NULL::VARCHAR AS e, NULL::VARCHAR AS o FROM (SELECT DISTINCT run_id FROM records)
  UNION ALL
  SELECT run_id, place, event_id, d, CASE WHEN d = 'ACCEPTED' THEN identity ELSE i END, CASE WHEN d = 'ACCEPTED' THEN status ELSE s END, CASE WHEN d = 'ACCEPTED' THEN attempt ELSE a END,
    CASE WHEN d = 'ACCEPTED' THEN environment ELSE e END, CASE WHEN d = 'ACCEPTED' THEN resume_of ELSE o END
  FROM (
    SELECT r.*, p.i, p.s, p.a, p.e, p.o, CASE
      WHEN r.attempt IS NULL THEN 'INVALID_RECORD'
      WHEN p.s IS NULL THEN CASE WHEN r.status = 'PLANNED' THEN 'ACCEPTED' ELSE 'NOT_PLANNED' END
      WHEN p.i = r.identity AND p.s = r.status AND p.a = r.attempt AND p.e = r.environment AND p.o IS NOT DISTINCT FROM r.resume_of THEN 'DUPLICATE'
      WHEN p.i <> r.identity THEN 'OTHER_IDENTITY'
      WHEN p.s = 'PLANNED' AND r.status = 'PLANNED' THEN 'DUPLICATE'
      WHEN NOT (p.s = 'PLANNED' AND r.status = 'RUNNING' OR p.s = 'RUNNING' AND r.status <> 'PLANNED') THEN 'INVALID_TRANSITION'
      WHEN p.e <> r.environment THEN 'OTHER_ENVIRONMENT'
      WHEN r.attempt < p.a THEN 'ATTEMPT_FELL'
      WHEN p.s = 'RUNNING' AND r.status = 'RUNNING' AND r.attempt <> p.a + 1 THEN 'ATTEMPT_SKIPPED'
      WHEN p.s = 'RUNNING' AND r.status = 'RUNNING' AND r.resume_of IS DISTINCT FROM r.run_id::VARCHAR THEN 'NOT_RESUMED'
      WHEN p.s = 'RUNNING' AND r.status <> 'RUNNING' AND r.attempt <> p.a THEN 'ATTEMPT_CHANGED'
      WHEN p.s = 'PLANNED' AND r.attempt < 1 THEN 'NOT_STARTED'
      ELSE 'ACCEPTED' END AS d
    FROM steps p JOIN records r ON r.run_id = p.run_id AND r.place = p.place + 1)
)"""


@register(f"WITH RECURSIVE {_RECORDS} SELECT run_id, event_id, decision FROM steps WHERE place > 0")
def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of runs, appended to a registry that refuses what can't follow: every record with its decision, from what was written."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "PLANNED").when(kind == "click", "RUNNING").when(kind == "purchase", "COMPLETE").otherwise("FAILED")
    n = F.col("event_id")
    events = progress.read_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    records = events.select(F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status")).withColumns(
        {
            "identity": F.when(n % 11 == 3, "other").otherwise("run"),
            "environment": F.when(n % 13 == 5, "env2").otherwise("env1"),
            "runtime": F.lit("r"),
            "resume_of": F.when(n % 7 != 2, F.col("run_id").cast("string")),
            "attempt": F.when(n % 17 == 4, None).when(F.col("status") == "PLANNED", 0).when(F.col("status") == "RUNNING", 1 + n % 2).otherwise(1).cast("int"),
        }
    )
    at = scratch(spark, "registry")
    registry.append(records, ["ts", "event_id"], f"{at}/log", f"{at}/checkpoint")
    return registry.read(spark, f"{at}/log", "run_id long, ts timestamp_ntz, event_id long, decision string").select("run_id", "event_id", "decision")


@register("""SELECT CASE WHEN q IS NULL THEN 'MISSING' WHEN q = 1 THEN 'VALID' ELSE 'INVALID' END AS state, count(*) AS n FROM (SELECT d.doc_id, max(quality) AS q FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.doc_id) GROUP BY 1""")
def output_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.inspect_outputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], F.col("quality") == 1)
    return found.groupBy("state").agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT d.doc_id, m.metric_id, CASE WHEN m.for_lang <> 'any' AND m.for_lang <> lang THEN 'WRONG_DATASET' WHEN NOT m.frozen THEN 'PROTOCOL_NOT_FROZEN' WHEN m.needs AND l.doc_id IS NULL THEN 'NO_REFERENCE' ELSE 'ELIGIBLE' END AS decision
  FROM documents d JOIN (VALUES ('recall', 'any', true, true), ('faithfulness', 'any', false, false), ('accuracy', 'en', true, true)) m(metric_id, for_lang, frozen, needs) ON true LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT metric_id, decision, count(*) AS n FROM r GROUP BY ALL""")
def metric_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics can be measured for which documents, by a registry of three."""
    metrics = [("recall", None, None, None, False, True, False), ("faithfulness", None, None, [], False, False, False), ("accuracy", ["en"], None, None, False, True, False)]
    registry = spark.createDataFrame(metrics, checks.REGISTRY)
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has_reference", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset_id")).join(labelled, "doc_id", "left").fillna(False, ["has_reference"])
    each = rows.withColumn("metric_id", F.explode(F.array(*[F.lit(m[0]) for m in metrics])))
    decided = checks.applicability(each.withColumns({"context_mode": F.lit("with"), "frozen": F.lit(True), "has_evaluator": F.lit(True), "generation": F.lit("success")}), registry)
    return decided.groupBy("metric_id", "decision").agg(F.count("*").alias("n"))


#: As a registry of metrics may be: two of retrieval, one of them with an evaluator, an answer's with reference for some data sets, one for contexts only, whose protocol is frozen nowhere, and one of a single data set that needs everything.
_METRICS = [
    ("recall", None, None, ["a", "b"], False, False, False),
    ("diversity", None, None, None, False, False, True),
    ("exact_match", None, None, ["a", "b"], True, True, False),
    ("faithfulness", None, ["with"], [], True, False, True),
    ("official", ["c"], None, ["c"], True, True, True),
    ("grounding", ["a", "c"], ["with"], None, True, False, True),
]


@register("""WITH x AS (SELECT d.doc_id, ['a', 'b', 'c'][(d.doc_id % 3 + 1)::INTEGER] AS ds, CASE WHEN d.doc_id % 4 = 1 THEN 'without' ELSE 'with' END AS cx, d.doc_id % 11 <> 5 AS frozen, l.doc_id IS NOT NULL AS ref, d.doc_id % 5 <> 2 AS ev,
  CASE WHEN d.doc_id % 7 = 3 THEN 'not_run' WHEN d.doc_id % 7 = 4 THEN 'failed' ELSE 'success' END AS g FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
m(metric_id, ds_ok, cx_ok, fr_ok, needs_g, needs_r, needs_e) AS (VALUES ('recall', 'abc', 'both', 'ab', false, false, false), ('diversity', 'abc', 'both', 'abc', false, false, true), ('exact_match', 'abc', 'both', 'ab', true, true, false), ('faithfulness', 'abc', 'with', '', true, false, true), ('official', 'c', 'both', 'c', true, true, true), ('grounding', 'ac', 'with', 'ac', true, false, true)),
r AS (SELECT metric_id, CASE WHEN NOT contains(ds_ok, ds) THEN 'not_applicable/not_defined_for_dataset' WHEN cx_ok = 'with' AND cx = 'without' THEN 'not_applicable/not_defined_for_context_mode' WHEN NOT contains(fr_ok, ds) OR NOT frozen THEN 'not_computed/protocol_not_frozen'
  WHEN needs_r AND NOT ref THEN 'not_computed/reference_unavailable' WHEN needs_e AND NOT ev THEN 'not_computed/evaluator_unavailable' WHEN needs_g AND g = 'not_run' THEN 'not_computed/generation_not_attempted' WHEN needs_g AND g = 'failed' THEN 'failed/generation_failed' ELSE 'eligible/' END AS told FROM x, m)
SELECT metric_id, told, count(*) AS n FROM r GROUP BY ALL""")
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate, in its order, by a registry of six metrics of different needs: retrieval is measured where generation failed, and what needs no reference without one."""
    n = F.col("doc_id")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has_reference", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labelled, "doc_id", "left").fillna(False, ["has_reference"])
    facts = {
        "dataset_id": F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int")),
        "context_mode": F.when(n % 4 == 1, "without").otherwise("with"),
        "frozen": n % 11 != 5,
        "has_evaluator": n % 5 != 2,
        "generation": F.when(n % 7 == 3, "not_run").when(n % 7 == 4, "failed").otherwise("success"),
    }
    each = rows.withColumns(facts).withColumn("metric_id", F.explode(F.array(*[F.lit(m[0]) for m in _METRICS])))
    decided = checks.applicability(each, spark.createDataFrame(_METRICS, checks.REGISTRY))
    return decided.groupBy("metric_id", F.concat_ws("/", F.coalesce("status", F.lit("eligible")), F.coalesce("reason", F.lit(""))).alias("told")).agg(F.count("*").alias("n"))


@register("""WITH m AS (SELECT DISTINCT lang, source FROM documents) SELECT lang, source, c AS condition FROM m JOIN (VALUES ('none'), ('mmr_0.5'), ('dpp_map')) t(c) ON true""")
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language and source that occurs, under each of three conditions."""
    cells = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return cells.withColumn("condition", F.explode(F.array(F.lit("none"), F.lit("mmr_0.5"), F.lit("dpp_map"))))


@register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def pinned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by a manifest, from a source of two revisions, the other of which has other texts under the same ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = docs.select(F.lit("r1").alias("revision"), "doc_id", F.reverse("text").alias("text"))
    source = docs.select(F.lit("r2").alias("revision"), "doc_id", "text").unionAll(other)
    asked = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    manifest = V.numbered(asked, "doc_id", "position")
    return runs.pinned(source, manifest, "r2", "doc_id", "text").select("position", "doc_id", "text")


@register("""WITH l AS (SELECT lang, doc_id, sha256(doc_id || '|' || sha256(text)) AS d FROM documents),
one AS (SELECT lang, doc_id // 1000 AS node, sha256(string_agg(d, '' ORDER BY doc_id)) AS d FROM l GROUP BY ALL), two AS (SELECT lang, node // 1000 AS node, sha256(string_agg(d, '' ORDER BY node)) AS d FROM one GROUP BY ALL),
leaf AS (SELECT lang, count(*) AS n, any_value(d) AS d FROM l GROUP BY lang), root AS (SELECT lang, leaf.n, CASE WHEN leaf.n = 1 THEN leaf.d WHEN (SELECT count(*) FROM one WHERE one.lang = leaf.lang) = 1 THEN (SELECT any_value(d) FROM one WHERE one.lang = leaf.lang) ELSE (SELECT any_value(d) FROM two WHERE two.lang = leaf.lang) END AS d FROM leaf)
SELECT lang, k AS pool, sha256('{"config":{"normalize":true,"pool":' || k || ',"retriever":"dense"},"corpus":{"n_documents":' || n || ',"sha256":"' || d || '"},"version":"1"}') AS fingerprint, n AS n_rows FROM root, (VALUES (20), (50)) t(k)""")
def cache_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache for each language's corpus and configuration, named by both; it is made once, though it is asked for twice."""
    docs, at = table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), scratch(spark, "caches")
    found = []
    for lang in [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]:
        corpus = docs.filter(F.col("lang") == lang)
        root = hash_tree.build(corpus, "doc_id", ["text"]).orderBy(F.desc("level")).first()
        for pool in (20, 50):
            name = runs.cache_identity(root["digest"], root["n"], {"retriever": "dense", "pool": pool, "normalize": True}, "1")
            first = runs.cached(spark, at, "lengths", name, lambda corpus=corpus: corpus.select("doc_id", F.length("text").alias("n")))
            again = runs.cached(spark, at, "lengths", name, lambda corpus=corpus: corpus.filter(F.raise_error(F.lit("made again")).cast("boolean")))
            found.append((lang, pool, name, again.count() if again.schema == first.schema else None))
    return spark.createDataFrame(found, "lang string, pool int, fingerprint string, n_rows long")


@register("SELECT doc_id AS position, 'test' AS role, 5 AS n_candidates, (SELECT count(*) FROM documents WHERE doc_id < 300) AS n_before FROM documents WHERE doc_id < 900")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows of a run that stopped and was gone on with: looked over first, then only what was missing added."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.lit("test").alias("role"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("doc_id") * 10 + i).alias("candidates"))
    at = scratch(spark, "run")
    runs.resume(rows.filter("position < 300"), at, "test", 5, 900)
    done = runs.resume(rows.filter("position < 900"), at, "test", 5, 900)
    return spark.read.schema(rows.schema).parquet(at).select("position", "role", F.size("candidates").alias("n_candidates"), F.lit(done).cast("long").alias("n_before"))


@register("SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").unionByName(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))


@register("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


@register("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@register("SELECT lang, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").dropDuplicates().groupBy("lang").agg(F.count("*").alias("n_sources"))


@register("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS json_sha256 FROM documents")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismrank.sources.files import canonical_json

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(canonical_json(["source", "lang", "doc_id"]), 256).alias("json_sha256"))


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts by type and day from the table as a stream, of all its days."""
    at = scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    counts = progress.status_counts(progress.read_table(spark, sf_dir, "events", schema), "ts", "event_type", "1 day", "1 day")
    return progress.drain(counts, f"{at}/out", f"{at}/log")
