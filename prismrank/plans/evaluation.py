"""Queries on evaluated answers, claims in two stages, and what is written and read again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.functions import text as X
from prismrank.operators import aggregate, checks, evaluate
from prismrank.operators import workflow as V
from prismrank.plans.registry import Query, registrar
from prismrank.plans.wording import _PAIRS, _normal, _pairs
from prismrank.sources import files
from prismrank.sources.files import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)

_ANSWER = "CASE WHEN label % 2 = 0 THEN vec_id // 6 ELSE -1 - vec_id END"
_DIVERSE = f"""s AS (SELECT {_ANSWER} AS answer, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.answer, avg(1 - list_cosine_similarity(a.v, b.v)) AS diversity FROM s a JOIN s b ON a.answer = b.answer AND a.vec_id < b.vec_id GROUP BY a.answer),
per AS (SELECT s.answer, count(*) AS n_items, any_value(diversity) AS diversity FROM s LEFT JOIN d ON d.answer = s.answer GROUP BY s.answer)"""


@register(f"WITH {_DIVERSE} SELECT answer, n_items, round(diversity, 6) AS diversity FROM per")
def output_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for sentences, up to six an answer; those of odd labels are answers of one sentence."""
    answer = F.when(F.col("label") % 2 == 0, F.floor(F.col("vec_id") / 6)).otherwise(-1 - F.col("vec_id")).cast("long")
    per = evaluate.output_diversity(table(spark, sf_dir, "embeddings").select(answer.alias("answer"), F.col("embedding").alias("v")), ["answer"])
    return per.withColumn("diversity", F.round("diversity", 6))


@register(f"WITH {_DIVERSE} SELECT count(*) AS answers, count(diversity) AS eligible, count(*) - count(diversity) AS ineligible, round(count(diversity) / count(*), 6) AS fraction, round(avg(round(diversity, 6)), 5) AS mean FROM per")
def output_diversity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.diversity_summary(output_diversity(spark, sf_dir)).withColumns({"fraction": F.round("fraction", 6), "mean": F.round("mean", 5)})


@register(f"""WITH {_PAIRS}, m(metric_id, for_dataset, frozen) AS (VALUES ('exact_match', NULL, true), ('token_f1', 'user', true), ('faithfulness', NULL, true), ('accuracy', NULL, false)),
r AS (SELECT metric_id, CASE WHEN for_dataset <> c.role THEN 'not_applicable' WHEN NOT frozen THEN 'not_computed' WHEN length(prediction) >= 4000 THEN 'failed' WHEN metric_id = 'faithfulness' THEN 'not_computed' ELSE 'measured' END AS status,
  CASE WHEN for_dataset <> c.role THEN 'not_defined_for_dataset' WHEN NOT frozen THEN 'protocol_not_frozen' WHEN length(prediction) >= 4000 THEN 'generation_failed' WHEN metric_id = 'faithfulness' THEN 'evaluator_not_configured' END AS reason,
  CASE WHEN metric_id = 'exact_match' AND length(prediction) < 4000 THEN CAST({_normal('prediction')} = {_normal('gold')} AS DOUBLE) END AS em FROM pairs p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn, m)
SELECT metric_id, status, coalesce(reason, 'none') AS reason, count(*) AS n, round(avg(em), 6) AS mean_em FROM r GROUP BY ALL""")
def evaluated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before by a registry of four metrics, with status and reason; roles stand for data sets, very long turns for failed generation."""
    roles = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("dataset_id"))
    rows = _pairs(spark, sf_dir).join(roles, ["conv_id", "turn"]).withColumns({"context_mode": F.lit("with_context"), "frozen": F.lit(True), "has_reference": F.lit(True), "has_evaluator": F.lit(True), "generation": F.when(F.length("prediction") >= 4000, "failed").otherwise("success")})
    needs = (True, True, False)
    registry = spark.createDataFrame([("exact_match", None, None, None, *needs), ("token_f1", ["user"], None, None, *needs), ("faithfulness", None, None, None, *needs), ("accuracy", None, None, [], *needs)], checks.REGISTRY)
    metrics = {k: v for k, v in evaluate.answer_metrics().items() if k != "rouge_l"}
    found = evaluate.evaluate(rows, registry, metrics)
    return found.groupBy("metric_id", "status", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("metric_id") == "exact_match", F.col("value"))), 6).alias("mean_em"))


_CHECKS = """one AS (SELECT doc_id AS claim, i, CASE WHEN (doc_id + i) % 41 <> 0 THEN ((doc_id * 13 + n_chars * 7 + i * 29) % 100) / 100.0 END AS e, ((doc_id * 17 + n_chars * 3 + i * 31) % 100) / 100.0 AS c FROM documents, range(5) t(i)),
two AS (SELECT doc_id AS claim, i, j, CASE WHEN (doc_id + i * 7 + j) % 37 <> 0 THEN ((doc_id * 11 + n_chars * 5 + i * 23 + j * 3) % 100) / 100.0 END AS e FROM documents, range(5) t(i), range(5) u(j) WHERE i < j)"""


@register(f"""WITH {_CHECKS}, s AS (SELECT claim, bool_or(e IS NULL) AS failed, coalesce(bool_or(e >= 0.9), false) AS yes, bool_or(c >= 0.9) AS no FROM one GROUP BY claim),
f AS (SELECT claim, min(i * 10 + j) FILTER (e >= 0.9) AS first, bool_or(e IS NULL) AS broken FROM two GROUP BY claim),
n AS (SELECT claim, count(*) AS seen FROM two JOIN f USING (claim) WHERE first IS NULL OR i * 10 + j <= first GROUP BY claim)
SELECT CASE WHEN failed THEN 'FAILED' WHEN yes AND no OR first IS NOT NULL AND no THEN 'INCONSISTENT' WHEN yes OR first IS NOT NULL THEN 'SUPPORTED' WHEN broken THEN 'FAILED' WHEN no THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS status, count(*) AS n, CAST(sum(CASE WHEN failed OR yes THEN 0 ELSE seen END) AS BIGINT) AS n_pairs
FROM s JOIN f USING (claim) JOIN n USING (claim) GROUP BY 1""")
def two_stage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by five single checks and ten pairs; the probabilities, which a model gives, come from the documents' numbers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim"), "n_chars")
    chance = lambda expression: F.expr(f"({expression}) % 100 / 100.0")
    singles = docs.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(5)]))).select("claim", F.col("i").alias("passage"), F.when((F.col("claim") + F.col("i")) % 41 != 0, chance("claim * 13 + n_chars * 7 + i * 29")).cast("double").alias("p_entail"), chance("claim * 17 + n_chars * 3 + i * 31").cast("double").alias("p_contradict"))
    pairs = docs.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(5) for i in range(j)]))).select("claim", "n_chars", "at.i", "at.j")
    pairs = pairs.select("claim", "i", "j", F.when((F.col("claim") + F.col("i") * 7 + F.col("j")) % 37 != 0, chance("claim * 11 + n_chars * 5 + i * 23 + j * 3")).cast("double").alias("p_entail"))
    found = evaluate.two_stage_status(singles, pairs, ["claim"], 0.9, 0.9)
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_pairs").alias("n_pairs"))


@register("""WITH d AS (SELECT doc_id, doc_id % 11 AS p FROM documents),
r AS (SELECT doc_id, p, list_transform(range(1, CASE WHEN p = 7 THEN 2 ELSE 6 END), lambda k: CASE WHEN p = 9 AND k = 2 THEN NULL ELSE (doc_id + k * k) % 97 END) AS ret,
  CASE WHEN p = 1 THEN NULL WHEN p = 2 THEN [] WHEN p = 3 THEN [(doc_id + 4) % 97, (doc_id + 4) % 97] WHEN p = 8 THEN [(doc_id + 4) % 97, NULL] WHEN doc_id % 2 = 0 THEN [(doc_id + 16) % 97, (doc_id + 50) % 97, (doc_id + 25) % 97] ELSE [(doc_id + 51) % 97] END AS gold,
  CASE WHEN p = 4 THEN NULL ELSE list_transform(range(0, CASE WHEN p = 7 THEN 1 WHEN p = 5 THEN 4 ELSE 5 END), lambda i: CASE WHEN p = 6 AND i = 3 THEN [0.0, 0.0] WHEN p = 10 AND i = 2 THEN [1.0, 'nan'::DOUBLE] ELSE [((doc_id + i) % 5 + 1)::DOUBLE, (i + 1)::DOUBLE] END) END AS v FROM d),
m(metric_id) AS (VALUES ('recall_at_k'), ('mrr_at_k'), ('retrieval_diversity'), ('novelty')),
s AS (SELECT doc_id, metric_id, CASE WHEN metric_id = 'novelty' THEN 'not_computed/evaluator_not_configured'
  WHEN metric_id = 'retrieval_diversity' THEN CASE WHEN p = 4 THEN 'not_computed/missing_embedding' WHEN p = 5 THEN 'failed/invalid_metric_input' WHEN p = 7 THEN 'not_computed/insufficient_items' WHEN p IN (6, 10) THEN 'failed/invalid_metric_input' ELSE 'measured/' END
  WHEN p = 1 THEN 'not_computed/reference_unavailable' WHEN p IN (2, 3, 8, 9) THEN 'failed/invalid_metric_input' ELSE 'measured/' END AS told, ret, gold, v FROM r, m),
f AS (SELECT doc_id, avg(1 - list_cosine_similarity(a, b)) AS diversity FROM (SELECT doc_id, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM r WHERE p NOT IN (4, 6, 10)) x JOIN (SELECT doc_id, unnest(v) AS b, generate_subscripts(v, 1) AS j FROM r WHERE p NOT IN (4, 6, 10)) y USING (doc_id) WHERE i < j GROUP BY doc_id)
SELECT doc_id, metric_id, told, CASE WHEN told = 'measured/' THEN round(CASE metric_id WHEN 'recall_at_k' THEN len(list_intersect(ret[1:4], gold)) / len(gold) WHEN 'mrr_at_k' THEN coalesce(1.0 / list_min(list_filter(range(1, 5), lambda i: list_contains(gold, ret[i]))), 0.0) ELSE diversity END, 6) END AS value FROM s LEFT JOIN f USING (doc_id)""")
def retrieval_metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, gold and vectors from the documents' numbers, sound and unsound in every way: value, status and reason of three metrics at 4 and one that isn't there."""
    n, p = F.col("doc_id"), F.col("doc_id") % 11
    some = lambda low, high, fn: F.transform(F.sequence(F.lit(low), high), fn)
    at = lambda x: (n + x) % 97
    gold = F.when(p == 2, F.array().cast("array<bigint>")).when(p == 3, F.array(at(4), at(4))).when(p == 8, F.array(at(4), F.lit(None).cast("long"))).when(n % 2 == 0, F.array(at(16), at(50), at(25))).otherwise(F.array(at(51)))
    vector = lambda i: F.when((p == 6) & (i == 3), F.array(F.lit(0.0), F.lit(0.0))).when((p == 10) & (i == 2), F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(((n + i) % 5 + 1).cast("double"), (i + 1).cast("double")))
    facts = {
        "dataset_id": F.lit("d"), "context_mode": F.lit("with"), "frozen": F.lit(True), "has_evaluator": F.lit(True),
        "retrieved": some(1, F.when(p == 7, 1).otherwise(5), lambda k: F.when(~((p == 9) & (k == 2)), at(k * k))),
        "gold": F.when(p != 1, gold),
        "vectors": F.when(p != 4, some(0, F.when(p == 7, 0).when(p == 5, 3).otherwise(4), vector)),
    }
    names = ["recall_at_k", "mrr_at_k", "retrieval_diversity", "novelty"]
    registry = spark.createDataFrame([(m, None, None, None, False, False, False) for m in names], checks.REGISTRY)
    found = evaluate.evaluate_retrieval(table(spark, sf_dir, "documents").select("doc_id").withColumns(facts), registry, 4)
    return found.select("doc_id", "metric_id", F.concat_ws("/", "status", F.coalesce("reason", F.lit(""))).alias("told"), F.round("value", 6).alias("value"))


_CHANCE = "CAST('0x' || substr(md5({0} || '|' || {1}), 1, 8) AS BIGINT)"


def _chance(asked: list[tuple[str, str]]) -> list[tuple[float, float] | None]:
    """Stands for a model: probabilities from the digest of what is asked; some calls fail."""
    out = []
    for premise, claim in asked:
        h = int(hashlib.md5(f"{premise}|{claim}".encode()).hexdigest()[:8], 16)
        out.append(None if h % 41 == 0 else (h // 41 % 100 / 100, h // 4100 % 100 / 100))
    return out


@register(f"""WITH c AS (SELECT doc_id // 10 AS answer, doc_id, 'claim ' || doc_id AS claim FROM documents),
p AS (SELECT c.*, i, 'passage ' || (doc_id * 7 + i * 13) % 50 AS passage FROM c, range(5) t(i)),
one AS (SELECT doc_id, i, {_CHANCE.format("passage", "claim")} AS h FROM p),
s AS (SELECT doc_id, bool_or(h % 41 = 0) AS failed, bool_or(h // 41 % 100 >= 85) AS yes, bool_or(h // 4100 % 100 >= 90) AS no FROM one GROUP BY doc_id),
two AS (SELECT a.doc_id, a.i * 10 + b.i AS place, {_CHANCE.format("a.passage || chr(10) || chr(10) || b.passage", "a.claim")} AS h FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.i < b.i),
f AS (SELECT doc_id, min(place) FILTER (h % 41 <> 0 AND h // 41 % 100 >= 85) AS first, bool_or(h % 41 = 0) AS broken FROM two GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS seen FROM two JOIN f USING (doc_id) WHERE first IS NULL OR place <= first GROUP BY doc_id),
r AS (SELECT doc_id // 10 AS answer, CASE WHEN failed OR yes THEN 0 ELSE seen END AS n_pairs, CASE WHEN failed THEN 'F' WHEN (yes OR first IS NOT NULL) AND no THEN 'I' WHEN yes OR first IS NOT NULL THEN 'S' WHEN broken THEN 'F' WHEN no THEN 'C' ELSE 'U' END AS st FROM s JOIN f USING (doc_id) JOIN n USING (doc_id)),
g AS (SELECT answer, answer % 7 <> 3 AS has_context, count(*) AS n_claims, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, count(*) FILTER (st <> 'F') AS ok, count(*) FILTER (st = 'F') AS bad, count(*) FILTER (st = 'S') AS s, count(*) FILTER (st = 'C') AS c, count(*) FILTER (st = 'I') AS i, count(*) FILTER (st = 'U') AS u FROM r GROUP BY answer)
SELECT answer, n_claims, n_pairs, CASE WHEN has_context THEN ok END::DOUBLE AS n_success, CASE WHEN has_context THEN bad END::DOUBLE AS n_failed, CASE WHEN has_context AND ok > 0 THEN round(s / ok, 6) END AS supported, CASE WHEN has_context AND ok > 0 THEN round(c / ok, 6) END AS contradicted, CASE WHEN has_context AND ok > 0 THEN round(i / ok, 6) END AS inconsistent, CASE WHEN has_context AND ok > 0 THEN round(u / ok, 6) END AS unsupported FROM g""")
def staged_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of ten claims each, verified in two stages by a stand-in model; some answers had no context. n_pairs counts the calls on pairs."""
    n = F.col("doc_id")
    passages = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("passage "), ((n * 7 + i * 13) % 50).cast("string")))
    claims = table(spark, sf_dir, "documents").select(F.expr("doc_id DIV 10").alias("answer"), "doc_id", F.concat(F.lit("claim "), n.cast("string")).alias("claim_text"), passages.alias("passages"))
    found = evaluate.staged_claims(claims, ["answer", "doc_id"], _chance, 0.85, 0.9)
    answers = claims.select("answer").distinct().withColumn("has_context", F.col("answer") % 7 != 3)
    scores = evaluate.answer_faithfulness(found, answers, ["answer"])
    calls = found.groupBy("answer").agg(F.sum("n_pairs").alias("n_pairs"))
    rates = {c: F.round(c, 6) for c in ("supported", "contradicted", "inconsistent", "unsupported")}
    counts = {c: F.col(c).cast("double") for c in ("n_success", "n_failed")}
    return scores.withColumns(rates | counts).join(calls, "answer")


@register("""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 0.0 ELSE coalesce((SELECT max((turn * 37 + i * 11 + conv_id) % 100 / 100.0) FROM range(6) t(i) WHERE i < turn % 4 AND (turn + i) % 3 <> 0), 0.0) END::DOUBLE AS entailment FROM conversations""")
def largest_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers with up to three passages, some of them blank; probabilities, which a model gives, come from the numbers."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    i = F.explode(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < F.col("turn") % 4)).alias("i")
    checked = turns.select("conv_id", "turn", i).withColumns({"premise": F.when((F.col("turn") + F.col("i")) % 3 == 0, " \n").otherwise("a passage"), "p_entail": ((F.col("turn") * 37 + F.col("i") * 11 + F.col("conv_id")) % 100 / 100.0).cast("double")})
    return evaluate.largest_entailment(checked, turns, ["conv_id", "turn"])


@register("""SELECT vec_id AS doc_id, round(sqrt(list_inner_product(v, v)), 5) AS length FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written once and read again while the corpus has as many rows."""
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    path = files.scratch(spark, "vectors")
    evaluate.kept_embeddings(corpus, path, lambda c: c)
    again = evaluate.kept_embeddings(corpus, path, lambda c: c.filter(F.raise_error(F.lit("computed again")).cast("boolean")))
    return again.select("doc_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("length"))


@register("SELECT doc_id, sha256('{\"id\":' || doc_id || '}') AS number_sha256, sha256('{\"id\":\"' || lang || '\"}') AS text_sha256 FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids: of numbers and of texts."""
    docs = table(spark, sf_dir, "documents")
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", *[F.sha2(X.stable_id(F.col(c), kinds[c]), 256).alias(n) for c, n in (("doc_id", "number_sha256"), ("lang", "text_sha256"))])


@register("SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one JSON object a line, new or not at all, and scanned again."""
    turns, at = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), files.scratch(spark, "jsonl")
    files.write_new(turns, at, "json")
    return files.jsonl(spark, at, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", files.text_hash(F.col("text")).alias("text_sha256"))


@register("SELECT lang, source, count(*) AS n, count(*) AS n_files FROM (SELECT DISTINCT lang, source, doc_id FROM documents) GROUP BY ALL")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file JSON documents with the file's name: each document's row as an object of its own."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), files.scratch(spark, "objects")
    files.write_new(docs, at, "json")
    found = files.jsonl(spark, at, "doc_id long, lang string, source string").withColumn("file", F.input_file_name())
    return found.filter(F.col("file").endswith(".json")).groupBy("lang", "source").agg(F.countDistinct("doc_id").alias("n"), F.countDistinct("doc_id").alias("n_files"))


@register("""WITH d AS (SELECT doc_id // 8 AS f, doc_id, lang, n_chars FROM documents WHERE doc_id // 8 % 5 <> 1 OR doc_id % 8 = 0),
f AS (SELECT f, count(*) AS n, max(n_chars) AS most, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM d GROUP BY f)
SELECT f AS name, CASE WHEN f % 7 = 3 OR f % 7 = 5 THEN 0 ELSE n END AS n_objects, CASE WHEN f % 7 = 3 THEN 'BROKEN' WHEN f % 7 = 5 THEN 'EMPTY' WHEN f % 7 = 6 THEN 'UNNAMED' WHEN n = 1 THEN 'ARTIFACT' ELSE 'SEVERAL' END AS state,
  CASE WHEN f % 7 IN (3, 5) THEN '' ELSE langs END AS langs, CASE WHEN f % 7 IN (3, 5) THEN 0 ELSE most END AS most FROM f""")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are lists of nested objects, some with one, some broken in the middle, some empty lists and some of objects without their name: each file's state and what its objects hold."""
    docs, at = table(spark, sf_dir, "documents"), files.scratch(spark, "lists")
    name = F.expr("doc_id DIV 8")
    rows = docs.filter((name % 5 != 1) | (F.col("doc_id") % 8 == 0)).select(name.alias("name"), F.struct("doc_id", F.struct("lang", F.array("n_chars").alias("sizes")).alias("about")).alias("o"))
    lists = rows.groupBy("name").agg(F.to_json(F.collect_list("o")).alias("whole"))
    whole, n = F.replace("whole", F.lit("},{"), F.lit("},\n{")), F.col("name") % 7
    texts = lists.select("name", F.when(n == 3, F.left(whole, F.length(whole) - 4)).when(n == 5, "[ ]").when(n == 6, F.replace(whole, F.lit('"doc_id"'), F.lit('"id"'))).otherwise(whole).alias("value"))
    files.write_texts(texts, at, "name")
    schema = "doc_id long, about struct<lang: string, sizes: array<int>>"
    langs, most = F.array_join(F.array_sort(F.collect_set("about.lang")), ","), F.max(F.array_max("about.sizes")).cast("long")
    states = files.inspect_folders(spark, at, schema, "doc_id", langs=langs, most=most)
    return states.select(F.regexp_extract("file", r"name=(\d+)/", 1).cast("long").alias("name"), "n_objects", "state", "langs", "most").fillna({"langs": "", "most": 0})


@register("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def csv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as one CSV file with a header and scanned again."""
    at = files.scratch(spark, "summary")
    files.write_summary(table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), at, ["lang", "source"])
    return files.csv(spark, at, "lang string, source string, n long")


@register("SELECT doc_id, lang FROM documents")
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after one language and was gone on with: each key once."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "lang"), files.scratch(spark, "append")
    files.write_new(docs.filter("lang = 'en'"), at)
    files.append_missing(docs, at, ["doc_id"])
    files.append_missing(docs, at, ["doc_id"])
    return spark.read.schema(docs.schema).parquet(at)


@register("SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, true AS in_order FROM documents")
def written_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in ranges of doc_id, verified as written: no file's range meets another's. The same rows again are accepted, no others."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "lang"), files.scratch(spark, "shards")
    files.write_shards(docs, at, "doc_id", 500)
    files.write_same_or_new(docs, at, "doc_id")
    there = spark.read.schema(docs.schema).parquet(at).withColumn("file", F.input_file_name())
    per = there.groupBy("file").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    met = per.alias("a").join(per.alias("b"), F.expr("a.file < b.file AND a.low <= b.high AND b.low <= a.high")).limit(1).count()  # a row for each file
    return per.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("in_order", F.lit(not met))


@register("""WITH m AS (SELECT doc_id, sha256(text) AS s FROM documents), a AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN sha256('other') ELSE s END AS s FROM labels l LEFT JOIN m USING (doc_id))
SELECT CASE WHEN m.doc_id IS NULL THEN 'UNKNOWN' WHEN a.s IS DISTINCT FROM m.s THEN 'text_sha256' ELSE 'BOUND' END AS binding, count(*) AS n FROM a LEFT JOIN m USING (doc_id) GROUP BY 1""")
def artifact_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as artifacts, bound to the documents' manifest by digest; those of toxic texts carry another."""
    manifest = checks.manifest(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").join(manifest.select("doc_id", "text_sha256"), "doc_id", "left")
    artifacts = labels.withColumn("text_sha256", F.when(F.col("toxic") == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("text_sha256")))
    return evaluate.bound(artifacts, manifest, ["doc_id"], ["text_sha256"]).groupBy("binding").agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT CASE WHEN l_discount >= 0.05 THEN 'with' ELSE 'without' END AS mode, l_returnflag, l_linestatus, l_quantity FROM lineitem)
SELECT mode, CASE WHEN mode = 'with' THEN l_linestatus END AS l_linestatus, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM r GROUP BY ALL""")
def scoped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose second key counts in one scope only."""
    rows = table(spark, sf_dir, "lineitem").withColumn("mode", F.when(F.col("l_discount") >= 0.05, "with").otherwise("without"))
    keyed = aggregate.scope_key(rows, F.col("mode"), {"without": ["l_linestatus"]})
    return keyed.groupBy("mode", "l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@register("""SELECT o_custkey, bool_and(coalesce(prev >= o_totalprice, true)) AS descending FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) GROUP BY o_custkey""")
def descending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether prices never rise along a customer's orders."""
    return checks.descending(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@register("""WITH c AS (SELECT conv_id, turn, text, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'The question ' || conv_id || ' can''t be answered.' ELSE 'The answer to ' || conv_id || ' is ' || text || '.' END AS claim, coalesce(nullif(trim(text), ''), role) AS filled, CASE role WHEN 'user' THEN 0.0 WHEN 'assistant' THEN CAST(length(text) > 100 AS DOUBLE) END AS score FROM c""")
def worded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each turn, its text or else its role, and its score by role as status."""
    status = F.when(F.col("role") == "user", "REFUSAL").when(F.col("role") == "assistant", "OK").otherwise("ERROR")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.question_claim(F.col("conv_id").cast("string"), F.col("text"), status).alias("claim"), F.trim(X.first_filled(F.col("text"), F.col("role"))).alias("filled"), V.paired_correct(F.length("text") > 100, F.lit(True), status).alias("score"))
