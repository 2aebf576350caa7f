"""Queries on retrieval, selection and their metrics over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismrank.functions.vectors import norm
from prismrank.operators import late, metrics, retrieval, runs, selection
from prismrank.operators import workflow as V
from prismrank.plans import selection_sql
from prismrank.plans.registry import Query, registrar
from prismrank.sources.files import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)

#: A search asks for every row whose id is divisible by this, against all rows.
EVERY = 100
POOL, TOP = 20, 5

_SCORED = f"""
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS query_label, d.label AS label, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
), pool AS (SELECT * FROM ranked WHERE rank <= {POOL})"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "v", F.col("label").alias("query_label"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate pool of each query with its vectors and labels."""
    vectors = _vectors(spark, sf_dir)
    queries = _queries(vectors)
    return retrieval.dense(vectors, queries, POOL).join(vectors, "doc_id").join(queries.select("query_id", "query_label"), "query_id")


def _label_metrics(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Metrics of the dense search, where rows of the query's label are its gold."""
    vectors = _vectors(spark, sf_dir)
    judged, gold = metrics.same_label(dense_top20(spark, sf_dir), vectors, _queries(vectors).select("query_id", F.col("query_label").alias("label")))
    return metrics.metrics_of(judged, gold, k)


@register(f"WITH {_SCORED} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM pool")
def dense_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.dense(vectors, _queries(vectors), POOL).withColumn("score", F.round("score", 6))


@register(f"""WITH {_SCORED.replace("list_inner_product", "list_cosine_similarity")} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM pool""")
def cosine_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.retriever("cosine")(vectors, _queries(vectors), POOL).withColumn("score", F.round("score", 6))


_METRICS = f"""
, gold AS (SELECT query_id, count(*) AS n_gold FROM scored WHERE label = query_label GROUP BY query_id),
per AS (
  SELECT g.query_id, n_gold, count(*) FILTER (rank <= {TOP} AND label = query_label) / n_gold AS recall,
    coalesce(1.0 / min(rank) FILTER (rank <= {TOP} AND label = query_label), 0.0) AS mrr,
    coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {TOP} AND label = query_label), 0.0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_gold, {TOP}) + 1) t(i)) AS ndcg
  FROM gold g JOIN pool p ON g.query_id = p.query_id GROUP BY g.query_id, n_gold
)"""


@register(f"WITH {_SCORED} {_METRICS} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall_at5, round(avg(mrr), 6) AS mrr_at5 FROM per")
def dense_recall_mrr_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _label_metrics(spark, sf_dir, TOP)
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall_at5"), F.round(F.avg("mrr"), 6).alias("mrr_at5"))


@register(f"WITH {_SCORED} {_METRICS} SELECT query_id, n_gold, round(ndcg, 6) AS ndcg FROM per")
def dense_ndcg_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _label_metrics(spark, sf_dir, TOP)
    return per.select("query_id", "n_gold", F.round("ndcg", 6).alias("ndcg"))


@register(f"""WITH {_SCORED} {_METRICS}, c AS (SELECT query_id, count(*) FILTER (label = query_label) / any_value(n_gold) AS r FROM pool JOIN gold USING (query_id) GROUP BY query_id)
SELECT round(avg(r), 6) AS mean_recall, count(*) FILTER (r = 1) AS n_full, count(*) FILTER (r > 0 AND r < 1) AS n_partial, count(*) FILTER (r = 0) AS n_zero FROM c""")
def candidate_recall_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _label_metrics(spark, sf_dir, POOL)
    r = F.col("recall")
    return per.agg(F.round(F.avg(r), 6).alias("mean_recall"), F.count_if(r == 1).alias("n_full"), F.count_if((r > 0) & (r < 1)).alias("n_partial"), F.count_if(r == 0).alias("n_zero"))


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every ten vectors as the tokens of a document, and those whose document asks."""
    tokens = _vectors(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc_id"), "v")
    return tokens, tokens.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "v")


@register("""
WITH tok AS (
  SELECT vec_id // 10 AS id, embedding::DOUBLE[] AS v FROM embeddings
), s AS (
  SELECT q.id AS query_id, d.id AS doc_id, q.rn, max(list_inner_product(q.v, d.v)) AS best
  FROM (SELECT *, row_number() OVER () AS rn FROM tok WHERE id % 100 = 0) q JOIN tok d ON true GROUP BY ALL
), t AS (SELECT query_id, doc_id, sum(best) AS score FROM s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM t)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def maxsim_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten vectors are the tokens of a document; documents whose id is divisible by a hundred ask."""
    tokens, asks = _tokens(spark, sf_dir)
    return retrieval.max_sim(tokens, asks, 10).withColumn("score", F.round("score", 6))


@register()
def maxsim_probed_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over centroids and codes; what it finds has exact scores. Its recall is tested against the exact search."""
    tokens, asks = _tokens(spark, sf_dir)
    return late.search(late.build(tokens), asks, 10).withColumn("score", F.round("score", 6))


_BM25 = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS words FROM documents),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM d),
tfc AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tfc GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark),
qw AS (SELECT query_id, term, count(*) AS weight FROM q GROUP BY ALL),
hit AS (SELECT query_id, doc_id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tfc JOIN idf USING (term) JOIN qw USING (term), st GROUP BY ALL),
al AS (SELECT item_id AS query_id, documents.doc_id, coalesce(score, 0.0) AS score FROM benchmark JOIN documents ON true LEFT JOIN hit ON hit.query_id = item_id AND hit.doc_id = documents.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM al)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {POOL}"""


@register(_BM25)
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(table(spark, sf_dir, "documents"), queries, POOL).withColumn("score", F.round("score", 6))


_HALVED = "documents AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('half|' || doc_id), doc_id) <= count(*) OVER () // 2 THEN 'halfword ' || text ELSE text END AS text FROM main.documents), benchmark AS (SELECT item_id, 'halfword ' || CASE WHEN item_id % 4 = 0 THEN '' ELSE text END AS text FROM main.benchmark), "


@register(_BM25.replace("WITH d AS", f"WITH {_HALVED} d AS", 1))
def bm25_common_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that half of the documents have, and every query; where the documents are even in number, it weighs 0 exactly. Each fourth query is that term alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    halved = V.first_by_hash(docs, "doc_id", "half", docs.count() // 2)
    corpus = halved.select("doc_id", F.when(F.col("first"), F.concat(F.lit("halfword "), "text")).otherwise(F.col("text")).alias("text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("halfword "), F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("text"))).alias("text"))
    return retrieval.bm25(corpus, queries, POOL).withColumn("score", F.round("score", 6))


@register(f"""WITH {_SCORED} SELECT query_id, rank, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS norm_score FROM pool WINDOW w AS (PARTITION BY query_id)""")
def minmax_norm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return pool.select("query_id", "rank", "doc_id", F.round(selection.min_max(F.col("score"), "query_id"), 6).alias("norm_score"))


@register(f"""WITH {_SCORED}, x AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS inside, min(rank) OVER (PARTITION BY query_id, label) AS priority FROM pool
), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY inside, priority) AS INTEGER) AS selected_rank FROM x)
SELECT query_id, selected_rank, doc_id, rank AS original_rank, label FROM y WHERE selected_rank <= {TOP}""")
def cluster_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.round_robin_by_label(_pool(spark, sf_dir), "label", TOP)
    return chosen.select("query_id", "selected_rank", "doc_id", F.col("rank").alias("original_rank"), "label")


_FIRST = f"WITH {_SCORED} SELECT query_id, '<name>' AS condition, rank AS selected_rank, doc_id, rank AS original_rank, round(score, 6) AS native_score FROM pool WHERE rank <= {TOP}"


def _selected(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = selection.diversify(_pool(spark, sf_dir), [name], TOP)
        return chosen.select("query_id", "condition", "selected_rank", "doc_id", "original_rank", F.round("native_score", 6).alias("native_score"))

    return query


def _selection(name: str) -> str | None:
    """The condition's SQL; those that draw at random have none."""
    c = selection.parse_condition(name)
    if name in ("none", "mmr_1"):
        return _FIRST.replace("<name>", name)
    if c.family == "mmr":
        return selection_sql.mmr(_SCORED, name, c.value, TOP)
    if c.family == "agglo":
        return selection_sql.agglo(_SCORED, name, c.value, POOL, TOP)
    return selection_sql.dpp_map(_SCORED, name, TOP) if c.family == "dpp_map" else None


for _name in ("none", "mmr_0", "mmr_0.25", "mmr_0.5", "mmr_0.75", "mmr_1", "kmeans_k2", "kmeans_k3", "kmeans_k5", "agglo_k3", "agglo_k5", "dpp_map", "dpp_seed1", "dpp_seed2", "dpp_seed3"):
    register(_selection(_name), "select_" + _name.replace(".", "_"))(_selected(_name))

FINAL_CONDITIONS = ["none", "mmr_0", "mmr_0.25", "mmr_0.5", "mmr_0.75", "kmeans_k2", "agglo_k3", "dpp_map"]


@register()
def diversity_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All final conditions from one pass over the pools: mean, deviation and range of the selected contexts' diversity, with recall."""
    pool = _pool(spark, sf_dir)
    chosen = selection.diversify(pool, FINAL_CONDITIONS, TOP).join(pool.select("query_id", "doc_id", "v", "label", "query_label"), ["query_id", "doc_id"])
    diverse = metrics.pairwise_diversity(chosen, ["query_id", "condition"], "selected_rank")
    relevant = chosen.groupBy("query_id", "condition").agg(F.avg((F.col("label") == F.col("query_label")).cast("double")).alias("precision"))
    per = diverse.join(relevant, ["query_id", "condition"])
    return per.groupBy("condition").agg(F.count("*").alias("n_queries"), F.avg("diversity").alias("mean_diversity"), F.stddev_samp("diversity").alias("std_diversity"), F.min("diversity").alias("min_diversity"), F.max("diversity").alias("max_diversity"), F.avg("precision").alias("mean_precision"))


@register(f"SELECT condition, count(*) AS n_queries, 0 AS n_faults FROM embeddings, (VALUES {', '.join(f'({c!r})' for c in FINAL_CONDITIONS)}) t(condition) WHERE vec_id % {EVERY} = 0 GROUP BY condition")
def selection_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every query and final condition: five passages, each once, of the pool, in ranks 1 to 5, and without diversification the pool's first."""
    pool = _pool(spark, sf_dir)
    faults = runs.selection_faults(pool, selection.diversify(pool, FINAL_CONDITIONS, TOP), FINAL_CONDITIONS, TOP)
    return faults.groupBy("condition").agg(F.count("*").alias("n_queries"), F.count("fault").alias("n_faults"))


@register(f"""WITH {_SCORED}, s AS (SELECT query_id, doc_id, rank, c AS condition, query_id // 100 % 7 AS q FROM pool, (VALUES ('none'), ('shifted'), ('absent')) t(c) WHERE rank <= 6),
x AS (SELECT query_id, condition, CASE WHEN condition = 'shifted' THEN rank - 1 ELSE rank END AS selected_rank, CASE WHEN q = 1 AND rank = 4 THEN -1 WHEN q = 2 AND rank = 4 THEN lag(doc_id) OVER (PARTITION BY query_id, condition ORDER BY rank) WHEN q = 3 AND condition = 'none' AND rank = 5 THEN lead(doc_id) OVER (PARTITION BY query_id, condition ORDER BY rank) ELSE doc_id END AS doc_id FROM s WHERE condition <> 'absent' OR q = 0),
y AS (SELECT * FROM x WHERE selected_rank BETWEEN 1 AND 5),
n AS (SELECT query_id, condition, count(*) AS n, count(DISTINCT doc_id) AS d, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM pool p WHERE p.query_id = y.query_id)) AS o, bool_and(selected_rank = (SELECT rank FROM pool p WHERE p.query_id = y.query_id AND p.doc_id = y.doc_id)) AS same FROM y GROUP BY ALL)
SELECT e.query_id, e.condition, CASE WHEN n IS NULL THEN 'MISSING' WHEN d <> 5 THEN 'REPEATED' WHEN o > 0 THEN 'OUTSIDE' WHEN e.condition = 'none' AND NOT same THEN 'NOT_NATIVE' END AS fault
FROM (SELECT DISTINCT query_id, c AS condition FROM pool, (VALUES ('none'), ('shifted'), ('absent')) t(c)) e LEFT JOIN n ON n.query_id = e.query_id AND n.condition = e.condition""")
def selection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections with faults of every kind put in: a foreign passage, one twice, another than the native one, and conditions that are missing."""
    pool = _pool(spark, sf_dir).select("query_id", "doc_id", "rank")
    q, by = F.expr("query_id DIV 100 % 7"), W.partitionBy("query_id", "condition").orderBy("rank")
    each = pool.filter("rank <= 6").withColumn("condition", F.explode(F.array(F.lit("none"), F.lit("shifted"), F.lit("absent")))).filter((F.col("condition") != "absent") | (q == 0))
    doc = F.when((q == 1) & (F.col("rank") == 4), -1).when((q == 2) & (F.col("rank") == 4), F.lag("doc_id").over(by)).when((q == 3) & (F.col("condition") == "none") & (F.col("rank") == 5), F.lead("doc_id").over(by)).otherwise(F.col("doc_id"))
    selected = each.select("query_id", "condition", F.when(F.col("condition") == "shifted", F.col("rank") - 1).otherwise(F.col("rank")).alias("selected_rank"), doc.alias("doc_id")).filter("selected_rank BETWEEN 1 AND 5")
    return runs.selection_faults(pool, selected, ["none", "shifted", "absent"], TOP)


@register(f"""WITH {_SCORED}, t AS (SELECT p.query_id, p.rank, e.embedding::DOUBLE[] AS v FROM pool p JOIN embeddings e ON e.vec_id = p.doc_id WHERE p.rank <= {TOP})
SELECT a.query_id, {TOP} AS n_items, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id""")
def retrieval_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.pairwise_diversity(_pool(spark, sf_dir).filter(F.col("rank") <= TOP), ["query_id"], "rank")
    return found.select("query_id", F.col("n_items").cast("int").alias("n_items"), F.round("diversity", 6).alias("diversity"))


@register(f"""WITH {_SCORED}, a AS (SELECT *, count(*) OVER (PARTITION BY query_id, label ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM pool WHERE rank <= {TOP})
SELECT query_id, {", ".join(f"round(sum(pow({1 - x}, seen) / log2(rank + 1)), 6) AS dcg_{int(10 * x)}" for x in (0.3, 0.5, 0.7))} FROM a GROUP BY query_id""")
def alpha_dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the passages are their aspects."""
    covered = _pool(spark, sf_dir).filter(F.col("rank") <= TOP).select("query_id", "rank", F.col("label").alias("aspect"))
    each = [metrics.alpha_dcg(covered, ["query_id"], x).withColumnRenamed("dcg", f"dcg_{int(10 * x)}") for x in (0.3, 0.5, 0.7)]
    out = each[0].join(each[1], "query_id").join(each[2], "query_id")
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register(f"""WITH {_SCORED}, a AS (SELECT *, count(*) OVER (PARTITION BY query_id, label ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM pool),
dcg AS (SELECT query_id, sum(pow(0.5, seen) / log2(rank + 1)) AS dcg FROM a WHERE rank <= {TOP} GROUP BY query_id),
best AS (SELECT query_id, pow(0.5, seen) AS gain, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS place FROM a), ideal AS (SELECT query_id, sum(gain / log2(place + 1)) AS idcg FROM best WHERE place <= {TOP} GROUP BY query_id)
SELECT query_id, round(dcg / idcg, 6) AS alpha_ndcg FROM ideal JOIN dcg USING (query_id)""")
def alpha_ndcg_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha_dcg against the greedy ideal over the pool; null where the ideal is 0."""
    pool = _pool(spark, sf_dir)
    dcg = metrics.alpha_dcg(pool.filter(F.col("rank") <= TOP).select("query_id", "rank", F.col("label").alias("aspect")), ["query_id"], 0.5)
    ideal = metrics.ideal_alpha_dcg(pool.select("query_id", "doc_id", F.array("label").alias("aspects")), 0.5)
    return ideal.join(dcg, "query_id", "left").select("query_id", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), 6).alias("alpha_ndcg"))


@register(f"""WITH {_SCORED} SELECT query_id, round(count(DISTINCT label) FILTER (rank <= {TOP}) / count(DISTINCT label), 6) AS s_recall, count(DISTINCT label) AS coverable, round(count(DISTINCT label) / (SELECT count(DISTINCT label) FROM embeddings), 6) AS coverability FROM pool GROUP BY query_id""")
def s_recall_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "embeddings").agg(F.countDistinct("label").alias("total"))
    per = _pool(spark, sf_dir).groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") <= TOP, F.col("label"))).alias("got"), F.countDistinct("label").alias("coverable"))
    return per.crossJoin(F.broadcast(total)).select("query_id", F.round(F.try_divide("got", "coverable"), 6).alias("s_recall"), "coverable", F.round(F.try_divide("coverable", "total"), 6).alias("coverability"))


@register(f"WITH {_SCORED} SELECT query_id, CAST(count(DISTINCT label) AS INTEGER) AS n_aspects, CAST(count(DISTINCT label) AS INTEGER) AS cover FROM pool GROUP BY query_id")
def min_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one label a passage, the fewest passages that cover all are as many as the labels."""
    return metrics.min_set_cover(_pool(spark, sf_dir).select("query_id", F.array("label").alias("aspects")))


_ASPECTS = f"""{_SCORED}, a AS (SELECT DISTINCT query_id, doc_id, unnest([label % 5, 100 + doc_id % 4, CASE WHEN doc_id % 2 = 0 THEN 200 + doc_id % 3 ELSE 300 END]) AS aspect FROM pool)"""


def _aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's passages with three aspects each, of twelve that there may be."""
    n = F.col("doc_id")
    return _pool(spark, sf_dir).select("query_id", "rank", "doc_id", F.array_distinct(F.array((F.col("label") % 5).cast("long"), 100 + n % 4, F.when(n % 2 == 0, 200 + n % 3).otherwise(300))).alias("aspects"))


@register(f"""WITH RECURSIVE {_ASPECTS}, named AS (SELECT query_id, aspect, 1::BIGINT << (row_number() OVER (PARTITION BY query_id ORDER BY aspect) - 1) AS bit FROM (SELECT DISTINCT query_id, aspect FROM a)),
m AS (SELECT DISTINCT query_id, mask FROM (SELECT a.query_id, doc_id, CAST(sum(bit) AS BIGINT) AS mask FROM a JOIN named n ON n.query_id = a.query_id AND n.aspect = a.aspect GROUP BY ALL)),
whole AS (SELECT query_id, CAST(sum(bit) AS BIGINT) AS whole, CAST(count(*) AS INTEGER) AS n_aspects FROM named GROUP BY query_id),
r AS (SELECT query_id, 0 AS n, 0::BIGINT AS mask FROM whole UNION SELECT r.query_id, n + 1, r.mask | m.mask FROM r JOIN m ON m.query_id = r.query_id JOIN whole w ON w.query_id = r.query_id WHERE r.mask <> w.whole AND n < 12)
SELECT r.query_id, any_value(n_aspects) AS n_aspects, CAST(min(n) AS INTEGER) AS cover FROM r JOIN whole w ON w.query_id = r.query_id AND r.mask = w.whole GROUP BY r.query_id""")
def min_set_cover_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest passages that cover all aspects, where a passage has several, against all that so many of them reach."""
    return metrics.min_set_cover(_aspects(spark, sf_dir).select("query_id", "aspects"))


def _greedy_sql(steps: int) -> str:
    """SQL of the greedy ideal, one choice after another: chosen0 (none), gain1, chosen1, ..."""
    parts = ["chosen0 AS (SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS doc_id, 0.0::DOUBLE AS gain, 0 AS place WHERE false)"]
    for k in range(1, steps + 1):
        parts.append(f"seen{k} AS (SELECT a.query_id, a.aspect, count(*) AS n FROM a JOIN chosen{k - 1} c ON c.query_id = a.query_id AND c.doc_id = a.doc_id GROUP BY ALL)")
        parts.append(f"gain{k} AS (SELECT a.query_id, a.doc_id, sum(pow(0.5, coalesce(s.n, 0))) AS gain FROM a LEFT JOIN seen{k} s ON s.query_id = a.query_id AND s.aspect = a.aspect WHERE NOT EXISTS (SELECT 1 FROM chosen{k - 1} c WHERE c.query_id = a.query_id AND c.doc_id = a.doc_id) GROUP BY ALL)")
        parts.append(f"chosen{k} AS (SELECT * FROM chosen{k - 1} UNION ALL SELECT query_id, doc_id, gain, {k} FROM gain{k} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) = 1)")
    return ", ".join(parts)


@register(f"""WITH {_ASPECTS}, {_greedy_sql(TOP)},
ideal AS (SELECT query_id, sum(gain / log2(place + 1)) AS idcg FROM chosen{TOP} GROUP BY query_id),
ranked5 AS (SELECT a.query_id, a.aspect, p.rank, count(*) OVER (PARTITION BY a.query_id, a.aspect ORDER BY p.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a JOIN pool p ON p.query_id = a.query_id AND p.doc_id = a.doc_id WHERE p.rank <= {TOP}),
dcg AS (SELECT query_id, sum(pow(0.5, seen) / log2(rank + 1)) AS dcg FROM ranked5 GROUP BY query_id)
SELECT i.query_id, round(idcg, 6) AS idcg, round(dcg / idcg, 6) AS alpha_ndcg FROM ideal i JOIN dcg ON dcg.query_id = i.query_id""")
def alpha_ndcg_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha-nDCG where a passage has several aspects, so that the ideal's order matters."""
    passages = _aspects(spark, sf_dir)
    covered = passages.filter(F.col("rank") <= TOP).select("query_id", "rank", F.explode("aspects").alias("aspect"))
    dcg = metrics.alpha_dcg(covered, ["query_id"], 0.5)
    ideal = metrics.ideal_alpha_dcg(passages.select("query_id", "doc_id", "aspects"), 0.5, TOP)
    return ideal.join(dcg, "query_id").select("query_id", F.round("idcg", 6).alias("idcg"), F.round(F.col("dcg") / F.col("idcg"), 6).alias("alpha_ndcg"))


@register(f"""WITH {_SCORED}, l AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM pool GROUP BY query_id),
n AS (SELECT query_id, ids, lead(ids) OVER (ORDER BY query_id) AS other FROM l)
SELECT query_id, len(list_intersect(ids, other)) AS n_shared, round(len(list_intersect(ids, other)) / len(list_distinct(ids || other)), 6) AS jaccard, ids = other AS same_order FROM n WHERE other IS NOT NULL""")
def jaccard_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's list against the next query's."""
    lists = dense_top20(spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("ids"))
    at = V.numbered(lists, "query_id", "at")
    pairs = at.join(at.select((F.col("at") - 1).alias("at"), F.col("ids").alias("other")), "at")
    return pairs.select("query_id", F.size(F.array_intersect("ids", "other")).cast("long").alias("n_shared"), F.round(metrics.jaccard(F.col("ids"), F.col("other")), 6).alias("jaccard"), (F.col("ids") == F.col("other")).alias("same_order"))


@register(f"""WITH {_SCORED}, b AS ({_BM25}),
l AS (SELECT 'dense' AS retriever, query_id, list(doc_id ORDER BY rank) AS ids FROM pool GROUP BY query_id UNION ALL SELECT 'bm25', query_id, list(doc_id ORDER BY rank) FROM b GROUP BY query_id),
n AS (SELECT *, lead(ids) OVER (PARTITION BY retriever ORDER BY query_id) AS other FROM l),
p AS (SELECT retriever, len(list_intersect(ids, other)) AS shared, len(list_intersect(ids, other)) / len(list_distinct(ids || other)) AS jaccard, CASE WHEN ids = other THEN 1.0 ELSE 0.0 END AS same FROM n WHERE other IS NOT NULL)
SELECT CASE WHEN grouping(retriever) = 1 THEN 'pooled' ELSE retriever END AS retriever, count(*) AS n, round(avg(jaccard), 6) AS jaccard, round(avg(shared), 6) AS shared, round(avg(same), 6) AS identical FROM p GROUP BY ROLLUP (retriever)""")
def overlap_by_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's list against the next one's, by retriever and pooled."""
    found = dense_top20(spark, sf_dir).withColumn("retriever", F.lit("dense")).unionByName(bm25_top20(spark, sf_dir).withColumn("retriever", F.lit("bm25")))
    lists = found.groupBy("retriever", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("ids"))
    at = V.numbered(lists, ["retriever", "query_id"], "at")
    pairs = at.join(at.select((F.col("at") - 1).alias("at"), "retriever", F.col("ids").alias("other")), ["at", "retriever"])
    return metrics.overlap_summary(pairs, "retriever").withColumns({c: F.round(c, 6) for c in ("jaccard", "shared", "identical")})


@register("SELECT doc_id, digest FROM (SELECT doc_id, sha256('sample|' || doc_id) AS digest FROM documents) ORDER BY digest, doc_id LIMIT 100")
def hash_ranked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_ranked_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "sample", 100).select("doc_id", "digest")


@register("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split|' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents), p AS (SELECT doc_id, CASE WHEN place <= n * 4 // 5 THEN 'train' ELSE 'selection' END AS part FROM h) SELECT part, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, CAST(sum(doc_id * 31 % 1000003) AS BIGINT) AS mark FROM p GROUP BY part")
def hash_partition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four fifths by hash, exactly, and the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = V.first_by_hash(docs, "doc_id", "split", docs.count() * 4 // 5).withColumn("part", F.when(F.col("first"), "train").otherwise("selection"))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.col("doc_id") * 31 % 1000003).alias("mark"))


@register(f"""WITH {_SCORED} SELECT query_id, count(*) AS n, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS contiguous, count(DISTINCT doc_id) = count(*) AS distinct_ids FROM pool GROUP BY query_id""")
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismrank.operators.checks import contiguity

    pool = dense_top20(spark, sf_dir)
    ids = pool.groupBy("query_id").agg((F.countDistinct("doc_id") == F.count("*")).alias("distinct_ids"))
    return contiguity(pool, ["query_id"], "rank", 1).join(ids, "query_id")


@register("SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-5) AS n_unit, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS mean_norm FROM embeddings")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norm(F.col("v"))
    return _vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.abs(n - 1) < 1e-5).alias("n_unit"), F.round(F.avg(n), 5).alias("mean_norm"))
