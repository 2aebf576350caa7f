"""Queries from candidates to contexts, claims and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.functions import matching
from prismrank.functions import text as X
from prismrank.operators import workflow as V
from prismrank.plans.ranking import ORACLES as ORACLES_OF_RANKING
from prismrank.plans.ranking import QUERIES as RANKING
from prismrank.plans.ranking import TOP, bm25_top20
from prismrank.plans.registry import Query, registrar
from prismrank.plans.wording import _REFUSAL, _sentence_list
from prismrank.sources.files import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)


@register("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS corpus_position FROM documents")
def corpus_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_BM25 = ORACLES_OF_RANKING["bm25_top20"]


@register(f"""WITH p AS ({_BM25}) SELECT query_id, 'bm25' AS retriever, count(*) AS n, sha256(string_agg(rank || ':' || doc_id || ':' || CAST(round(score * 1000000) AS BIGINT) || ':' || sha256(text), ',' ORDER BY rank)) AS artifact_sha256 FROM p JOIN documents USING (doc_id) GROUP BY query_id""")
def candidate_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates of every benchmark item as arrays with content hashes, and a digest of each array."""
    corpus = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    entry = lambda c: F.concat_ws(":", c["rank"], c["doc_id"], F.round(c["score"] * 1_000_000).cast("long"), c["content_sha256"])
    return V.candidate_artifacts(bm25_top20(spark, sf_dir), "bm25", corpus).select("query_id", "retriever", "n", F.sha2(F.array_join(F.transform("candidates", entry), ","), 256).alias("artifact_sha256"))


@register(f"""WITH p AS ({_BM25}), n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS corpus_position FROM documents) SELECT query_id, rank, corpus_position, sha256(text) AS content_sha256 FROM p JOIN n USING (doc_id)""")
def checked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates looked up again by their position in the corpus, with id and content compared."""
    corpus = V.numbered(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    hashed = corpus.select("doc_id", "corpus_position", F.sha2("content", 256).alias("content_sha256"))
    found = V.checked_candidates(bm25_top20(spark, sf_dir).join(hashed, "doc_id"), corpus)
    return found.select("query_id", "rank", "corpus_position", F.sha2("content", 256).alias("content_sha256"))


@register(f"""WITH p AS ({_BM25}), t AS (SELECT query_id, string_agg('[Document ' || rank || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM p JOIN documents USING (doc_id) WHERE rank <= {TOP} GROUP BY query_id)
SELECT query_id, 'none' AS condition, CAST(n AS INTEGER) AS n_passages, CAST(length(context) AS INTEGER) AS context_chars, sha256(context) AS context_sha256 FROM t WHERE n = {TOP}""")
def selected_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most relevant documents of each benchmark item as one context."""
    corpus = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    top = bm25_top20(spark, sf_dir).filter(F.col("rank") <= TOP).select("query_id", F.lit("none").alias("condition"), F.col("rank").alias("selected_rank"), "doc_id")
    return V.selected_contexts(top, corpus, TOP).select("query_id", "condition", F.size("passages").alias("n_passages"), F.length("context").alias("context_chars"), F.sha2("context", 256).alias("context_sha256"))


@register(f"""WITH a AS (SELECT query_id, list(doc_id ORDER BY selected_rank) AS ids FROM ({ORACLES_OF_RANKING["select_none"]}) GROUP BY query_id), b AS (SELECT query_id, list(doc_id ORDER BY selected_rank) AS ids FROM ({ORACLES_OF_RANKING["select_mmr_0_75"]}) GROUP BY query_id)
SELECT query_id, a.ids = b.ids AS same FROM a JOIN b USING (query_id)""")
def passage_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the passages selected with a little diversity are those of plain relevance, in the same order."""
    ids = lambda name: RANKING[name](spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("selected_rank", "doc_id"))), lambda r: r["doc_id"]).alias("ids"))
    return V.passages_agree(ids("select_none"), ids("select_mmr_0_75"), ["query_id"], "ids")


@register(f"""WITH s AS (SELECT conv_id, turn, {_sentence_list("text")} AS s FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND NOT regexp_matches(text, '{_REFUSAL}'))
SELECT conv_id, turn, count(*) AS n_claims, sum(length(c))::BIGINT AS claim_chars FROM (SELECT conv_id, turn, unnest(s) AS c FROM s) GROUP BY ALL""")
def claim_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the assistants' turns, refusals aside."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    status = F.when(X.is_refusal(F.col("text")), "REFUSAL").when(F.trim("text") == "", "PARSE_FAILURE").otherwise("OK")
    claims = V.claim_workload(turns.withColumn("status", status), "text")
    return claims.groupBy("conv_id", "turn").agg(F.count("*").alias("n_claims"), F.sum(F.length("claim_text")).alias("claim_chars"))


@register(r"""WITH p AS (SELECT conv_id, role, count(DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g')) = 1 AS same FROM conversations GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (same) AS n_same, count(*) FILTER (same) >= 19 AS passed FROM p""")
def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a role in a conversation stand for the calls of one prompt, as many as there are."""
    calls = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "role").alias("prompt"), "text")
    return V.repeatability(calls, "prompt", "text", None)


@register("""WITH c AS (SELECT doc_id, i, CASE WHEN doc_id % 19 = 4 AND i = 2 THEN NULL WHEN doc_id % 7 = 3 AND i = 3 THEN lang || '!' WHEN i = 2 THEN chr(10) || lang || ' ' ELSE lang END AS t FROM documents, range(1, 4) r(i) WHERE doc_id % 23 <> 5 OR i < 3),
p AS (SELECT doc_id % 5 AS model, doc_id, count(*) = 3 AND count(t) = 3 AND count(DISTINCT trim(t, ' ' || chr(10))) = 1 AS same FROM c GROUP BY doc_id)
SELECT model, count(*) AS n, count(*) FILTER (same) AS n_same, count(*) FILTER (same) >= 19 AS passed FROM p GROUP BY model""")
def repeatability_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls of each prompt by each of five models; some differ, some gave nothing, some weren't made."""
    i, n = F.col("i"), F.col("doc_id")
    calls = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")).filter((n % 23 != 5) | (i < 3))
    text = F.when((n % 19 == 4) & (i == 2), None).when((n % 7 == 3) & (i == 3), F.concat("lang", F.lit("!"))).when(i == 2, F.concat(F.lit("\n"), "lang", F.lit(" "))).otherwise(F.col("lang"))
    calls = calls.withColumn("text", text)
    each = [V.repeatability(calls.filter(n % 5 == m), "doc_id", "text").withColumn("model", F.lit(m).cast("long")) for m in range(5)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


_TEMPLATE = "Question: {question}\n\nDocuments:\n{context}\n\nAnswer:"


@register("""WITH q AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position, text FROM benchmark), s AS (SELECT *, position % 2 = 0 AS with_context, CASE WHEN position % 3 = 0 THEN 'mmr_0.5' WHEN position % 3 = 1 THEN 'none' ELSE 'other one' END AS condition FROM q WHERE item_id % 3 <> 1)
SELECT item_id, position, CASE WHEN position < 5 THEN 'warm_up' ELSE 'measured' END AS role, CASE condition WHEN 'mmr_0.5' THEN 'MMR 0.5' WHEN 'none' THEN 'Relevance' ELSE condition END AS label,
  'run-bench-' || CASE condition WHEN 'mmr_0.5' THEN 'mmr-0-5' WHEN 'none' THEN 'none' ELSE 'other-one' END || '-na-' || left(sha256(condition || '|' || item_id), 24) AS run_id,
  sha256('Question: ' || text || chr(10) || chr(10) || 'Documents:' || chr(10) || CASE WHEN with_context THEN '{question} ' || text ELSE '' END || chr(10) || chr(10) || 'Answer:') AS prompt_sha256 FROM s""")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a run that were asked for by id: role, display name of the condition, run id and prompt; contexts that hold a placeholder stay as they are."""
    items = V.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")), "item_id", "position")
    asked = V.manifest_subset(items, "item_id", items.filter("item_id % 3 <> 1").select("item_id"))
    at = F.col("position")
    rows = asked.withColumns({"condition": F.when(at % 3 == 0, "mmr_0.5").when(at % 3 == 1, "none").otherwise("other one"), "context": F.concat(F.lit("{question} "), "question")})
    prompt = F.when(at % 2 == 0, V.prompts(rows, _TEMPLATE, True)).otherwise(V.prompts(rows, _TEMPLATE, False))
    name = X.run_id([F.lit("Bench"), F.col("condition"), F.lit("--")], F.concat_ws("|", "condition", F.col("item_id").cast("string")))
    return rows.select("item_id", "position", V.role(at, 5).alias("role"), V.labelled(F.col("condition")).alias("label"), name.alias("run_id"), F.sha2(prompt, 256).alias("prompt_sha256"))


@register(f"""WITH c AS (SELECT conv_id, turn, 'Decision: yes' || chr(10) || 'Explanation: ' || text || ' Explanation: again.' AS t FROM conversations WHERE turn % 2 = 1), s AS (SELECT conv_id, turn, {_sentence_list("substr(t, strpos(t, 'Explanation:') + 12)")} AS s FROM c)
SELECT conv_id, turn, len(s) AS n_claims, sum(length(x)) AS claim_chars FROM (SELECT conv_id, turn, s, unnest(s) AS x FROM s) GROUP BY ALL""")
def explained_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from what answers explain, which begins at the first marker."""
    turns = table(spark, sf_dir, "conversations").filter("turn % 2 = 1")
    answers = turns.select("conv_id", "turn", F.lit("OK").alias("status"), F.concat(F.lit("Decision: yes\nExplanation: "), "text", F.lit(" Explanation: again.")).alias("text"))
    claims = V.explained_claims(answers, "text")
    return claims.groupBy("conv_id", "turn").agg(F.count("*").alias("n_claims"), F.sum(F.length("claim_text")).alias("claim_chars"))


def _token_list(x: str) -> str:
    """SQL of a text's words after composing characters: marks and white space separate, apostrophes between letters or digits stay."""
    apostrophes = f"regexp_replace(nfc_normalize({x}), '[‘’ʼ＇]', chr(39), 'g')"
    for _ in range(2):  # a letter between two apostrophes belongs to both
        apostrophes = rf"regexp_replace({apostrophes}, '([\pL\pN])\x27([\pL\pN])', '\1' || chr(1) || '\2', 'g')"
    spaced = rf"regexp_replace({apostrophes}, '[\pP\pS\pZ\s\v\x1c-\x1f\x{{85}}]+', ' ', 'g')"
    return f"list_filter(string_split(replace({spaced}, chr(1), chr(39)), ' '), lambda w: w <> '')"


def _contains(words: str, alias: str) -> str:
    return f"(len({alias}) > 0 AND contains(' ' || array_to_string({words}, ' ') || ' ', ' ' || array_to_string({alias}, ' ') || ' '))"


@register(f"""WITH p AS ({_BM25}), al AS (SELECT item_id AS query_id, unnest([0, 1]) AS aspect, unnest([split_part(text, ' ', 1), array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')]) AS alias FROM benchmark),
a AS (SELECT query_id, aspect, {_token_list("alias")} AS a FROM al), d AS (SELECT doc_id, {_token_list("text")} AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM p)),
s AS (SELECT query_id, aspect, bool_or(CASE WHEN len(a) = 1 THEN {_contains("d.p", "a")} ELSE {_contains("list_transform(d.p, lambda w: lower(w))", "list_transform(a, lambda w: lower(w))")} END) AS present FROM p JOIN a USING (query_id) JOIN d USING (doc_id) GROUP BY ALL)
SELECT query_id, round(avg(CAST(present AS DOUBLE)), 6) AS str_em, CAST(bool_and(present) AS DOUBLE) AS str_hit FROM s GROUP BY query_id""")
def aspect_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects of each benchmark item, its first word and its first three words as aliases, found in the item's candidates."""
    aliases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.array(F.substring_index("text", " ", 1), F.substring_index("text", " ", 3))).alias("aspect", "alias"))
    words = aliases.select("query_id", "aspect", matching.tokens_udf("alias").alias("a"), matching.folded_udf("alias").alias("af"))
    found = bm25_top20(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", matching.tokens_udf("text").alias("p"), matching.folded_udf("text").alias("pf"))
    both = found.join(words, "query_id").join(docs, "doc_id")
    seen = both.withColumn("present", matching.alias_matches(F.col("p"), F.col("pf"), F.col("a"), F.col("af")))
    return V.alias_scores(seen, ["query_id"]).withColumn("str_em", F.round("str_em", 6))


@register("""WITH g AS (SELECT doc_id, lang, source, quality, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
SELECT lang, bool_and(quality IS NOT NULL) AS all_grounded, count(DISTINCT CASE WHEN quality IS NOT NULL THEN doc_id END) = count(*) AS distinct_grounded FROM g GROUP BY lang""")
def grounding_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all documents of a language are labelled, a label standing for the passage that grounds an aspect."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").select("lang", F.col("doc_id").alias("aspect"), F.when(F.col("quality").isNotNull(), F.col("doc_id")).alias("doc_id"))
    return V.grounding(rows, ["lang"])


@register("""SELECT o_orderpriority AS priority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS place, count(*) AS n, round(avg(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice > 150000 AS DOUBLE) WHEN 'P' THEN 0.0 END), 6) AS score FROM orders GROUP BY ALL""")
def scored_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for answers: fulfilled ones are scored, partly fulfilled ones score 0 as refusals do, open ones have no score."""
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "P", "REFUSAL").otherwise("ERROR")
    score = V.row_score((F.col("o_totalprice") > 150000).cast("double"), status)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), V.in_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).cast("int").alias("place")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score"))
