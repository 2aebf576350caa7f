"""Queries on answers, claims and texts, over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.functions import text as X
from prismrank.operators import metrics
from prismrank.operators import workflow as V
from prismrank.plans.registry import Query, registrar
from prismrank.sources.files import spread, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
register = registrar(QUERIES, ORACLES)

_PUNCT = X.PUNCTUATION.replace("'", "''")
_PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS prediction FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the gold text of the next."""
    turns = spread(table(spark, sf_dir, "conversations"))
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return turns.select("conv_id", "turn", F.col("text").alias("gold")).join(nexts, ["conv_id", "turn"])


def _worded(spark: SparkSession, sf_dir: str, normalize=X.normalize_answer) -> DataFrame:
    words = {"p": X.answer_words(F.col("prediction"), normalize), "g": X.answer_words(F.col("gold"), normalize)}
    return _pairs(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in words.items()])


def _no_articles(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_]+'), lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), '')"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({_no_articles(f'lower({x})')}, '{_PUNCT}', ''), '\\s+', ' ', 'g'))"


def _normal_official(x: str) -> str:
    lowered = f"translate(lower({x}), '{_PUNCT}', '')"
    return f"trim(regexp_replace({_no_articles(lowered)}, '\\s+', ' ', 'g'))"


_WHITE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_REFUSAL = r"(?is)^\s*(?:i\s+(?:cannot|can''t|am\s+unable\s+to|won''t)\s+(?:answer|provide\s+an\s+answer|help)|i\s+(?:must|have\s+to)\s+(?:decline|refuse)|sorry,?\s+i\s+(?:cannot|can''t|am\s+unable\s+to)\s+(?:answer|help)).*?\s*$"


def _sentence_list(x: str) -> str:
    """SQL of a text's sentences: pieces after . ! or ?, joined again after abbreviations and initials."""
    pieces = f"list_filter(string_split(regexp_replace(trim(regexp_replace({x}, '{_WHITE}', ' ', 'g')), '([.!?]) ', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')"
    last = "lower(trim(regexp_extract(s, '[^ ]*$'), '*_`\"“”''‘’()[]{}'))"
    short = "'e.g.', 'i.e.', 'dr.', 'mr.', 'mrs.', 'ms.', 'prof.', 'sr.', 'jr.', 'vs.', 'etc.', 'fig.', 'eq.', 'no.', 'nos.', 'st.', 'mt.'"
    joined = f"array_to_string(list_transform({pieces}, lambda s: s || CASE WHEN {last} IN ({short}) OR regexp_full_match({last}, '(?:[a-z]\\.)+') THEN ' ' ELSE chr(30) END), '')"
    return f"list_filter(list_transform(string_split({joined}, chr(30)), lambda s: trim(s)), lambda s: s <> '')"


@register(f"SELECT doc_id, md5({_normal('text')}) AS code_md5, md5({_normal_official('text')}) AS official_md5 FROM documents")
def normalize_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("code_md5"), F.md5(X.normalize_answer_official(F.col("text"))).alias("official_md5"))


@register(f"WITH {_PAIRS} SELECT conv_id, turn, CAST({_normal('prediction')} = {_normal('gold')} AS DOUBLE) AS em FROM pairs")
def exact_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", X.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


@register(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_filter(string_split({_normal('prediction')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({_normal('gold')}, ' '), lambda x: x <> '') AS g FROM pairs),
pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM w) GROUP BY ALL),
gc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM w) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS common FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT w.conv_id, w.turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE 2.0 * coalesce(common, 0) / (len(p) + len(g)) END, 6) AS f1 FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn""")
def token_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("conv_id", "turn", F.round(X.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@register()
def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("conv_id", "turn", F.round(X.rouge_l("p", "g"), 6).alias("rouge_l"))


@register(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_filter(string_split({_normal_official('prediction')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({_normal_official('gold')}, ' '), lambda x: x <> '') AS g FROM pairs),
pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM w) GROUP BY ALL),
gc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM w) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS common FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT w.conv_id, w.turn, round(CASE WHEN p <> g AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) THEN 0.0 WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE 2.0 * coalesce(common, 0) / (len(p) + len(g)) END, 6) AS f1 FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn""")
def official_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir, X.normalize_answer_official).select("conv_id", "turn", F.round(X.official_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@register(f"""WITH {_PAIRS} SELECT count(*) AS n, round(avg(CAST({_normal('prediction')} = {_normal('gold')} AS DOUBLE)), 6) AS avg_em FROM pairs""")
def batch_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_match_pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("avg_em"))


@register(f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(length(s[1]), 0) AS INTEGER) AS first_chars FROM (SELECT doc_id, {_sentence_list('text')} AS s FROM documents)""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_sentences"), F.length(F.coalesce(found[0], F.lit(""))).alias("first_chars"))


@register(f"SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '{_REFUSAL}')) AS n_refusal, count(*) FILTER (trim(text) = '') AS n_empty FROM conversations GROUP BY role")
def refusals_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.count_if(X.is_refusal(F.col("text"))).alias("n_refusal"), F.count_if(F.trim("text") == "").alias("n_empty"))


@register(f"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'ERROR' WHEN length(text) >= 4000 THEN 'TRUNCATED' WHEN regexp_matches(text, '{_REFUSAL}') THEN 'REFUSAL' WHEN trim(text) = '' THEN 'PARSE_FAILURE' ELSE 'OK' END AS status FROM conversations""")
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    status = X.classify_response(F.when(text.isNull(), "missing"), F.when(F.length(text) >= 4000, "length").otherwise("stop"), text, F.nullif(F.trim(text), F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", status.alias("status"))


@register(r"""SELECT item_id, CASE WHEN len(m) = 1 THEN nullif(trim(m[1]), '') END AS answer FROM (SELECT item_id, regexp_extract_all('Answer: ' || replace(text, chr(10), ' '), '(?m)^Answer:[ \t]*(.*?)[ \t]*$', 1) AS m FROM benchmark)""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Answer: "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf_dir, "benchmark").select("item_id", X.parse_line(line, "Answer").alias("answer"))


_LINES = {0: "Decision: Yes", 1: "so\r\nDecision:  MAYBE \t\r\nyes", 2: "Decision: no\nDecision: no", 3: "Decision: perhaps", 4: "decision: no", 5: "Decision:\tno"}


@register("""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Decision: Yes' WHEN 1 THEN 'so' || chr(13) || chr(10) || 'Decision:  MAYBE ' || chr(9) || chr(13) || chr(10) || 'yes' WHEN 2 THEN 'Decision: no' || chr(10) || 'Decision: no' WHEN 3 THEN 'Decision: perhaps' WHEN 4 THEN 'decision: no' ELSE 'Decision:' || chr(9) || 'no' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || lang ELSE '' END AS t FROM documents),
l AS (SELECT doc_id, list_filter(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: starts_with(x, 'Decision:')) AS l FROM t),
v AS (SELECT doc_id, CASE WHEN len(l) = 1 THEN lower(trim(substr(l[1], 10), ' ' || chr(9))) END AS v FROM l),
s AS (SELECT v.doc_id, CASE WHEN v IN ('yes', 'no', 'maybe') THEN v END AS decision FROM v)
SELECT doc_id, decision, CASE WHEN doc_id % 13 = 1 THEN 'ERROR' WHEN doc_id % 13 = 2 THEN 'TRUNCATED' WHEN doc_id % 13 = 3 THEN 'REFUSAL' WHEN decision IS NULL THEN 'PARSE_FAILURE' ELSE 'OK' END AS status FROM s""")
def parsed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one decision in any case, none, two and others, with the status of the whole response, some of which the provider refused or cut."""
    n = F.col("doc_id")
    text = F.coalesce(*[F.when(n % 6 == k, v) for k, v in _LINES.items()])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.when(n % 5 == 0, F.concat(F.lit("\n"), "lang")).otherwise("")).alias("text"))
    parsed = docs.withColumn("decision", X.parse_line(F.col("text"), "Decision", ["yes", "no", "maybe"]))
    lost = n % 13 == 1
    status = X.classify_response(F.when(lost, "lost"), F.when(n % 13 == 2, "Max_Tokens ").otherwise("stop"), F.when(~lost, F.col("text")), F.col("decision"), n % 13 == 3)
    return parsed.select("doc_id", "decision", status.alias("status"))


@register("""SELECT doc_id, trim(source || ' ' || coalesce(lang, '')) AS content, sha256(text) AS text_sha256, lower(regexp_replace(regexp_replace(lower(source || '_' || lang), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents""")
def retrieval_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = X.slug(F.concat_ws("_", "source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", X.retrieval_content(F.col("source"), F.col("lang")).alias("content"), F.sha2("text", 256).alias("text_sha256"), slug.alias("slug"))


@register("""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM documents),
r AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM s), n AS (SELECT doc_id, i, row_number() OVER (ORDER BY doc_id, i) - 1 AS position FROM r)
SELECT s.doc_id AS sample, coalesce(list(position ORDER BY i) FILTER (position IS NOT NULL), [])::VARCHAR AS gold_ids FROM s LEFT JOIN n ON n.doc_id = s.doc_id GROUP BY s.doc_id""")
def gold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines that aren't blank as the gold documents of a sample, by their numbers in the corpus of all."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(V.first_column(docs, "body", "text"), "\n"), lambda x: X.strip(x) != "")
    samples = docs.select("doc_id", lines.alias("sections"), F.transform(lines, lambda x: F.length(x)).alias("labels"))
    _, groups = V.gold_groups(samples, "doc_id", "sections", "labels")
    return groups.select("sample", F.concat(F.lit("["), F.array_join(F.transform("gold_ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("gold_ids"))


@register("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS section, md5(trim(lines[i])) AS section_md5 FROM s, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) WHERE trim(lines[i]) <> ''""")
def section_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a text that isn't blank as a section of its own."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.trim("line") != "").select("doc_id", (F.col("at") + 1).alias("section"), F.md5(F.trim("line")).alias("section_md5"))


@register("""WITH l AS (SELECT conv_id, turn // 64 AS part, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY ALL)
SELECT conv_id, part, len(t) AS n, md5(array_to_string(list_transform(range(1, len(t) + 1), lambda i: '[Document ' || i || ']' || chr(10) || t[i]), chr(10) || chr(10))) AS block_md5 FROM l""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as numbered contexts, one for every 64 turns, so that a conversation of any length is no single group."""
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / 64).cast("long"))
    parts = turns.groupBy("conv_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("t"))
    return parts.select("conv_id", "part", F.size("t").cast("long").alias("n"), F.md5(X.context_block(F.col("t"))).alias("block_md5"))


_NLI = "nli AS (SELECT doc_id // 10 AS answer, doc_id % 10 AS claim, CAST(i AS INTEGER) AS passage, CAST((doc_id * 7 + n_chars * 3 + i * 5) % 3 AS INTEGER) AS label FROM documents, range(5) t(i))"


def _nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entailment labels are an input; here they come from the documents' numbers: ten claims an answer, five passages a claim."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("passage"))
    return docs.select(F.floor(F.col("doc_id") / 10).cast("long").alias("answer"), (F.col("doc_id") % 10).alias("claim"), "passage", ((F.col("doc_id") * 7 + F.col("n_chars") * 3 + F.col("passage") * 5) % 3).cast("int").alias("label"))


@register(f"WITH {_NLI} SELECT answer, claim, bool_or(label = 0) AS supported, count(DISTINCT passage) FILTER (label = 0) AS n_sources FROM nli GROUP BY ALL")
def claim_support_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.claim_support(_nli(spark, sf_dir))


@register(f"""WITH {_NLI}, c AS (SELECT answer, claim, bool_or(label = 0) AS s FROM nli GROUP BY ALL), a AS (SELECT answer, count(*) AS n_claims, count(*) FILTER (s) AS n_supported, avg(CAST(s AS DOUBLE)) AS f, bool_or(NOT s) AS h FROM c GROUP BY answer)
SELECT round(sum(n_supported) / sum(n_claims), 6) AS micro, round(avg(f), 6) AS macro, round(avg(CAST(h AS DOUBLE)), 6) AS hallucination_rate, count(*) AS n_answers FROM a""")
def faithfulness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.faithfulness(metrics.claim_support(_nli(spark, sf_dir)))
    return per.agg(F.round(F.sum("n_supported") / F.sum("n_claims"), 6).alias("micro"), F.round(F.avg("faithfulness"), 6).alias("macro"), F.round(F.avg(F.col("hallucinated").cast("double")), 6).alias("hallucination_rate"), F.count("*").alias("n_answers"))


@register(f"""WITH {_NLI}, c AS (SELECT answer, claim, count(*) FILTER (label = 0) / 5.0 AS yes, count(*) FILTER (label = 2) / 5.0 AS no, bool_and(label = 1) AS failed FROM nli GROUP BY ALL)
SELECT CASE WHEN failed THEN 'FAILED' WHEN yes >= 0.4 AND no >= 0.4 THEN 'INCONSISTENT' WHEN yes >= 0.4 THEN 'SUPPORTED' WHEN no >= 0.4 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS status, count(*) AS n FROM c GROUP BY 1""")
def claim_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _nli(spark, sf_dir).groupBy("answer", "claim").agg((F.count_if(F.col("label") == 0) / 5.0).alias("yes"), (F.count_if(F.col("label") == 2) / 5.0).alias("no"), F.bool_and(F.col("label") == 1).alias("failed"))
    return claims.groupBy(metrics.claim_status(F.col("yes"), F.col("no"), F.col("failed"), 0.4).alias("status")).agg(F.count("*").alias("n"))


@register(r"""WITH b AS (SELECT item_id, list_slice(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), 1, 3) AS alias FROM benchmark), al AS (SELECT DISTINCT ON (array_to_string(alias, ' ')) item_id, array_to_string(alias, ' ') AS alias FROM b WHERE len(alias) = 3 ORDER BY array_to_string(alias, ' '), item_id),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS alias FROM w)
SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM g JOIN al USING (alias) GROUP BY item_id""")
def alias_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which an alias, the first three words of a benchmark item, stands word by word: an equi-join on word windows instead of a search for each alias."""
    alias = table(spark, sf_dir, "benchmark").select("item_id", F.slice(X.tokens(F.col("text")), 1, 3).alias("w")).filter(F.size("w") == 3).groupBy(F.array_join("w", " ").alias("alias")).agg(F.min("item_id").alias("item_id"))
    words = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    windows = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("alias"))
    return windows.join(alias, "alias").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@register(r"""SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+') OR regexp_matches(text, '(?i)(api[_-]?key\s*[:=]\s*)[^\s,;]+') OR regexp_matches(text, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+')) AS n_redacted FROM documents""")
def key_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which anything is masked, looked through whole."""
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("n"), F.count_if(X.redact_keys(F.col("text"), None) != F.col("text")).alias("n_redacted"))
