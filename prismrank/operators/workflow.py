"""From candidates to contexts, claims and scored answers, as joins of keyed rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.functions import text as X
from prismrank.operators import checks
from prismrank.sources.files import kept

DISPLAY = {"none": "Relevance", "mmr_0": "MMR 0", "mmr_0.25": "MMR 0.25", "mmr_0.5": "MMR 0.5", "mmr_0.75": "MMR 0.75", "kmeans_k2": "k-means 2", "agglo_k3": "Agglomerative 3", "dpp_map": "DPP MAP"}


def plain_id(c: Column, prefix: str = "wiki") -> Column:
    """An id as a number, without the prefix that some lists carry; null if it is none."""
    return F.regexp_replace(c.cast("string"), f"^{prefix}:", "").try_cast("long")


def labelled(c: Column, names: dict[str, str] = DISPLAY) -> Column:
    """Display name, or the value itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)


def in_order(c: Column, order: list[str]) -> Column:
    """Sort key by a fixed order; unknown values last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def role(position: Column, warm_up: int) -> Column:
    return F.when(position < warm_up, "warm_up").otherwise("measured")


def manifest_subset(queries: DataFrame, key: str, ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Of queries(position, key, ...) those with the ids given, or the first `most`, or all; positions stay. Ids that repeat or that the manifest lacks are errors."""
    if ids is not None and most is not None:
        raise ValueError("either ids or a number of queries")
    if most is not None:
        if most <= 0:
            raise ValueError("a number of queries above 0")
        return queries.filter(F.col("position") < most)
    if ids is None:
        return queries
    if twice := checks.duplicates(ids, [key]).first():
        raise ValueError(f"{key} {twice[key]} is asked for {twice['n']} times")
    if lacking := checks.unknown(ids, queries, [key]).first():
        raise ValueError(f"{key} {lacking[key]} isn't in the manifest")
    return queries.join(ids.select(key), key, "left_semi")


def candidate_artifacts(ranked: DataFrame, retriever: str, corpus: DataFrame) -> DataFrame:
    """query_id, retriever, n, candidates: each query's bounded list as one array, with content hashes from corpus(doc_id, content)."""
    hashed = ranked.join(corpus.select("doc_id", F.sha2("content", 256).alias("content_sha256")), "doc_id")
    entry = F.struct("rank", "doc_id", "score", "content_sha256")
    return hashed.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("candidates")).select("query_id", F.lit(retriever).alias("retriever"), "n", "candidates")


def selected_contexts(selected: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, condition, passages, context for lists of exactly k passages; selected(query_id, condition, selected_rank, doc_id), corpus(doc_id, content)."""
    entry = F.struct("selected_rank", "doc_id", F.trim("content").alias("body"))
    lists = selected.join(corpus.select("doc_id", "content"), "doc_id").groupBy("query_id", "condition").agg(F.array_sort(F.collect_list(entry)).alias("passages")).filter(F.size("passages") == k)
    return lists.withColumn("context", X.context_block(F.transform("passages", lambda p: p["body"])))


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the names that df has as a column."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of the columns {', '.join(names)}")


def gold_groups(samples: DataFrame, sample: str, sections: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """Of samples(sample, sections array, labels array): the documents (corpus_position, sample, section, label, text), a row for each section, numbered through in the order of samples and sections; and (sample, gold_ids), each sample's documents in order.

    Only samples are put in order, with the numbers of their sections; a
    section's position is its sample's first one and its place there. A sample whose sections and labels differ in number, or with a section
    that is null or blank, is an error when it is read. A sample without
    sections has no documents and an empty list.
    """
    given = samples.select(F.col(sample).alias("sample"), F.col(sections).alias("sections"), F.col(labels).alias("labels"))
    blank = F.exists("sections", lambda x: F.coalesce(X.strip(x), F.lit("")) == "")
    fault = F.when(~F.size("sections").eqNullSafe(F.size("labels")), "sections and labels differ in number").when(blank, "a section is blank")
    sound = given.filter(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("sample "), F.col("sample").cast("string"), F.lit(": "), fault)).cast("boolean")).otherwise(True))
    rows = sound.select("sample", F.posexplode(F.arrays_zip("sections", "labels")).alias("section", "x")).select("sample", "section", F.col("x.labels").alias("label"), X.strip(F.col("x.sections")).alias("text"))
    sizes = kept(sound.groupBy("sample").agg(F.sum(F.greatest(F.coalesce(F.size("sections"), F.lit(0)), F.lit(0))).alias("n")), "sizes")
    starts = running(sizes, ["sample"], "n", "start")
    place = F.row_number().over(W.partitionBy("sample").orderBy("section", "label", "text")) - 1
    documents = rows.withColumn("place", place).alias("l").join(starts.alias("r"), F.col("l.sample").eqNullSafe(F.col("r.sample"))).select((F.col("start") + F.col("place")).alias("corpus_position"), "l.sample", "section", "label", "text")
    groups = starts.select("sample", F.when(F.col("n") > 0, F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")).alias("gold_ids"))
    return documents, groups


def passages_agree(a: DataFrame, b: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """keys, same: whether both lists name the same passages in the same order."""
    return a.select(*keys, F.col(ids).alias("_a")).join(b.select(*keys, F.col(ids).alias("_b")), keys).select(*keys, (F.col("_a") == F.col("_b")).alias("same"))


def prompts(rows: DataFrame, template: str, with_context: bool) -> Column:
    """A template's {question} and {context} filled at once, so that texts with braces stay as they are."""
    head, _, rest = template.partition("{question}")
    middle, _, tail = rest.partition("{context}")
    parts = [F.lit(head), F.col("question"), F.lit(middle), *([F.col("context")] if with_context else []), F.lit(tail)]
    return F.concat(*parts)


def claim_workload(answers: DataFrame, text: str, keep: tuple[str, ...] = ("OK",)) -> DataFrame:
    """A row for each sentence of the kept answers, numbered from 0."""
    kept = answers.filter(F.col("status").isin(*keep))
    return kept.select("*", F.posexplode(X.sentences(F.col(text))).alias("claim", "claim_text"))


def explained_claims(answers: DataFrame, text: str) -> DataFrame:
    """A row for each sentence of what the OK answers explain, numbered from 0; an OK answer without explanation is an error when it is read."""
    said = X.explanation(F.col(text))
    sound = F.coalesce(F.size(X.sentences(said)) > 0, F.lit(False))
    kept_ = answers.filter("status = 'OK'").filter(F.when(~sound, F.raise_error(F.lit("an OK answer without explanation")).cast("boolean")).otherwise(True))
    return kept_.select("*", F.posexplode(X.sentences(said)).alias("claim", "claim_text"))


def question_claim(question: Column, answer: Column, status: Column) -> Column:
    return F.when(status == "REFUSAL", F.format_string("The question %s can't be answered.", question)).otherwise(F.format_string("The answer to %s is %s.", question, answer))


def row_score(value: Column, status: Column) -> Column:
    """A refusal scores 0, what isn't OK has no score."""
    return F.when(status == "OK", value).when(status == "REFUSAL", 0.0)


def repeatability(calls: DataFrame, key: str, text: str, times: int | None = 3, enough: int = 19) -> DataFrame:
    """n, n_same, passed: prompts whose calls, as many as asked if that is given, all gave the same stripped text; a call without text is like no other."""
    asked = F.count("*") == times if times else F.lit(True)
    per = calls.groupBy(key).agg(((F.countDistinct(X.strip(F.col(text))) == 1) & (F.count(text) == F.count("*")) & asked).alias("same"))
    return per.agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), (F.count_if("same") >= enough).alias("passed"))


def paired_correct(prediction: Column, gold: Column, status: Column) -> Column:
    return row_score((prediction == gold).cast("double"), status)


def alias_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, str_em, str_hit of rows(keys, aspect, present): share of aspects present, and whether all are."""
    return rows.groupBy(*keys, "aspect").agg(F.bool_or("present").alias("p")).groupBy(*keys).agg(F.avg(F.col("p").cast("double")).alias("str_em"), F.bool_and("p").cast("double").alias("str_hit"))


def grounding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, all_grounded, distinct_grounded of rows(keys, aspect, doc_id): whether every aspect has a passage, and all have different ones."""
    return rows.groupBy(*keys).agg(F.bool_and(F.col("doc_id").isNotNull()).alias("all_grounded"), (F.countDistinct("doc_id") == F.count("*")).alias("distinct_grounded"))


#: Rows of a range and bytes of its texts and lists, about, as ranges follow samples.
RANGE_ROWS, RANGE_BYTES = 1_000_000, 1 << 26


def ranged(df: DataFrame, order: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """df, written once, sorted, in as many ranges of the order as make about so many rows each, and fewer where rows are wide, with _range and the row's place in it, _place. Rows equal in the order are in one range."""
    wide = [F.octet_length(c if kind in ("string", "binary") else F.to_json(F.struct(c))) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    seen = df.agg(F.count("*").alias("n"), F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(0).cast("long"))).alias("bytes")).first()
    parts = max(1, math.ceil(seen["n"] / rows), math.ceil((seen["bytes"] or 0) / RANGE_BYTES))
    at = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the row
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return kept(sorted_.withColumn("_range", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")


def numbered(df: DataFrame, order: str | list[str], out: str = "corpus_position", rows: int = RANGE_ROWS) -> DataFrame:
    """Positions 0, 1, ... in the order of a column or several: the place in its range, and the rows of the ranges before."""
    placed = ranged(df, [order] if isinstance(order, str) else order, rows)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    carried = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    return placed.join(F.broadcast(carried), "_range").withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def running(df: DataFrame, order: list[str], amount: str, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with the sum of an amount over all rows before, in the order of columns: the sum within its range, and those of the ranges before."""
    placed = ranged(df, order, rows)
    inside = F.sum(amount).over(W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    carried = placed.groupBy("_range").agg(F.sum(amount).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(carried), "_range").withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_place", "_before", "_inside")


def first_by_hash(df: DataFrame, id_column: str, namespace: str, n: int) -> DataFrame:
    """df with first: whether the row is among the n of the smallest sha256 of "namespace|id". The places come from ranges of the hashes, so n may be any share of the rows."""
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), F.col(id_column).cast("string")), 256)
    hashed = df.withColumn("_hash", F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long"))
    return numbered(hashed, "_hash", "_at").withColumn("first", F.col("_at") < n).drop("_hash", "_at")


def checked_candidates(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates(query_id, rank, corpus_position, doc_id, content_sha256) with the content of corpus(corpus_position, doc_id, content).

    A position that the corpus lacks, or whose document has another id or other
    content than the candidate says, is an error when the row is read.
    """
    there = corpus.select("corpus_position", F.col("doc_id").alias("_id"), "content")
    both = candidates.join(there, "corpus_position", "left")
    fault = F.when(F.col("_id").isNull(), "no document at a candidate's position").when(F.col("_id") != F.col("doc_id"), "a candidate's document has another id").when(F.sha2("content", 256) != F.col("content_sha256"), "a candidate's document has other content")
    return both.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).drop("_id")


def map_model(rows: DataFrame, call: Callable[[list[str]], list[str]], text: str, out: str, attempts: int = 3) -> DataFrame:
    """rows with the answers of an injected model, batch by batch; only errors of the connection are tried again, and then give null."""
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"`{out}` string"])

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list = [None] * len(frame)
            for _ in range(attempts):
                try:
                    answers = call(frame[text].tolist())
                    break
                except ConnectionError:
                    continue
            yield frame.assign(**{out: answers})

    return rows.mapInPandas(over, kinds)
