"""Line dedup: lines that several documents share go, except in the last document that has them.

Every line's key is the line without white space around it and with A-Z in lower
case. The lines are exploded with the digest of their key; the distinct documents
of each key are counted, first within a key and document, so a line that is
everywhere is a number before it meets its like; places of lines of the keys over
the threshold come back to their document, whose other lines are put together by
place. Built-in functions only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import materialize, text_of

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys that have at least this part of all rows are joined by broadcast: there can't be more than so many.
HOT_KEYS = 10_000
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line as it is compared. lower() is the same for lines of ASCII alone, and several times faster."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shared_places(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, _ld_text, places: of each document that loses lines, their places from 0; _ld_text is the digest of its text."""
    text = text_of()
    keys = F.transform(F.transform(_lines(text), line_key), lambda k: F.when(F.length(k) >= least_chars, F.unhex(F.md5(k))))
    lines = docs.select("doc_id", F.unhex(F.md5(text)).alias("_ld_text"), F.posexplode(keys).alias("place", "key")).filter("key IS NOT NULL")
    lines = materialize(lines, "lines")
    n_docs = F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    shared = lines.groupBy("key").agg(n_docs.alias("n_docs"), F.count("*").alias("n_rows"), F.max("doc_id").alias("last")).filter(F.col("n_docs") >= least_docs)
    shared = materialize(shared.select("key", "last", "n_rows"), "shared")
    rows = shared.agg(F.sum("n_rows")).first()[0] or 0
    is_hot = F.col("n_rows") * HOT_KEYS >= rows
    hot, cold = (F.broadcast(shared.filter(is_hot).select("key", "last"))), shared.filter(~is_hot).select("key", "last")
    found = lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(cold, "key"))
    lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id", "_ld_text").agg(F.collect_set("place").alias("places"))


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the text that is left, n_lines (before) and n_dropped; columns of these names are replaced.

    A key is dropped if it has least_chars code points or more and least_docs
    documents or more hold it, once or often; the document of the largest doc_id
    that holds it keeps all its lines of it. A null text is empty, and an empty
    text is one empty line. Rows of one doc_id are one document, each row with
    its own text; rows without doc_id are together one document before all
    others. Repeated rows are each returned. A document that loses every line
    has the empty text. An empty table gives no rows.
    """
    text = text_of()
    lost = shared_places(docs, least_chars, least_docs).withColumnsRenamed({"doc_id": "_ld_id", "places": "_ld_places"})
    named = docs.withColumn("_ld_of", F.unhex(F.md5(text)))
    both = named.join(lost, named["doc_id"].eqNullSafe(lost["_ld_id"]) & (named["_ld_of"] == lost["_ld_text"]), "left")
    lines, n = _lines(text), F.size(_lines(text))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_ld_places"))
    kept = F.when(F.col("_ld_places").isNull(), text).otherwise(F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n"))
    counts = {"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("_ld_places"), F.lit(0)).cast("long")}
    return both.select(*[c for c in docs.columns if c not in ("text", *counts)], kept.alias("text"), *[c.alias(name) for name, c in counts.items()])


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM d
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {LEAST_DOCS}
), judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM shared.last AS lost FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
