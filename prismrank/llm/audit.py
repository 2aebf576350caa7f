"""Filter interaction audit: what each of five filters removes in every order of them.

Documents that fail the same filters are alike, so they are counted first: a part
has at most 32 cells. A cell's fate is folded along all 120 orders with the
higher-order functions aggregate and transform, which gives 600 structs weighted
with the cell's documents, and the cells of a part are summed element by element.
"""

from __future__ import annotations

from itertools import permutations
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.llm.common import materialize, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_BLANK = " \t\n\x0b\x0c\r"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; E needs the other texts."""
    bare = F.btrim(text, F.lit(_BLANK))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    fails = [n < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT_PCT * n, 100 * capitals.cast("long") > MOST_CAPITALS_PCT * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(c, bit).otherwise(0) for c, bit in zip(fails, _BIT.values(), strict=False)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of the filters), n, good, toxic: documents of a part that fail the same filters.

    A document fails E if a smaller doc_id has its text. Rows that agree in
    doc_id, text and part count together from the start. The first document
    of each text comes from partial aggregates and is joined back by text and
    doc_id, so that no group of copies meets in one task.
    """
    text = text_of()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).cast("string").alias("part"), F.unhex(F.md5(text)).alias("of"), failures(text).alias("fails"))
    rows = materialize(rows.groupBy("doc_id", "part", "of", "fails").agg(F.count("*").alias("n")), "audited")
    first = rows.groupBy("of").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    judged = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    both = rows.join(first, ["of", "doc_id"], "left").join(judged, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), _BIT["E"]).otherwise(0)
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return both.groupBy("part", (F.col("fails") + copy).alias("fails")).agg(F.sum("n").alias("n"), lost("good").alias("good"), lost("toxic").alias("toxic"))


def _fate(cell: Column, order: Column) -> Column:
    """The structs of the steps of one order for a cell; order holds the filters' bits."""
    nothing = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, there = cell["fails"].bitwiseAND(bit) == bit, state["there"]
        count = lambda when, of="n": F.when(when, cell[of]).otherwise(nothing)
        made = F.struct(
            count(there & ~fails).alias("kept"),
            count(there & fails).alias("removed"),
            count(~there & fails).alias("redundant"),
            count(cell["fails"] == bit).alias("unique_fails"),
            count(there & fails, "good").alias("good_lost"),
            count(there & fails, "toxic").alias("toxic_lost"),
        )
        return F.struct((there & ~fails).alias("there"), F.concat(state["steps"], F.array(made)).alias("steps"))

    start = F.struct(F.lit(True).alias("there"), F.expr(f"CAST(array() AS array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>)").alias("steps"))
    return F.aggregate(order, start, step, lambda s: s["steps"])


def audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, zeros included, of cells(part, fails, n, good, toxic), unique in part and fails."""
    orders = F.from_json(F.lit(str([[_BIT[f] for f in o] for o in ORDERS])), "array<array<int>>")
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    of_cell = lambda c, all_: F.flatten(F.transform(all_, lambda o: _fate(c, o)))
    plus = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells")).withColumn("orders", orders)
    summed = parts.select("part", F.aggregate("cells", zeros, lambda acc, c: F.zip_with(acc, of_cell(c, F.col("orders")), plus)).alias("all"))
    steps = summed.select("part", F.posexplode("all").alias("at", "x"))
    names = F.from_json(F.lit(str(ORDERS).replace("'", '"')), "array<string>")
    n = len(FILTERS)
    steps = steps.select("part", F.get(names, (F.col("at") / n).cast("int")).alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"), "x.*")
    of_filter = W.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return steps.withColumn("shapley", F.sum("removed").over(of_filter))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty and fail A alone (and E, as copies of each other); null
    sources are the part ''. A row without doc_id is neither before nor after
    another, so it doesn't fail E, and has no label. Rows that repeat a doc_id
    count each; those of the same text aren't copies of each other, as neither
    doc_id is smaller. Of several labels of a doc_id the largest counts. An
    empty table gives no rows; other columns are ignored.
    """
    return audit(cells(docs, labels))


ORACLE = f"""
WITH bits AS (
  SELECT * FROM (VALUES {", ".join(f"('{f}', {b})" for f, b in _BIT.items())}) t(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM bits a, bits b, bits c, bits d, bits e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), places AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, CAST(s AS BIGINT), 1) AS f FROM orders, range(1, 6) t(s)
), steps AS (
  SELECT p.filter_order, p.step, b.bit, (SELECT coalesce(sum(b2.bit), 0) FROM places q JOIN bits b2 ON q.f = b2.f WHERE q.filter_order = p.filter_order AND q.step < p.step)::INTEGER AS gone
  FROM places p JOIN bits b ON p.f = b.f
), docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT_PCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS_PCT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM docs LEFT JOIN judged USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), summed AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (gone | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & gone = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & gone <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & gone = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & gone = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM summed
"""
