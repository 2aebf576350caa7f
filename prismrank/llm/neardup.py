"""N-gram Jaccard join with Bayesian candidate pruning.

Documents whose five-word shingles overlap by a Jaccard similarity of at least
the threshold are linked.

1. Each text is sketched once: a hash of its set of shingles, MinHash values,
   and keys of bands of these. Texts of equal sets are one class from here on.
2. Classes that share a band's key are candidates. A bucket of two is a pair;
   larger buckets with the same members count once; very large ones are cut into
   chunks that are held against each other chunk by chunk.
3. The MinHash values of candidates are compared a few at a time. After each
   step a pair is dropped if the posterior probability that its similarity
   reaches the threshold, given the values equal so far and a uniform prior, is
   below the tolerance. The pairs left connect candidate clusters.
4. Within each cluster, again in chunks, all similarities are counted exactly
   from the shingles. Links aren't listed one by one: each class keeps the
   number of its links, and spanning edges that make the final classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, map_batches, materialize, shuffle_width, text_of
from prismrank.llm.graph import Union, components, star_edges

N_WORDS, THRESHOLD = 5, 0.8
#: Bands of the MinHash values and values in each; two texts of similarity 0.8 share no band with probability (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
#: Values compared by the pruning, in steps, and the posterior probability under which a pair is dropped.
COMPARED, STEP, TOLERANCE = 128, 16, 1e-4
#: Members of a bucket or cluster that are held against each other at once.
CHUNK = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words, lower-cased, that white space separates; fewer words are one run; none, no run.

    Hashes are polynomials of the runs' bytes, taken for all runs at once from
    running sums over the whole text.
    """
    joined = " ".join(text.lower().split()).encode("utf-8", "replace")
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    size = 1 << max(12, len(data).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    k = min(n_words, len(starts))
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)))


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """MinHash values: the least of each multiplicative hash of the shingles."""
    multiply, add = _hashes()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * multiply + add).min(0), out=out)
    return out


def sketch(text: str) -> tuple[str | None, list[int] | None, bytes | None]:
    """Hash of the set of shingles, band keys, and values for the pruning; nothing for a text without words."""
    s = shingles(text)
    if not len(s):
        return None, None, None
    values = minhash(s).reshape(BANDS, ROWS)
    keys = np.full(BANDS, 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = _mixed(keys * np.uint64(_BASE) + values[:, j].astype(np.uint64))
    short = (_mixed(values.ravel()[:COMPARED].astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), keys.view(np.int64).tolist(), short.tobytes()


@lru_cache(maxsize=8)
def least_equal(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest equal values with which a pair stays: P(similarity >= threshold | equal of compared) >= tolerance under a uniform prior."""
    out = []
    for k in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # Beta(m + 1, k - m + 1) from the threshold on, as a binomial sum
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def pruned_pairs(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """(i, j) of the rows of a and b that the pruning leaves."""
    pairs = None
    equal = np.zeros(0)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        if pairs is None:
            count = np.zeros((len(a), len(b)), np.int16)
            for c in range(part.start, part.stop):
                count += a[:, c, None] == b[None, :, c]
            pairs = np.argwhere(count >= need)
            equal = count[pairs[:, 0], pairs[:, 1]]
        else:
            equal = equal + (a[pairs[:, 0], part] == b[pairs[:, 1], part]).sum(1)
            stay = equal >= need
            pairs, equal = pairs[stay], equal[stay]
    return pairs


def exact_links(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each two of a and b are as similar as the threshold, from counts of shared shingles."""
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    every, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    of = np.repeat(np.arange(len(a) + len(b)), np.concatenate([sizes_a, sizes_b]))
    order = np.argsort(where, kind="stable")
    where, of = where[order], of[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(every), 4096):  # so many shingles at once keep the matrices small
        x, y = np.searchsorted(where, [low, low + 4096])
        dense = np.zeros((len(a) + len(b), 4096), np.float32)
        dense[of[x:y], where[x:y] - low] = 1
        shared += dense[: len(a)] @ dense[len(a) :].T
    return shared >= threshold * (sizes_a[:, None] + sizes_b[None, :] - shared) - 1e-6


def _chunked(members: DataFrame, group: str, size: str) -> DataFrame:
    """Each member once for every two chunks of its group that its own is one of: i and j, and side (0: in both as i = j, 1: in i, 2: in j)."""
    n = F.ceil(F.col(size) / F.lit(CHUNK)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    return members.withColumn("n", n).withColumn("mine", mine).withColumn("cell", F.explode(spread)).select("*", "cell.i", "cell.j").drop("cell", "n", size).withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("mine") == F.col("i"), 1).otherwise(2))


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[tuple, list, list, bool]]:
    """Of a partition sorted by keys: (key, members of the first chunk, of the second, whether they are one chunk); members are rows."""
    now, rows = None, []

    def cell() -> tuple:
        first = [r for r in rows if r["side"] < 2]
        return now, first, first if rows[0]["side"] == 0 else [r for r in rows if r["side"] == 2], rows[0]["side"] == 0

    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield cell()
                now, rows = key, []
            rows.append(row)
    if rows:
        yield cell()


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _joining(first: list, second: list, within: list[np.ndarray], across: np.ndarray) -> list[dict]:
    """Edges for the pairs across two chunks that connect what the pairs within each don't: few, as each chunk's own cell has edges for these."""
    union, out = Union(len(first) + len(second)), []
    for offset, pairs in zip((0, len(first)), within, strict=True):
        for i, j in pairs.tolist():
            union.join(offset + i, offset + j)
    for i, j in across.tolist():
        if union.find(i) != union.find(len(first) + j):
            union.join(i, len(first) + j)
            out.append({"a": first[i]["node"], "b": second[j]["node"]})
    return out


def _spanning(first: list, second: list, pairs: np.ndarray) -> list[dict]:
    """Edges that connect what the pairs connect."""
    nodes = sorted({r["node"] for r in first} | {r["node"] for r in second})
    at = {n: i for i, n in enumerate(nodes)}
    union = Union(len(nodes))
    for i, j in pairs.tolist():
        union.join(at[first[i]["node"]], at[second[j]["node"]])
    return [{"a": nodes[x], "b": nodes[y]} for part in union.members() for x, y in star_edges(part)]


def _candidate_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all classes whose similarity may reach the threshold."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("size > 1")
    once = buckets.groupBy("size", "low", "high", "mark").agg(F.min("key").alias("key"))  # one bucket for all with the same members
    once = materialize(once, "buckets")
    pairs = once.filter("size = 2").select(F.col("key").alias("bucket"), "size", F.explode(F.array("low", "high")).alias("node"))
    larger = bands.join(once.filter("size > 2").select("key", "size"), "key").select(F.col("key").alias("bucket"), "size", "node")
    members = _chunked(pairs.unionAll(larger), "bucket", "size").select("bucket", "i", "j", "side", "node").join(nodes.select("node", "values"), "node")
    dealt = members.repartition(shuffle_width(nodes.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    least = least_equal(threshold)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, first, second, one in _cells(batches, ["bucket", "i", "j"], "values"):
            if not first or not second:
                continue
            a = np.stack([np.frombuffer(r["values"], "<u2") for r in first])
            b = a if one else np.stack([np.frombuffer(r["values"], "<u2") for r in second])
            pairs = pruned_pairs(a, b, least)
            if one:
                out += _spanning(first, second, pairs[pairs[:, 0] < pairs[:, 1]])
            elif len(pairs):
                out += _joining(first, second, [pruned_pairs(a, a, least), pruned_pairs(b, b, least)], pairs)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema=_EDGE)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_EDGE)

    return dealt.select("bucket", "i", "j", "side", "node", "values").mapInArrow(prune, "a long, b long").distinct()


def _verified(texts: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """a, b, links, copies of each class, cell by cell: b of spanning edges among linked classes, links the number of other classes it is linked to in the cell, copies their documents."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "component").select("component", "size", "node", "copies", "least", "mark")
    own = texts.alias("t").join(members.alias("m"), F.col("t.doc_id").eqNullSafe(F.col("m.least")) & (F.col("t.mark") == F.col("m.mark")))
    held = own.groupBy("component", "size", "node", "copies").agg(F.min("text").alias("text"))  # of repeated rows, one
    cells = _chunked(held, "component", "size").select("component", "i", "j", "side", "node", "copies", "text")
    dealt = cells.repartition(shuffle_width(texts.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("copies", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # texts shrink to shingles as they come
            for batch in rows:
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, "text", pa.array([shingles(t).tobytes() for t in batch.column(at).to_pylist()], pa.binary()))

        out: list[dict] = []
        for _, first, second, one in _cells(hashed(batches), ["component", "i", "j"], "text"):
            if not first or not second:
                continue
            a = [np.frombuffer(r["text"], np.uint64) for r in first]
            b = a if one else [np.frombuffer(r["text"], np.uint64) for r in second]
            linked = exact_links(a, b, threshold)
            if one:
                np.fill_diagonal(linked, False)
            copies_a, copies_b = np.array([r["copies"] for r in first]), np.array([r["copies"] for r in second])
            sides = [(first, linked.sum(1), linked @ copies_b)] + ([] if one else [(second, linked.sum(0), copies_a @ linked)])
            for rows, links, copies in sides:
                out += [{"a": r["node"], "b": r["node"], "links": int(n), "copies": int(c)} for r, n, c in zip(rows, links, copies, strict=True) if n]
            out += [e | {"links": 0, "copies": 0} for e in _spanning(first, second, np.argwhere(linked))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.transform(in_batches).mapInArrow(verify, "a long, b long, links long, copies long")


def _mark() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text_of())


def _first(doc_id: str = "doc_id") -> Column:
    """The least of rows by doc_id, those without last, and of one doc_id by the text's mark."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("least"), "mark"))


def _linked(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, mark, class_id, class_mark, n_links and n_texts of each row; doc_id and text's mark of a class's first row stand for the class.

    Shingle sets have numbers of their own, given when their table is written,
    so that two texts under one doc_id are two nodes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("set_hash", pa.string()), ("bands", pa.list_(pa.int64())), ("values", pa.binary())])

    def one(batch: pa.RecordBatch) -> dict:
        hashes, bands, values = zip(*map(sketch, batch.column(2).to_pylist()), strict=True) if batch.num_rows else ([], [], [])
        return {"doc_id": batch.column(0), "mark": batch.column(1), "set_hash": hashes, "bands": bands, "values": values}

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), text_of().alias("text"))
    sketches = materialize(given.transform(in_batches).mapInArrow(map_batches(one, schema), "doc_id long, mark long, set_hash string, bands array<long>, values binary"), "sketches")
    worded = sketches.filter("set_hash IS NOT NULL")
    sizes = worded.groupBy("set_hash").agg(_first().alias("of"), F.count("*").alias("copies"))
    classes = materialize(sizes.select("set_hash", "copies", "of.least", "of.mark", F.monotonically_increasing_id().alias("node")), "classes")
    own = worded.alias("w").join(classes.alias("c"), (F.col("w.set_hash") == F.col("c.set_hash")) & F.col("w.doc_id").eqNullSafe(F.col("c.least")) & (F.col("w.mark") == F.col("c.mark")))
    nodes = own.groupBy("node").agg(F.min(F.struct("values", "bands")).alias("of")).select("node", "of.bands", "of.values")
    edges = materialize(_candidate_edges(nodes, threshold), "candidates")
    clusters = components(edges).join(classes.drop("set_hash"), "node")
    verified = materialize(_verified(given, clusters, threshold), "verified")
    final = components(verified.filter("a <> b").select("a", "b"))
    heads = final.join(classes.select("node", "least", "mark"), "node").groupBy("component").agg(_first("least").alias("of"))
    of_class = final.join(heads, "component").select("node", F.col("of.least").alias("class_id"), F.col("of.mark").alias("class_mark"), F.lit(True).alias("joined"))
    counted = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    either = lambda a, b: F.when(F.col("joined"), F.col(a)).otherwise(F.col(b)).alias(a)
    links = [(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_texts")]
    by_class = classes.join(of_class, "node", "left").join(counted, "node", "left").select("set_hash", either("class_id", "least"), either("class_mark", "mark"), *links)
    none = F.lit(0).cast("long")
    alone = sketches.filter("set_hash IS NULL").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.col("mark").alias("class_mark"), none.alias("n_links"), none.alias("n_texts"))
    return worded.select("doc_id", "mark", "set_hash").join(by_class, "set_hash").drop("set_hash").unionAll(alone)


def link(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links and n_texts of each row of docs(doc_id, text, ...).

    class_id is the least doc_id that links lead to, n_links the number of other
    documents at the threshold or over, copies included, n_texts that of other
    shingle sets among them. Words are lower-cased; a text of fewer than five
    words is one shingle; a null, empty or blank text has none, is linked to
    nothing and is a class by itself. Rows are documents, also such that repeat
    a doc_id: with the same text they are copies, with other texts they are
    linked by these texts only, and two classes that both have this doc_id as
    their least have the same class_id without being one. Rows without doc_id
    are linked like others; a class of such rows alone has no class_id. Other
    columns are ignored; no rows give no rows.
    """
    return _linked(docs, threshold).select("doc_id", "class_id", "n_links", "n_texts")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class by doc_id, with all columns; of rows with the same doc_id and text one. Rows without doc_id stay."""
    first = _linked(docs, threshold).filter((F.col("doc_id") == F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).select(F.col("doc_id").alias("_nd_id"), F.col("mark").alias("_nd_of")).distinct()
    named = docs.filter("doc_id IS NOT NULL").withColumn("_nd_mark", _mark())
    kept = named.join(first, (named["doc_id"] == first["_nd_id"]) & (named["_nd_mark"] == first["_nd_of"]), "left_semi").dropDuplicates(["doc_id", "_nd_mark"])
    return kept.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
