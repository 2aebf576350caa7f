"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

A dataset is a folder of two Parquet tables. codebook: the length of the code of
each id that occurs, from counts over the whole corpus; lengths alone fix the
canonical codes. blocks: one row for each run of whole documents of about
BLOCK_TOKENS ids (a longer document is a block by itself), with the documents'
ids and lengths, the bits, and the bit offset of every STRIDE-th id. Blocks are
decoded by themselves with one table look-up for an id; the offsets let all
strides of a block be decoded side by side. Rows of a shard are in ascending
doc_id order, and so are the shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismrank.llm.common import in_batches, materialize, shared_dir, text_of
from prismrank.llm.tokens import encoder

BLOCK_TOKENS, STRIDE, LIMIT = 1 << 16, 64, 18
#: Chunks and words that a worker's encoder keeps.
CACHE = 1_000_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of at most limit bits that make the total least, by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaves))  # by weight: is it a leaf
        weights = weights[rank]
        packages = weights[0 : len(weights) // 2 * 2 : 2] + weights[1 : len(weights) // 2 * 2 : 2]
    take, out = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[:n] += 1
        take = 2 * (take - n)
    lengths[order] = out
    return lengths


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids that have a code, by length and then id, what each takes of the space of codes, and the bits of the longest."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    bits = max(1, int(lengths.max(initial=0)))
    return ids, np.int64(1) << (bits - lengths[ids]), bits


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ascending by length, then id."""
    ids, share, bits = _ordered(lengths)
    codes = np.zeros(len(lengths), np.int64)
    codes[ids] = (np.cumsum(share) - share) >> (bits - lengths[ids])
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits, as big-endian 32-bit words, and the bit offset of every STRIDE-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    n_words = int(ends[-1] + 31) // 32 + 2 if len(ids) else 2
    word, shift = at >> 5, 64 - (at & 31) - size
    both = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    out = np.zeros(n_words, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(both >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::STRIDE]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        ids, share, self.bits = _ordered(lengths)
        self.symbol, self.size = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
        n = int(share.sum())
        self.symbol[:n], self.size[:n] = np.repeat(ids, share), np.repeat(lengths[ids], share)

    def block(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; every stride goes on by one id in each step."""
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        at = np.array(offsets, np.int64)
        out = np.zeros((len(at), STRIDE), np.uint32)
        last = n - (len(at) - 1) * STRIDE  # ids of the last stride
        for step in range(min(STRIDE, n)):
            if step == last and len(at):
                at = at[:-1]
            word = at >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            peek = (window >> (64 - (at & 31) - self.bits).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
            out[: len(at), step] = self.symbol[peek]
            at = at + self.size[peek]
        return out.ravel()[:n]


def _width(vocabulary: int) -> str:
    """How ids of the vocabulary are kept: in 16 bits where they fit, else 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, shards: int, vocabulary: int = 1 << 16) -> DataFrame:
    """shard, doc_id, before (ids before it in its shard) and ids in ascending doc_id order, nulls first; rows of one doc_id in the table's order.

    The row's place takes part in the ranges, so that a doc_id that very many
    rows have is split. An id outside the vocabulary is an error.
    """
    kind = np.dtype(_width(vocabulary))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, shard = encoder(tokenizer, CACHE, CACHE), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, ends = words.encode(batch.column(1).to_pylist(), end_id)
            if len(ids) and ids.max() >= vocabulary:
                raise ValueError(f"id {ids.max()} in a vocabulary of {vocabulary}")
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            short = ids.astype(kind).tobytes()
            cut = [short[kind.itemsize * a : kind.itemsize * b] for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ends), pa.int32()), batch.column(0), pa.array(starts + before, pa.int64()), pa.array(cut, pa.binary())], names=["shard", "doc_id", "before", "ids"])
            before += len(ids)

    given = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = given.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return ordered.select("doc_id", "text").transform(in_batches).mapInArrow(over, "shard int, doc_id long, before long, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int = 1 << 16) -> DataFrame:
    """id and count over all rows, counted in each task first."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), _width(vocabulary)), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "count"])

    return tokens.select("ids").mapInArrow(over, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def encode_blocks(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Rows of the blocks table. A block doesn't cross shards nor parts of a shard that are read apart."""
    codes, kind = canonical_codes(lengths), np.dtype(_width(len(lengths)))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([x for *_, x in held]), kind).astype(np.int64)
            bits, offsets = encode_block(ids, codes, lengths)
            row = {"shard": held[0][0], "before": held[0][2], "doc_ids": [d for _, d, _, _ in held], "lengths": [len(x) // kind.itemsize for *_, x in held], "bits": bits, "offsets": offsets.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = len(row[3]) // kind.itemsize
                if held and (row[0] != held[0][0] or row[2] != held[-1][2] + len(held[-1][3]) // kind.itemsize or size + n > BLOCK_TOKENS):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += n
        if held:
            yield block()

    return tokens.select("shard", "doc_id", "before", "ids").mapInArrow(over, BLOCKS_DDL)


BLOCKS = pa.schema([("shard", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("offsets", pa.list_(pa.int64()))])
BLOCKS_DDL = "shard int, before long, doc_ids array<long>, lengths array<long>, bits binary, offsets array<long>"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, vocabulary: int = 1 << 16) -> None:
    """Tokenise all documents and write the dataset at path. Null texts are empty; an empty table gives an empty dataset.

    The ids are kept once as written tokens, so that counting and coding don't
    tokenise again. Only the counts of the vocabulary's ids go to the driver.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = materialize(tokenise(docs, tokenizer, end_id, shards, vocabulary), "tokens")
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(tokens, vocabulary).collect():
        counts[row["id"]] = row["count"]
    lengths = code_lengths(counts)
    book = pa.table({"id": pa.array(np.flatnonzero(lengths), pa.int32()), "length": pa.array(lengths[lengths > 0], pa.int32())})
    spark.createDataFrame(book.to_pandas(), "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    encode_blocks(tokens, lengths).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, vocabulary: int = 1 << 16) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of the dataset at path.

    Null doc_ids come first and rows of one doc_id each have their own; an empty dataset gives no rows.
    """
    lengths = np.zeros(vocabulary, np.int64)
    for row in spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect():
        lengths[row["id"]] = row["length"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["lengths"]
                ids = decoder.block(row["bits"], row["offsets"], sum(n)).astype("<u4")
                ends = np.cumsum(n)
                starts = ends - n
                parts = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"] + row["base"], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    return blocks.join(F.broadcast(bases), "shard").mapInArrow(over, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of each document as read back from the written dataset."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
