"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows, which are sequences by
themselves. What is left of each document goes, longest first, into the open
window with the least room that still holds it; a segment tree over the room
left finds that window. Every task packs the rows of its own partition, in
buffers of bounded size between which the open windows stay open, so nothing is
shuffled and a lost task packs again to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, text_of
from prismrank.llm.tokens import encoder

#: Tokens of remainders that a task holds before it packs them.
BUFFER_TOKENS = 3_000_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenWindows:
    """Open windows by the room they have left, with the tightest fit in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.capacity = capacity
        self.tree = bytearray(2 * self.leaves)  # 1 where a leaf below has a window
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node, tree = room + self.leaves, self.tree
        tree[node] = bool(self.windows[room])
        while node := node >> 1:
            if tree[node] == (there := tree[2 * node] | tree[2 * node + 1]):
                break
            tree[node] = there

    def tightest(self, need: int) -> int | None:
        """The least room, at least need, of any open window."""
        node, tree = need + self.leaves, self.tree
        while not tree[node]:
            while node & 1:  # a right child, or the root: go up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def put(self, window: int, room: int) -> None:
        if room:
            self.windows[room].append(window)
            self._mark(room)

    def take(self, room: int) -> int:
        window = self.windows[room].pop()
        if not self.windows[room]:
            self._mark(room)
        return window


class Packer:
    """Gives (sequence, offset) to lengths; sequences are counted from 0."""

    def __init__(self, capacity: int):
        self.open, self.capacity, self.used = OpenWindows(capacity), capacity, 0

    def whole(self) -> int:
        self.used += 1
        return self.used - 1

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Places for the lengths, dealt longest first; ties in the order given."""
        places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
            n = lengths[i]
            if (room := self.open.tightest(n)) is None:
                window, room = self.whole(), self.capacity
            else:
                window = self.open.take(room)
            places[i] = (window, self.capacity - room)
            self.open.put(window, room - n)
        return places


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents(doc_id, text, ...) with their place in sequences of at most window tokens.

    Returns doc_id, start (ids of its document before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Pieces of a
    sequence lie without gaps from 0. A null or empty text is its end id alone;
    a null doc_id stays null; repeated rows are packed each; other columns are
    ignored; no rows give no pieces.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(tokenizer), Packer(window)
        first = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        tokens = 0

        def settle() -> pa.RecordBatch:
            places = packer.place([n for _, _, n, _, _ in held])
            rows = [(*piece, first + seq, offset) for piece, (seq, offset) in zip(held, places, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            full: list[tuple] = []
            ids, ends = words.encode(texts, end_id)
            data, starts = ids.astype("<u4").tobytes(), [0, *ends.tolist()]
            for doc_id, begin, end in zip(doc_ids, starts, starts[1:], strict=False):
                n = end - begin
                for start in range(0, n, window):
                    length = min(window, n - start)
                    piece = (doc_id, start, length, data[4 * (begin + start) : 4 * (begin + start + length)], n)
                    if length == window:
                        full.append((*piece, first + packer.whole(), 0))
                    else:
                        held.append(piece)
                        tokens += length
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), PIECES, strict=True)], schema=PIECES)
            if tokens > BUFFER_TOKENS:
                yield settle()
                held, tokens = [], 0
        if held:
            yield settle()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_batches).mapInArrow(over, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
