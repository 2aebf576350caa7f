"""Phrase collocations: HAT-trie counting of phrases, and the phrases whose words stick together.

A task counts the phrases of its documents in a burst trie: branches by digits of
the first words' ids near the root and hash containers below them, which burst into
a branch when they grow. When the trie is full, whole subtrees leave it as runs in
word order; the runs are merged by partitions of (lang, first two words), those of
frequent words salted by the phrase. A phrase can only occur as often as its parts,
so three passes count words, hashes of pairs of frequent words, and phrases of pairs
whose hashes are frequent; which are is told by filters of bounded size that never
lose one, and what is counted in the end are the phrases themselves, so the counts
are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from prismrank.llm.common import in_batches, join_params, materialize, shuffle_width, text_of

LEAST, LONGEST, BEST = 100, 5, 2_000
#: Entries of a container beyond which it bursts, and of a language's trie and of all, and words of all dictionaries of a task, beyond which runs leave.
BURST, FULL, ALL_FULL, VOCABULARY = 1 << 16, 700_000, 1_400_000, 400_000
#: Bytes of text that are counted at once, and rows of a run that leave at once.
CHUNK, RUN_ROWS = 1 << 21, 1 << 16
#: Bits of the filters for each frequent phrase, and the most that a filter has.
BITS_EACH, MOST_BITS, PROBES, SLICE = 16, 1 << 28, 4, 1 << 16
#: What phrases with the same first words are dealt to (a power of two), and buckets a language's phrases are ranked in first.
SALTS, RANKED_IN = 8, 64
#: Words of the corpus for each part of the pairs' hashes.
PART_WORDS = 1 << 18

_END = b"."  # no word has one
_BREAKS = ".,;:!?\n\x0b\x0c\r"
_TO_WORDS = bytes.maketrans((ascii_uppercase + "\t" + _BREAKS).encode(), (ascii_lowercase + " " + "." * len(_BREAKS)).encode())
#: Bits of a word's id in a task, and of a digit of the trie.
_ID, _DIGIT = 21, 6
_MASK = (1 << _ID) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chain(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of what comes first and of the next word."""
    x = (before ^ (before >> np.uint64(29))) * _ODD + after
    return (x ^ (x >> np.uint64(32))) * _ODD


class Container:
    """An open-addressed table of phrases, packed as two words and three in 64 bits each, with their counts."""

    def __init__(self, slots: int = 16):
        self.size = 0
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        self.first, self.more, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.first)
        return self.first[at], self.more[at], self.n[at]

    def add(self, first: np.ndarray, more: np.ndarray, n: np.ndarray) -> None:
        """Count phrases; the same one may come again and again."""
        if 2 * (self.size + len(first)) > len(self.first):
            old, slots = self.entries(), len(self.first)
            while 2 * (self.size + len(first)) > slots:
                slots *= 2
            self._empty(slots)
            self._place(*old)
        self._place(first, more, n)
        self.size = int(np.count_nonzero(self.first))

    def _place(self, first: np.ndarray, more: np.ndarray, n: np.ndarray) -> None:
        last = len(self.first) - 1
        slot = (chain(first, more) & np.uint64(last)).astype(np.int64)
        while len(first):
            free = self.first[slot] == 0
            to = slot[free]  # of several phrases that want a slot the last has it, in both arrays
            self.first[to], self.more[to] = first[free], more[free]
            own = (self.first[slot] == first) & (self.more[slot] == more)
            np.add.at(self.n, slot[own], n[own])
            other = ~own
            first, more, n, slot = first[other], more[other], n[other], (slot[other] + 1) & last


class HatTrie:
    """Counts of phrases. A node is a container, or a branch: its children by the next six bits of the first word's id and then the second's."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root = burst, Container()

    @staticmethod
    def _digit(first: np.ndarray, depth: int) -> np.ndarray:
        of_word = first >> np.uint64(_ID) if depth < 4 else first & np.uint64(_MASK)
        return (of_word >> np.uint64(_DIGIT * (depth % 4)) & np.uint64((1 << _DIGIT) - 1)).astype(np.uint8)

    def add(self, first: np.ndarray, more: np.ndarray, n: np.ndarray) -> None:
        self.root = self._added(self.root, first, more, n, 0)

    def _added(self, node: Container | dict, first: np.ndarray, more: np.ndarray, n: np.ndarray, depth: int) -> Container | dict:
        if isinstance(node, Container):
            node.add(first, more, n)
            if node.size <= self.burst or depth == 8:
                return node
            first, more, n = node.entries()
            node = {}
        digit = self._digit(first, depth)
        order = np.argsort(digit, kind="stable")
        there, starts = np.unique(digit[order], return_index=True)
        for d, rows in zip(there.tolist(), np.split(order, starts[1:]), strict=True):
            node[d] = self._added(node.get(d) or Container(), first[rows], more[rows], n[rows], depth + 1)
        return node

    def _containers(self, node: Container | dict) -> list[Container]:
        return [node] if isinstance(node, Container) else [c for child in node.values() for c in self._containers(child)]

    def _entries(self, node: Container | dict) -> int:
        return sum(c.size for c in self._containers(node))

    @property
    def size(self) -> int:
        return self._entries(self.root)

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Takes whole subtrees, those of most entries first, until no more than so many entries are left."""
        left = self.size
        if left <= down_to:
            return
        if isinstance(self.root, Container):
            self.root, whole = Container(), self.root
            yield whole.entries()
            return
        for digit in sorted(self.root, key=lambda d: self._entries(self.root[d]), reverse=True):
            subtree = self.root.pop(digit)
            left -= self._entries(subtree)
            yield tuple(map(np.concatenate, zip(*[c.entries() for c in self._containers(subtree)], strict=True)))
            if left <= down_to:
                return


class Filter:
    """Whether one of these hashes was put in: a Bloom filter, so some that weren't pass and none that was fails."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        yes = np.ones(len(h), bool)
        for p in filter_places(h, len(self.bits) * 8):
            yes &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return yes


def filter_places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = chain(h, np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def word_hash(lang: str, word: bytes) -> int:
    return xxh64_intdigest(lang.encode() + b"\t" + word)


def make_filter(hashes: DataFrame) -> bytes:
    """The bits for hashes(h long). Their number follows the rows up to MOST_BITS (32 MB), so what reaches the driver is bounded; beyond, more phrases pass in vain."""
    rows, size = hashes.count(), SLICE
    while size < min(BITS_EACH * rows, MOST_BITS):
        size *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(filter_places(h, size))), pa.int64())], ["at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for at in batch.column(1):
                flags = np.zeros(SLICE, np.uint8)
                flags[at.values.to_numpy()] = 1
                packed.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["slice", "bits"])

    at = hashes.select("h").mapInArrow(places, "at long")
    by_slice = at.groupBy(F.expr(f"CAST(at DIV {SLICE} AS INT)").alias("slice")).agg(F.collect_set((F.col("at") % SLICE).cast("int")).alias("at"))
    slices = {r["slice"]: r["bits"] for r in by_slice.mapInArrow(pack, "slice int, bits binary").collect()}
    return b"".join(bytes(slices.get(i, bytes(SLICE // 8))) for i in range(size // SLICE))


def word_hashes(words: DataFrame) -> DataFrame:
    """h of words(lang, phrase)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [word_hash(lang, w.encode()) for lang, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(over, "h long")


class PairHashes:
    """How often the hashes of pairs occur in a task; of a hash the bits of its part, the first ones, and 32 more count."""

    def __init__(self, part_bits: int, least: int):
        self.part_bits, self.least, self.table = part_bits, least, Container()

    def add(self, h: np.ndarray) -> None:
        h = h >> np.uint64(32 - self.part_bits) << np.uint64(1) | np.uint64(1)  # a table's first word isn't 0
        self.table.add(h, np.zeros(len(h), np.uint64), np.ones(len(h), np.int64))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """A run, in the order of hashes: a row for each part, of what its hashes add to the one before, and their counts, which don't matter beyond the least."""
        h, _, n = self.table.entries()
        self.table = Container()
        if not len(h):
            return
        order = np.argsort(h)
        h, n = h[order] >> np.uint64(1), np.minimum(n[order], self.least).astype("<u4")
        part, key = (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        more = np.diff(key, prepend=np.uint32(0))
        more[starts] = key[starts]
        planes = lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes()  # noqa: E731  equal high bytes side by side take little room
        ends = np.append(starts[1:], len(key))
        rows = [(planes(more[a:b].copy()), planes(n[a:b].copy())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array([k for k, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())], schema=_HASHES)


_HASHES = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def frequent_hashes(runs: DataFrame, least: int) -> DataFrame:
    """h of the pairs' hashes that occur least times or more, from all runs, part by part."""
    unplaned = lambda x: np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()

    def summed(part: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(which, np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array((found[n >= least].astype(np.int64)) | part << 32)], ["h"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []
        for batch in batches:
            for part, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != now and keys:
                    yield summed(now, keys, counts)
                    keys, counts = [], []
                now = part
                keys.append(np.cumsum(unplaned(k), dtype=np.uint32))
                counts.append(unplaned(c))
        if keys:
            yield summed(now, keys, counts)

    dealt = runs.repartition(shuffle_width(runs.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(over, "h long")


class Counts:
    """What a task has counted of one language."""

    def __init__(self, lang: str, words: Filter | None, pairs: Filter | None, part_bits: int):
        self.lang, self.words, self.pairs, self.part_bits = lang, words, pairs, part_bits
        self.carried: list[bytes] = []
        self.trie = HatTrie()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {_END: 0}
        self.names: list[bytes] = [_END]
        self.seen, self.hash, self.may_be = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, bool)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, given as they come, with their hashes and whether they may be frequent."""
        ids, names, old = self.ids, self.names, len(self.names)
        for w in set(words).difference(ids):
            ids[w] = len(names)
            names.append(w)
        if len(names) > old:
            h = np.array([word_hash(self.lang, w) for w in names[old:]], np.uint64)
            self.hash = np.concatenate([self.hash, h])
            if self.words is not None:
                self.may_be = np.concatenate([self.may_be, self.words.may_have(h)])
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def add(self, words: list[bytes]) -> np.ndarray | None:
        """Count the phrases that end in these words; they go on from the ones before. In the pass over pairs, their hashes."""
        back = len(self.carried)
        words = self.carried + words
        self.carried = words[-(LONGEST - 1) :]
        a = self._ids(words)
        if self.words is None:
            n = np.bincount(a[back:], minlength=len(self.names))
            n[: len(self.seen)] += self.seen
            self.seen = n
            return None
        good = self.may_be[a]
        at = np.flatnonzero(good[:-1] & good[1:])
        if self.pairs is None:
            at = at[at + 1 >= back]
        h = chain(self.hash[a[at]], self.hash[a[at + 1]])
        if self.pairs is None:
            return h
        goes_on = np.zeros(len(a) + LONGEST, bool)  # from a word to the next
        goes_on[at] = self.pairs.may_have(h >> np.uint64(32 - self.part_bits))
        run = goes_on.copy()
        for k in range(2, LONGEST + 1):
            if k > 2:
                run[: len(run) - (k - 2)] &= goes_on[k - 2 :]
            start = np.flatnonzero(run[: max(0, len(a) - k + 1)])
            self._count(a, start[start + k - 1 >= back], k)
        return None

    def _count(self, a: np.ndarray, start: np.ndarray, k: int) -> None:
        if len(start):
            w = [a[start + i].astype(np.uint64) if i < k else np.zeros(len(start), np.uint64) for i in range(LONGEST)]
            one, two = np.uint64(_ID), np.uint64(2 * _ID)
            self.trie.add(w[0] << one | w[1], w[2] << two | w[3] << one | w[4], np.ones(len(start), np.int64))

    def _batch(self, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Phrases, as rows of ids with 0 after their end, as rows of a run. The prefix stands for lang, the first two words and a salt from all of them."""
        h = self.hash[words]
        first = chain(h[:, 0], h[:, 1])
        salt = first
        for i in range(2, LONGEST):
            salt = chain(salt, h[:, i])
        prefix = (first >> np.uint64(44)).astype(np.int64) * SALTS + (salt >> np.uint64(40)).astype(np.int64) % SALTS
        flat, size = words[words > 0], (words > 0).sum(1)
        names = self.spelt.take(pa.array(flat)).cast(pa.string())
        phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), names), " ")
        return pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int32)), pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(n), np.int8))), phrases, pa.array(n, pa.int64())], schema=_RUN)

    def _in_order(self, words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A run's rows in the order of their words' bytes."""
        order = np.lexsort(self.ranks[words].T[::-1])
        for i in range(0, len(order), RUN_ROWS):
            yield self._batch(words[order[i : i + RUN_ROWS]], n[order[i : i + RUN_ROWS]])

    def spill(self, down_to: int) -> Iterator[pa.RecordBatch]:
        self.spelt = pa.array(self.names, pa.binary())
        self.ranks = np.zeros(len(self.names), np.int64)
        self.ranks[pc.sort_indices(self.spelt.slice(1)).to_numpy().astype(np.int64) + 1] = np.arange(1, len(self.names))
        for first, more, n in self.trie.spill(down_to):
            w = [first >> np.uint64(_ID), first, more >> np.uint64(2 * _ID), more >> np.uint64(_ID), more]
            yield from self._in_order(np.stack(w, 1).astype(np.int64) & _MASK, n)
        if not down_to:
            if self.words is None and self.seen[1:].any():
                yield pa.RecordBatch.from_pydict({"prefix": [0], "lang": [self.lang], "phrase": [""], "f": [int(self.seen[1:].sum())]}, schema=_RUN)
                seen = np.flatnonzero(self.seen[1:]) + 1
                yield from self._in_order(np.pad(seen[:, None], ((0, 0), (0, LONGEST - 1))), self.seen[seen])
            self.clear()


_RUN = pa.schema([("prefix", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts' words in lower case, with _END where a piece ends, in parts that end anywhere between words."""
    parts, size = [], 0
    for text in texts:
        for start in range(0, len(text) or 1, CHUNK):  # a part can end within a word: the last part is put in front of the next
            part = text[start : start + CHUNK].translate(_TO_WORDS).replace(_END, b" . ")
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                whole = b"".join(parts)
                cut = whole.rfind(b" ")
                parts, size = [whole[cut + 1 :]], len(whole) - cut - 1
                if words := whole[: cut + 1].split():
                    yield words
        parts.append(b" . ")
        size += 3
    if words := b"".join(parts).split():
        yield words


def _over_texts(batches: Iterator[pa.RecordBatch], words: Broadcast | None, pairs: Broadcast | None, part_bits: int = 0) -> Iterator[tuple[dict[str, Counts], Counts, np.ndarray | None]]:
    """Counts the texts of batches(lang, text), some at a time: the task's languages, the one just counted, and hashes of pairs. The taker may drop other languages: their texts have ended."""
    of: dict[str, Counts] = {}
    filters = [Filter(x.value) if x else None for x in (words, pairs)]
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for one in sorted(set(lang)):
            rows = pa.array([i for i, x in enumerate(lang) if x == one], pa.int64())
            texts = (x.as_py() for x in batch.column(1).take(rows).cast(pa.binary()))
            state = of.get(one) or of.setdefault(one, Counts(one, *filters, part_bits))
            for part in chunks(texts):
                yield of, state, state.add(part)


def _n_names(of: dict[str, Counts]) -> int:
    """Words of all dictionaries; a language by itself takes as much as some words."""
    return sum(len(s.names) + 50 for s in of.values())


def _keep_only(of: dict[str, Counts], state: Counts) -> None:
    """Drop all other languages; the one that goes on keeps the words that its phrases go on from."""
    of.clear()
    of[state.lang] = state


def _counted(docs: DataFrame, words: Broadcast | None = None, pairs: Broadcast | None = None, part_bits: int = 0) -> DataFrame:
    """prefix, lang, phrase, f: runs of docs(lang, text), for words (and, as the phrase '', all their occurrences), or for phrases of two words or more whose pairs pass the filter."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Counts] = {}
        for of, state, _ in _over_texts(batches, words, pairs, part_bits):
            if sum(s.trie.size for s in of.values()) > ALL_FULL or _n_names(of) > VOCABULARY:
                for each in of.values():
                    yield from each.spill(0)
                _keep_only(of, state)
            elif state.trie.size > FULL:
                yield from state.spill(FULL // 2)
        for state in of.values():
            yield from state.spill(0)

    return in_batches(docs).mapInArrow(over, "prefix int, lang string, phrase string, f long")


def _pair_runs(docs: DataFrame, words: Broadcast, part_bits: int, least: int) -> DataFrame:
    """part, keys, counts: runs of the hashes of pairs of words that pass the filter."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = PairHashes(part_bits, least)
        for of, state, h in _over_texts(batches, words, None):
            found.add(h)
            if found.table.size > ALL_FULL:
                yield from found.spill()
            if _n_names(of) > VOCABULARY:
                state.clear()
                _keep_only(of, state)
        yield from found.spill()

    return in_batches(docs).mapInArrow(over, "part long, keys binary, counts binary")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of phrases with f of least or more, and of the empty phrase: the runs meet by their prefixes."""
    f = runs.repartition(shuffle_width(runs.sparkSession), "prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("f").alias("f"))
    return f.filter((F.col("f") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "f")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to 5 words that occur least times or more, and of the empty phrase, whose f is the number of all words of the lang."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words = materialize(_merged(_counted(texts), least), "words")
    n = words.filter("phrase = ''").agg(F.sum("f")).first()[0] or 0
    part_bits = min(30, max(6, (n // PART_WORDS).bit_length()))
    word_filter = send(make_filter(word_hashes(words.filter("phrase <> ''"))))
    pairs = materialize(frequent_hashes(_pair_runs(texts, word_filter, part_bits, least), least), "pairs")
    longer = materialize(_merged(_counted(texts, word_filter, send(make_filter(pairs)), part_bits), least), "longer")
    return words.unionAll(longer)


def _words(n: str) -> Column:
    """The first n words of the phrase, or the last if n is below 0."""
    return F.expr(f"substring_index(phrase, ' ', {n})")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact: products of up to 37 digits."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (whole(a) * whole(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language.

    Null texts and texts without words add nothing; a null lang is und, together
    with rows whose lang is that. Repeated rows count each; doc_id and other
    columns aren't looked at. Ties in score go by a, then by the phrase's bytes.
    A table without frequent phrases gives no rows.
    """
    f = frequent_phrases(docs, least)
    n = f.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    f = f.filter("phrase <> ''")
    size = F.size(F.split("phrase", " "))
    found = materialize(f.withColumn("size", size).filter("size > 1").withColumnRenamed("f", "a"), "candidates")

    # a longer phrase has a contained one in one of its own two parts with a word less, which occur at least as often
    inside = found.filter("size > 2").select("lang", F.explode(F.array(_words("size - 1"), _words("1 - size"))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = found.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").drop("longer")

    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": _words("k"), "rest": _words("k - size")})
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = join_params(cuts, n, ["lang"], "phrase")
    lowest = F.min(F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN))
    near = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", bucket).orderBy(*order))).filter(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (
  SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS part FROM d
), s AS (
  SELECT doc, lang, part, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM p
), w AS (
  SELECT doc, lang, part, unnest(words) AS w1, generate_subscripts(words, 1) AS place FROM s
), g AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY doc, part ORDER BY place)
), f AS (
  SELECT lang, w1 AS phrase, 1 AS size, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), alone AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f c
  WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = c.lang AND q.size > c.size AND q.f >= c.f AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT alone.*, k::INTEGER AS k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest FROM alone, range(1, 5) t(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, c.k, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN n ON n.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM lowest
QUALIFY rank <= {BEST}
"""
