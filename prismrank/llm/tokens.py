"""Token ids by the tokenizers library, with a cache of what it gives for whole words.

Both vocabularies that are used split a text into words before anything else,
and a single space between two characters that aren't white space always is
such a border. So a text is the sequence of its space-separated chunks, and
the ids of a chunk depend on nothing outside it. Chunks repeat a great deal;
those seen are looked up, the others go to the library. A text in which spaces
meet other white space, or that has the string of a special token, goes to the
library whole: ids are always those of the library's default settings.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Hashable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

#: Chunks that the cache holds at most, and words, which chunks end otherwise or follow a line feed, too; beyond, it begins anew. About 400 bytes each.
CACHE, WORDS = 500_000, 500_000
#: Characters of the texts that are looked up at once.
AT_ONCE = 1_000_000
#: A word of letters whose case and composition no normaliser changes beyond a simple lower-casing, and marks after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
#: Numbers of what isn't a chunk by itself and of no ids.
_ODD, _NONE = 0, 1


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    shown = set(chain(range(33, 127), range(161, 173), range(174, 256)))
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Encoder:
    """encode(texts): all their ids one after another, and where each text's end.

    number: of each known chunk, by the chunk, or for a text's first, which no
    space precedes, by a space and the chunk; ends, ids: where the ids of
    the chunks of each number end, and the ids; led, bare: ids of words and marks
    that a space precedes and that none does.
    """

    def __init__(self, path: str, cache: int = CACHE, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if not t.normalized] + [""] * any(t.normalized for t in added)
        self.spaced = self.library.normalizer is None
        self.table = _byte_chars()
        self.lead = self.table[32]
        self.feed = self._library(["\n"])[0]  # nothing where white space is dropped
        self.cache, self.most_words = cache, words
        self.led: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[Hashable, int] = {}
        self.ids, self.ends = bytearray(), array("q", [0, 0, 0])

    def _add(self, key: Hashable, ids: bytes) -> None:
        self.number[key] = len(self.ends) - 1
        self.ids += ids
        self.ends.append(len(self.ids) >> 2)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, word: str, lead: str, known: dict[str, bytes]) -> bytes:
        """The ids of a plain word, or of marks, by the library's model alone."""
        if len(known) >= self.most_words:
            known.clear()
        shown = word if self.spaced else word.lower()
        if not shown.isascii():
            shown = "".join([self.table[b] for b in shown.encode()])
        ids = known[word] = array("I", [t.id for t in self.model.tokenize(lead + shown)]).tobytes()
        return ids

    def _lines(self, chunk: str, lead: str) -> bytes | None:
        """The ids of lines of a plain word and marks each, else None."""
        out, known, bare = [], self.led if lead else self.bare, self.bare
        for i, line in enumerate(chunk.split("\n")):
            m = _PLAIN.fullmatch(line)
            if not m or i and self.spaced and not line:
                return None
            if i:
                lead, known = "", bare
                out.append(self.feed)
            word, marks = m.groups()
            if word:
                out.append(known.get(word) or self._model(word, lead, known))
                lead, known = "", bare
            if marks:
                out.append(known.get(marks) or self._model(marks, lead, known))
        return b"".join(out)

    def _fill(self, chunks: set[str]) -> None:
        slow, lead = [], self.lead if self.spaced else ""
        known, bare = self.led if lead else self.bare, self.bare
        for c in chunks:
            if m := _PLAIN.fullmatch(c):
                word, marks = m.groups()
                if word:
                    ids = known.get(word) or self._model(word, lead, known)
                    if marks:
                        ids += bare.get(marks) or self._model(marks, "", bare)
                    self._add(c, ids)
                elif marks or not lead:
                    self._add(c, (known.get(marks) or self._model(marks, lead, known)) if marks else b"")
                else:
                    self.number[c] = _ODD
                continue
            first = lead and c[0] == " "  # of a text
            if lead and (c[-1].isspace() and len(c) > 1 or not first and c[0].isspace()):
                self.number[c] = _ODD
            elif (ids := self._lines(c[1:], "") if first else self._lines(c, lead)) is not None:
                self._add(c, ids)
            else:
                slow.append((c, c[1:] if first else " " + c if lead else c))
        for (c, _), ids in zip(slow, self._library([s for _, s in slow]), strict=True):
            self._add(c, ids)

    def _split(self, text: str) -> list[str]:
        if self.spaced:
            first, *more = text.split(" ")
            return [" " + first, *more]
        try:  # letters of Latin-1 are lower-cased one by one and are composed already
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")  # white space of any kind only separates here

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, with the end id after each, as unsigned 32-bit integers, and where each text's end among them."""
        parts, now, size = [], [], 0
        for text in texts:
            now.append(text)
            size += len(text)
            if size > AT_ONCE:
                parts.append(self._encode(now, end))
                now, size = [], 0
        parts.append(self._encode(now, end))
        before = np.cumsum([0, *[len(ids) for ids, _ in parts]])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([ends + b for (_, ends), b in zip(parts, before, strict=False)])

    def _encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.cache:
            self._clear()
        if end is not None and (end,) not in self.number:
            self._add((end,), array("I", [end]).tobytes())
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        flat: list[Hashable] = []
        borders = [0]
        for i, t in enumerate(texts):
            flat += self._split("" if i in whole else t)
            if end is not None:
                flat.append((end,))
            borders.append(len(flat))
        at = np.array(borders)
        number = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        self._fill({flat[i] for i in missing})
        number[missing] = [self.number[flat[i]] for i in missing]
        odd = np.searchsorted(at, np.flatnonzero(number == _ODD), "right") - 1
        known, known_ids = len(self.ends), len(self.ids)
        taken = sorted(whole.union(odd.tolist()))
        for i, ids in zip(taken, self._library([texts[i] for i in taken]), strict=True):
            number[at[i] : at[i + 1] - (end is not None)] = _NONE
            number[at[i]] = len(self.ends) - 1
            self.ids += ids
            self.ends.append(len(self.ids) >> 2)
        ends = np.frombuffer(self.ends, np.int64)
        first = ends[number]
        size = ends[number + 1] - first
        upto = np.cumsum(size)
        out = np.frombuffer(self.ids, np.uint32)[np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)] if len(self.ids) else np.zeros(0, np.uint32)
        del ends
        del self.ends[known:], self.ids[known_ids:]
        return out, np.concatenate([[0], upto])[at[1:]]


@lru_cache(maxsize=4)
def encoder(path: str, cache: int = CACHE, words: int = WORDS) -> Encoder:
    """One encoder for each vocabulary and worker; its size is a matter of memory alone."""
    return Encoder(path, cache, words)
