"""Collocations, line dedup and the filter audit against plain versions, with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prismrank.llm import audit, collocations, lines

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "\n", "\n\n", ".", "Ä Ü", "a" * 5000, "x\ty\x00z x\ty", "one. two", "\x85 \xa0 ends"]
#: Columns whose names the operators might use themselves.
CLASHES = {"key": "1", "n": "2", "place": "3", "phrase": "'x'", "part": "'p'", "n_lines": "9", "fails": "0", "rank": "1", "f": "5"}


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(*r, None, None)[:4] for r in rows], DOCS)
    return df.selectExpr("*", *[f"{v} AS {c}" for c, v in CLASHES.items()]) if clash else df


# collocations


def phrases_of(rows, longest=5):
    f, n = Counter(), Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def collocated(rows, least, best):
    f, n = phrases_of(rows)
    found = {}
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in frequent.items():
        longer = (q for q in frequent if q[0] == lang and len(q) - 1 > len(w) and frequent[q] >= a)
        if any(w == list(q[1 + i : 1 + i + len(w)]) for q in longer for i in range(len(q) - len(w))):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:best]))


def corpus(seed, n=60):
    rng = random.Random(seed)
    fixed = ["new york city", "a b a b a", "é ü", "the end of the"]
    def text():
        return "".join(rng.choice([*fixed, "the", "X", "x", f"w{rng.randrange(30)}"]) + rng.choice([" "] * 6 + ["\t", ". ", ",", "\n", "\r", " ! "]) for _ in range(rng.randrange(0, 60)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"])) for i in range(n)]
    return rows + rows[:7] + [(1000 + i, t, "en") for i, t in enumerate(ODD)]


@pytest.mark.parametrize("seed", range(3))
def test_collocations_by_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in collocations.mine(table(spark, rows).repartition(3), least=6, best=25).collect())
    assert got == collocated(rows, 6, 25) and len(got) > 30


def test_collocations_of_many_languages(spark, monkeypatch):
    """A language each few texts, and dictionaries that are always full."""
    monkeypatch.setattr(collocations, "VOCABULARY", 120)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    rows = [(i, t, f"l{i % 25}" if i % 3 else "en") for i, t, *_ in corpus(8, 200)]
    texts = [(x[1] or "").encode() for x in rows]
    batch = pa.RecordBatch.from_pydict({"lang": [x[2] for x in rows], "text": [t.decode() for t in texts]})
    f, n = Counter(), Counter()
    of, most = {}, 0
    for of, state, _ in collocations._over_texts(iter([batch.slice(0, 90), batch.slice(90)]), None, None):
        most = max(most, len(of))
        if collocations._n_names(of) > 120:
            for each in of.values():
                for run in each.spill(0):
                    for r in run.to_pylist():
                        (f if r["phrase"] else n)[r["lang"], r["phrase"]] += r["f"]
            collocations._keep_only(of, state)
    for each in of.values():
        for run in each.spill(0):
            for r in run.to_pylist():
                (f if r["phrase"] else n)[r["lang"], r["phrase"]] += r["f"]
    want, total = phrases_of(rows, 1)
    assert f == want and {k: v for (k, _), v in n.items()} == {k: v for k, v in total.items() if v} and most < 6


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "x")]])
def test_collocations_of_little(spark, rows):
    assert collocations.mine(table(spark, rows), least=2).collect() == []


def test_words_across_chunks(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 7)
    texts = ["one two three. four", "", "a" * 30 + " b c", "é" * 9 + " d", "x, y"]
    parts = list(collocations.chunks(t.encode() for t in texts))
    assert len(parts) > 5
    whole = [w.decode() for p in parts for w in p]
    assert whole == [w for t in texts for w in t.replace(".", " . ").replace(",", " . ").split() + ["."]]


class All:
    def may_have(self, h):
        return np.ones(len(h), bool)


def test_phrases_go_on_from_chunk_to_chunk():
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b", b"c", b"."]) for _ in range(500)]

    def counted(sizes, full):
        state, total, at = collocations.Counts("en", All(), All(), 0), Counter(), 0
        for n in sizes:
            state.add(words[at : at + n])
            at += n
            for batch in state.spill(full) if state.trie.size > full else ():
                for r in batch.to_pylist():
                    total[r["phrase"]] += r["f"]
        for batch in state.spill(0):
            for r in batch.to_pylist():
                total[r["phrase"]] += r["f"]
        return total

    want = Counter()
    for piece in b" ".join(words).split(b"."):
        w = piece.decode().split()
        want.update(" ".join(w[i : i + k]) for k in (2, 3, 4, 5) for i in range(len(w) - k + 1))
    assert counted([500], 10**6) == want == counted([1] * 20 + [3] * 100 + [180], 10**6) == counted([10] * 50, 20)


def test_frequent_hashes_are_those_of_all_runs(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, 3000, np.uint64)
    drawn = [h[np.minimum(rng.geometric(0.002, 5000), 2999)] for _ in range(4)]
    runs = []
    for part in drawn:
        table = collocations.PairHashes(7, 20)
        table.add(part)
        table.add(part[:100])
        runs += [r for batch in table.spill() for r in batch.to_pylist()]
    df = spark.createDataFrame([tuple(r.values()) for r in runs], "part long, keys binary, counts binary")
    every = Counter((np.concatenate([*drawn, *(p[:100] for p in drawn)]) >> np.uint64(25)).tolist())
    assert {r["h"] for r in collocations.frequent_hashes(df, 20).collect()} == {x for x, n in every.items() if n >= 20}


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want = collocations.HatTrie(burst=50), Counter()
    for _ in range(20):
        w = rng.integers(1, 90, (300, 3))
        first, more = (w[:, 0] << 21 | w[:, 1]).astype(np.uint64), (w[:, 2] << 42).astype(np.uint64)
        trie.add(first, more, np.ones(300, np.int64))
        want.update(zip(first.tolist(), more.tolist(), strict=True))
    assert trie.size == len(want) and isinstance(trie.root, dict)
    got, seen = Counter(), set()
    for down_to in (len(want) // 2, 0):
        for first, more, n in trie.spill(down_to):
            digits = set((first >> np.uint64(21) & np.uint64(63)).tolist())
            assert len(digits) == 1 and not digits & seen
            seen |= digits
            got.update(dict(zip(zip(first.tolist(), more.tolist(), strict=True), n.tolist(), strict=True)))
        assert trie.size <= down_to
    assert got == want


def test_filter_loses_nothing(spark):
    phrases = [f"w{i}" for i in range(900)]
    words = spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string")
    made = collocations.Filter(collocations.make_filter(collocations.word_hashes(words)))
    h = lambda lang: np.array([collocations.word_hash(lang, p.encode()) for p in phrases], np.uint64)
    assert made.may_have(h("en")).all() and made.may_have(h("de")).mean() < 0.05


# lines


def deduped(rows, least_chars, least_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    ids = {}
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            ids.setdefault(key(x), set()).add(i)
    lost = {k: max((i for i in s if i is not None), default=None) for k, s in ids.items() if len(k) >= least_chars and len(s) >= least_docs}
    out = []
    for i, text, *_ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if key(x) not in lost or lost[key(x)] == i]
        out.append((str(i), len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "least_docs", "hot"), [(1, 3, 10_000), (2, 2, 5), (3, 4, 1)])
def test_lines_by_brute_force(spark, monkeypatch, seed, least_docs, hot):
    """With many, few and one hot keys: both joins."""
    monkeypatch.setattr(lines, "HOT_KEYS", hot)
    rng = random.Random(seed)
    some = ["Menu of the Page", " menu of the page\t", "MENU OF THE PAGE\r", "Éa line with accents", "éa line with accents", "short", "", *[f"this is line {i}" for i in range(8)]]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(some) for _ in range(rng.randrange(0, 9)))) for _ in range(60)]
    rows += rows[:5] + [(500 + i, t) for i, t in enumerate(ODD)] + [(600, "Menu of the Page\n" * 300)]
    got = lines.drop_shared_lines(table(spark, rows).repartition(3), 10, least_docs)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == deduped(rows, 10, least_docs)
    assert set(got.columns) == {*table(spark, []).columns, "n_lines", "n_dropped"}
    digests = {r["kept_sha256"] for r in lines.digest(got).collect()}
    assert digests == {hashlib.sha256(t.encode()).hexdigest() for *_, t in deduped(rows, 10, least_docs)}


def test_lines_of_nothing(spark):
    assert lines.drop_shared_lines(table(spark, [])).collect() == []
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_shared_lines(table(spark, [(None, None)])).collect()] == [(1, 0, "")]


# audit


def audited(rows, labels):
    def fails(row):
        i, text = row[0], row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yes = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        yes["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        return {f for f, x in yes.items() if x}

    of = {}
    for i, good, toxic in labels:
        a, b = of.get(i, (0, 0))
        of[i] = max(a, int(good == 1)), max(b, int(toxic == 1))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    out = {((r[3] or ""), o, s): dict.fromkeys(names, 0) for r in rows for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6)}
    for r in rows:
        bad, (good, toxic) = fails(r), of.get(r[0], (0, 0)) if r[0] is not None else (0, 0)
        for o in map("".join, itertools.permutations("ABCDE")):
            there = True
            for s, f in enumerate(o, 1):
                x = out[r[3] or "", o, s]
                x["unique_fails"] += bad == {f}
                if f in bad:
                    x["removed"] += there
                    x["good_lost"] += there * good
                    x["toxic_lost"] += there * toxic
                    x["redundant"] += not there
                    there = False
                x["kept"] += there
    shapley = Counter()
    for (part, o, s), x in out.items():
        shapley[part, o[s - 1]] += x["removed"]
    return {k: (*x.values(), shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_audit_by_brute_force(spark):
    rng = random.Random(4)
    def text():
        words = [rng.choice(["Word", "word", "x", f"w{rng.randrange(200)}"]) for _ in range(rng.choice([3, 49, 50, 51, 90]))]
        return " ".join(words) + rng.choice(["", "", " #", " CAPITAL LETTERS HERE"])
    texts = [text() for _ in range(12)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), "en", rng.choice(["a", "b", None, ""])) for _ in range(50)]
    rows += rows[:6] + [(700 + i, t, "en", "odd") for i, t in enumerate(ODD)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(25)]
    found = audit.interactions(table(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert got == audited(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(table(spark, []), labels).collect() == []
    assert audit.interactions(table(spark, [(None, None)]), labels).count() == 600
