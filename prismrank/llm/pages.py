"""Main text of web pages by nearest-URL page differencing.

A page's template shows in the pages beside it. Within each host the pages are
ordered by the path of their URL, and each is held against the neighbour, before
or after, that shares more of the path, or against the other if these two have no
line in common. All their lines of text are aligned by longest common
subsequence and the lines that both have are deleted, except lines inside an
article or main element, which a neighbour may well repeat (another version of
the same story). Of what differs, only lines go that the page itself marks as no
main text (menus, headers, footers, sidebars, notices, adverts, forms, comments);
scripts and styles aren't text at all.

Pages are sorted into ranges of (host, path, page_id, place in the table); the
last page of a range is also sent to the next and the first to the one before, so
neighbours are the same however the pages are dealt out, and a host or a path of
any size spreads over tasks.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, shuffle_width, spread

#: Rows of the sample for each range, taken by hash, that sets the ranges' borders; results don't depend on it.
SAMPLE_ROWS = 50

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|<[?!][^<>]*+>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)(.*?)/?>\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_RAW = re.compile(r"<!--|<(script|style|noscript|template|iframe|svg|math|textarea|select|object|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("nav footer aside form menu head button dialog".split())
_MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that mark what isn't main text.
_MARKED = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside complementary banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup disqus respond share sharing social search login pagination pager skip contentinfo alert toolbar masthead widget".split())
#: Those that also tell of an article or main element that it isn't the page's own.
_ASIDE = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments replies reply related recommended teaser".split())
#: Words beside them in a name that tells of a state, as in has-sidebar.
_STATE = frozenset("has with no without not is".split())
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
#: What a line is: text, text of an article or main element, or marked as no main text.
PLAIN, MAIN, MARKED = 0, 1, 2
# how an element's marks hold inside it: not, unless an article or main element begins, throughout
_OPEN, _LAYOUT, _OUT = 0, 1, 2


def _without_raw(page: str) -> str:
    """The page without comments and without elements whose content isn't text, in one pass."""
    out, at, endless = [], 0, set()
    while m := _RAW.search(page, at):
        out.append(page[at : m.start()])
        name = (m[1] or "").lower()
        if not name:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        out.append(" ")
        if m[0].endswith("/>") and (name in ("svg", "math") or name in endless):
            at = m.end()
            continue
        end = None if name in endless else re.compile(rf"</{name}\s*+>", re.I).search(page, m.end())
        if end:
            at = end.end()
        else:
            endless.add(name)
            at = m.end() if m[0].endswith("/>") else len(page)
    return "".join([*out, page[at:]])


def _named(values: str, marks: frozenset[str]) -> bool:
    """Whether a name among the values of class, id and role has a word of marks and none of a state."""
    for name in values.split():
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if words & marks and not words & _STATE:
            return True
    return False


def _held(name: str, rest: str, now: int) -> int:
    """How marks hold inside an element, given how they hold around it."""
    if now == _OUT:
        return now
    values, hidden = [], False
    for key, *value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(value)
        if key in ("class", "id", "role"):
            values.append(value)
        hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in _SPACE.sub("", value).lower()
    named = " ".join(values)
    if hidden or name in _NEVER or name not in ("html", "body") and _named(named, _ASIDE):
        return _OUT
    if name in _MAIN:
        return _OPEN
    return _LAYOUT if name not in ("html", "body") and _named(named, _MARKED) else now


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, PLAIN, MAIN or MARKED) of each block of a page, in order.

    White space inside a block is one space; character references are decoded
    after the markup is gone, so text that spells tags stays text.
    """
    page = _without_raw(page)
    found: list[tuple[str, int]] = []
    open_: list[tuple[str, int, bool]] = [("", _OPEN, False)]  # element, how marks hold inside it, whether inside it is main
    count: Counter[str] = Counter()
    parts: list[str] = []
    marked: list[str] = []  # an advert amid a line is a line of its own
    at = 0

    def flush() -> None:
        for some, kind in ((parts, MAIN if open_[-1][2] else PLAIN), (marked, MARKED)):
            text = _SPACE.sub(" ", html.unescape("".join(some))).strip()
            some.clear()
            if text:
                found.append((text, kind))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            (marked if open_[-1][1] else parts).append(page[at : m.start()])
        at = m.end()
        tag = _TAG.match(m[0])
        if not tag:
            continue
        closes, name, rest = tag[1], tag[2].lower(), tag[3]
        if name in _BLOCK:
            flush()
        if closes:
            while count[name]:
                gone = open_.pop()[0]
                count[gone] -= 1
                if gone == name:
                    break
        elif name not in _VOID:
            if name in ("p", "li", "td", "tr", "dd", "dt", "option") and open_[-1][0] == name:
                open_.pop()
                count[name] -= 1
            _, held, main = open_[-1]
            open_.append((name, _held(name, rest, _OUT if name == "header" and not main else held), main or name in _MAIN))
            count[name] += 1
    (marked if open_[-1][1] else parts).append(page[at:])
    flush()
    return found


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Places in mine of a longest common subsequence of the two, by Hunt and Szymanski's way: common ends first, then the longest chain of matches."""
    a, b = 0, 0
    while a < len(mine) and a < len(other) and mine[a] == other[a]:
        a += 1
    while b < len(mine) - a and b < len(other) - a and mine[-1 - b] == other[-1 - b]:
        b += 1
    shared = {*range(a), *range(len(mine) - b, len(mine))}
    where: dict[int, list[int]] = {}
    for j in range(a, len(other) - b):
        where.setdefault(other[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(a, len(mine) - b):
        for j in reversed(where.get(mine[i], ())):
            k = bisect_right(tails, j - 1)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_deleted", pa.int32()), ("n_marked", pa.int32())])
_LINES = pa.schema([("bucket", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()), ("row", pa.int64()), ("url", pa.string()), ("own", pa.bool_()), ("lines", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])
_LEAST_ID = -(1 << 63)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_blocks, n_deleted (lines shared with the neighbour) and n_marked (other lines marked as no main text) of pages(page_id, url, html, ...).

    A null html is empty and gives an empty text; a null or odd URL counts as
    a path without host; repeated rows are each other's neighbours and lose
    nothing inside article or main elements; a page whose neighbour has the
    same lines throughout is a copy, not a template, and loses marked lines
    only. Other columns are ignored; no rows give none.
    """
    spark = pages.sparkSession
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.concat_ws("\x00", F.coalesce(F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", ""), F.lit("")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.col("url"), F.lit("")))
    keyed = given.withColumn("key", key).withColumn("row", F.monotonically_increasing_id())
    order = ["key", "page_id", "row"]
    wanted = 4 * shuffle_width(spark)
    every = max(1, pages.count() // (SAMPLE_ROWS * wanted))
    place = lambda k, p, r: (k, _LEAST_ID if p is None else p, r)
    sample = sorted(place(*r) for r in keyed.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).collect())  # about SAMPLE_ROWS a range
    borders = [sample[i * len(sample) // wanted] for i in range(1, wanted)] if sample else []

    def bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = [bisect_right(borders, place(*r)) for r in zip(*[batch.column(c).to_pylist() for c in order], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "bucket"])

    ends = keyed.select(*order).mapInArrow(bucket, "key string, page_id long, row long, bucket int").groupBy("bucket").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    bounds = {r["bucket"]: (place(*r["first"]), place(*r["last"])) for r in ends.collect()}  # as many as there are ranges
    used = sorted(bounds)
    before, after = dict(zip(used[1:], used, strict=False)), dict(zip(used, used[1:], strict=False))

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for p, url, page, k, r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = place(k, p, r)
                b = bisect_right(borders, at)
                found = blocks(page)
                row = {"bucket": b, "key": k, "page_id": p, "row": r, "url": url, "own": True, "lines": [t for t, _ in found], "kinds": [m for _, m in found]}
                out.append(row)
                first, last = bounds[b]
                if at == first and b in before:
                    out.append(row | {"bucket": before[b], "own": False})
                if at == last and b in after:
                    out.append(row | {"bucket": after[b], "own": False})
            yield pa.RecordBatch.from_pylist(out, schema=_LINES)

    def nearest(near: list[dict | None], row: dict) -> list[dict]:
        host = row["key"].split("\x00")[0]
        found = [n for n in near if n is not None and n["key"].split("\x00")[0] == host]
        return sorted(found, key=lambda n: -_common(n["key"], row["key"]))  # of equals the one before comes first

    def clean(row: dict, near: list[dict]) -> dict:
        lines, kinds = row["lines"], row["kinds"]
        gone: set[int] = set()
        for other in near:
            if lines == other["lines"]:
                continue
            number: dict[str, int] = {}
            mine, theirs = ([number.setdefault(t, len(number)) for t in r["lines"]] for r in (row, other))
            if shared := shared_lines(mine, theirs):
                gone = {i for i in shared if kinds[i] != MAIN}
                break
        marked = {i for i, kind in enumerate(kinds) if kind == MARKED} - gone
        left = [t for i, t in enumerate(lines) if i not in gone and i not in marked]
        return {"page_id": row["page_id"], "url": row["url"], "text": "\n".join(left), "n_blocks": len(lines), "n_deleted": len(gone), "n_marked": len(marked)}

    def difference(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = now = None  # the row before and the row in hand, of the same range
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                if now is not None:
                    same = row["bucket"] == now["bucket"]
                    if now["own"]:
                        out.append(clean(now, nearest([last, row if same else None], now)))
                    last, now = (now if same else None), row
                else:
                    now = row
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
        if now is not None and now["own"]:
            yield pa.RecordBatch.from_pylist([clean(now, nearest([last], now))], schema=_RESULT)

    # the rows' places are set before any dealing, so both passes agree on them
    parsed = spread(keyed).transform(in_batches).mapInArrow(parse, "bucket int, key string, page_id long, row long, url string, own boolean, lines array<string>, kinds array<byte>")
    dealt = parsed.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", *order)
    return dealt.mapInArrow(difference, "page_id long, url string, text string, n_blocks int, n_deleted int, n_marked int")
