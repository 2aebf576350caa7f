"""License scanning by ordered signature rules, in DataFrame expressions alone.

A text becomes its words, lower-cased and joined by single spaces. A rule is a
regular expression over them with a keyword: it runs only where the keyword
stands. What it finds is an interval of words with a label, a priority and a
confidence. An interval inside another of higher priority, or of the same and
longer, is suppressed, so that "apache license version 2 0" isn't reported as
a bare "apache license" besides. Nothing is shuffled: each row is looked
through by itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import text_of

#: A word, where only A to Z are to be lower-cased, and where they have been.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    keyword: str
    pattern: str
    label: str
    priority: int
    confidence: float
    base: bool = False


#: Phrases whose places are counted; never suppressed.
BASE = (
    Rule("mit license", "mit license", "mit", 50, 0.9, True),
    Rule("apache license", "apache license", "apache", 50, 0.9, True),
    Rule("general public license", "general public license", "gpl", 50, 0.9, True),
)

#: label stem, keyword, name as an expression, versions (each in words; the label gets them joined by dots)
FAMILIES = (
    ("apache", "apache", "apache(?: software)?(?: foundation)?", ("2 0", "1 1", "1 0")),
    ("gpl", "general public", "(?:gnu )?general public", ("3 0", "3", "2 0", "2", "1")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("3 0", "3", "2 0", "2", "1")),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", ("3 0", "3", "2 1", "2")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("3 0", "3", "2 1", "2")),
    ("agpl", "affero", "(?:gnu )?affero general public", ("3 0", "3", "1 0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("3 0", "3")),
    ("gfdl", "free documentation", "(?:gnu )?free documentation", ("1 3", "1 2", "1 1")),
    ("mpl", "mozilla", "mozilla public", ("2 0", "1 1", "1 0")),
    ("mpl", "mpl", "mpl", ("2 0", "1 1", "1 0")),
    ("epl", "eclipse", "eclipse public", ("2 0", "1 0")),
    ("cddl", "common development", "common development and distribution", ("1 1", "1 0")),
    ("eupl", "european union", "european union public", ("1 2", "1 1")),
    ("osl", "open software", "open software", ("3 0", "2 1", "2 0")),
    ("afl", "academic free", "academic free", ("3 0", "2 1")),
    ("artistic", "artistic", "artistic", ("2 0", "1 0")),
    ("bsl", "boost", "boost software", ("1 0",)),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd", ("4 clause", "3 clause", "2 clause", "0 clause")),
    ("mit", "mit", "mit(?: x11)?(?: expat)?", ("0",)),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib(?: libpng)?", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "do what the", "do what the f[a-z]* you want to public", ("2",)),
    ("ofl", "open font", "(?:sil )?open font", ("1 1", "1 0")),
    ("odbl", "open database", "open database", ("1 0",)),
    ("odc-by", "open data commons", "open data commons attribution", ("1 0",)),
    ("ms-pl", "microsoft public", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ()),
    ("python", "python", "python(?: software foundation)?", ("2 0", "2")),
    ("php", "php", "php", ("3 01", "3 0")),
    ("ruby", "ruby", "ruby", ()),
    ("openssl", "openssl", "openssl", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("cecill", "cecill", "cecill(?: [bc])?", ("2 1", "2 0", "1 0")),
    ("bsl-1", "business source", "business source", ("1 1", "1 0")),
    ("sspl", "server side public", "server side public", ("1",)),
    ("elastic", "elastic", "elastic", ("2 0",)),
    ("openrail", "rail", "(?:creativeml )?open ?rail(?: m)?", ()),
    ("llama", "llama", "llama [0-9 ]*community", ()),
)

#: Creative Commons: the clauses in words and as names.
CC = (
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nd", "attribution no ?deriv[a-z]*"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv[a-z]*"),
)
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")

#: Wording of licenses themselves and notices, not their names.
WORDINGS = (
    Rule("hereby granted free", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 90, 0.95),
    Rule("binary forms", "redistribution and use in source and binary forms", "bsd", 90, 0.95),
    Rule("with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", "isc", 90, 0.95),
    Rule("public domain", "free and unencumbered software released into the public domain", "unlicense", 90, 0.95),
    Rule("public domain", "(?:released|dedicated|placed|put)(?: in)?(?:to)?(?: in)? the public domain", "public-domain", 60, 0.8),
    Rule("free software", "this program is free software you can redistribute it and or modify it", "gpl", 90, 0.95),
    Rule("without express or implied warranty", "provided as is without express or implied warranty", "zlib", 40, 0.5),
    Rule("all rights reserved", "all rights reserved", "proprietary", 30, 0.5),
    Rule("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 70, 0.9),
)

GRANT = "(?:licensed|released|distributed|published|available|provided|covered|shared|made available) (?:to you )?(?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: terms of)?"
NAMED = "(?: public)? licen[cs]e"


VERSION = "(?: as published by the free software foundation)?(?: either)?(?: version| v)?(?: v)? ?"


def _gate() -> str:
    """What a text that any rule matches has, as an expression over the text itself: license, a wording's keyword, a Creative Commons name, or a family's name with a version."""
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    names = f"(?:{'|'.join(name for _, _, name, versions in FAMILIES if versions)}){VERSION}[0-9]"
    words = "|".join(sorted({r.keyword for r in WORDINGS} | {"cc by", "creative commons"}))
    phrases = f"(?:{names}|{words})".replace(" ?", f"{between}*").replace(" ", f"{between}+")
    return f"(?i)licen[cs]e|(?<!{WORD.removesuffix('+')}){phrases}"


def _versioned(stem: str, version: str) -> str:
    return f"{stem}-{version.replace(' clause', '-clause').replace(' ', '.')}"


def signature_rules() -> tuple[Rule, ...]:
    """The ordered rules: for each name a grant, a title and a declared identifier, with each version and without."""
    rules = [*BASE, *WORDINGS]
    for stem, keyword, name, versions in FAMILIES:
        for v in versions:
            ver = f"{VERSION}{v}"
            rules += [
                Rule(keyword, f"{GRANT} {name}(?:{NAMED})?{ver}", _versioned(stem, v), 80, 1.0),
                Rule(keyword, f"{name}(?:{NAMED})?{ver}", _versioned(stem, v), 70, 0.9),
                Rule(keyword, f"spdx license identifier {name} {v}(?: only| or later)?", _versioned(stem, v), 100, 1.0),
            ]
            if v.endswith("clause"):
                rules.append(Rule(keyword, f"{v} {name}{NAMED}", _versioned(stem, v), 75, 0.95))
        rules += [
            Rule(keyword, f"{GRANT} {name}(?:{NAMED})", stem, 60, 0.9),
            Rule(keyword, f"{name}{NAMED}", stem, 45, 0.8),
            Rule(keyword, f"spdx license identifier {name}", stem, 65, 0.95),
        ]
    for clauses, words in CC:
        short = clauses.replace("-", " ")
        for v in CC_VERSIONS:
            label = f"cc-{clauses}-{v.replace(' ', '.')}"
            rules.append(Rule("cc by", f"(?:{GRANT} )?cc {short} {v}", label, 80, 1.0))
            rules.append(Rule("creative commons", f"(?:{GRANT} )?creative commons {words} {v}", label, 80, 1.0))
        rules.append(Rule("cc by", f"cc {short}", f"cc-{clauses}", 55, 0.8))
        rules.append(Rule("creative commons", f"creative commons {words}", f"cc-{clauses}", 55, 0.8))
    return tuple(rules)


_HIT = "array<struct<start:bigint,end:bigint,label:string,priority:int,confidence:double,base:boolean>>"
#: Put before a match to find its first word again; no word has it.
_MARK = "\x01"


def _found(norm: Column, rule: Column) -> Column:
    """Intervals of words of the rule's matches. Each match is marked in the text, so the marked words' places and the matches come in the same order."""
    around = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    matches = F.regexp_extract_all(norm, around, F.lit(0))
    words = F.split(F.regexp_replace(norm, around, F.lit(f"{_MARK}$0")), " ")  # the first is before the text's first space
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)), lambda i: i.isNotNull())
    hits = F.transform(
        F.arrays_zip(starts.alias("s"), matches.alias("m")),
        lambda x: F.struct(
            x["s"].cast("bigint").alias("start"),
            (x["s"] + F.length(x["m"]) - F.length(F.replace(x["m"], F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("end"),
            rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["base"].alias("base"),
        ),
    )
    return F.when(F.rlike(norm, around), hits.cast(_HIT)).otherwise(F.from_json(F.lit("[]"), _HIT))


def _suppressed(found: str, n_words: str) -> Column:
    """Those of the hits, sorted, that no other contains with a higher priority or, of equal priority, by being longer.

    A hit that contains another begins at most as many words before it as the
    longest has, and those are a slice of the sorted hits, found by how many
    begin before each word: in the sorted list of hits and words, a word's place
    less its number.
    """
    start = lambda s, kind: F.struct(s.cast("bigint").alias("at"), F.lit(kind).alias("kind"))
    marks = F.array_sort(F.concat(F.transform(found, lambda x: start(x["start"], 1)), F.transform(F.sequence(F.lit(0), F.col(n_words) + 1), lambda w: start(w, 0))))
    before = F.transform(F.filter(F.transform(marks, lambda m, i: F.when(m["kind"] == 0, i)), lambda i: i.isNotNull()), lambda i, w: i - w)
    longest = F.array_max(F.transform(found, lambda x: x["end"] - x["start"]))

    def above(x: Column, y: Column) -> Column:
        longer = (y["priority"] == x["priority"]) & (y["end"] - y["start"] > x["end"] - x["start"])
        return (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["priority"] > x["priority"]) | longer)

    def beside(x: Column, at: Column) -> Column:
        low = F.get(at["before"], F.greatest(x["start"] - at["longest"], F.lit(0)).cast("int"))
        return F.slice(found, low + 1, F.get(at["before"], (x["start"] + 1).cast("int")) - low)

    # the counts are made once for a text, as an array of one that a lambda goes over
    once = F.array(F.struct(before.alias("before"), longest.alias("longest")))
    kept = F.flatten(F.transform(once, lambda at: F.filter(found, lambda x: ~F.exists(beside(x, at), lambda y: above(x, y)))))
    return F.when(F.size(found) > 1, kept).otherwise(F.col(found))


#: No signature rule can match a text without this.
GATE = _gate()


def scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words and the detections of documents(doc_id, text, ...).

    found has every interval (start, end, label, priority, confidence, base),
    kept those not suppressed; ends are exclusive. A null or empty text has no
    words and none; repeated rows are scanned each; other columns are ignored.
    """
    table = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base")) for r in rules or signature_rules()])
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    words = text.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(GATE) if rules is None else F.lit(True), F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LOWER_WORD), F.lit(0)), " "), F.lit(" "))).alias("norm"))
    gated = F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))
    found = F.array_sort(F.flatten(F.transform(gated, lambda r: _found(F.col("norm"), r))))
    hits = words.select("doc_id", "n_words", F.coalesce(F.when(F.col("norm").isNotNull(), found), F.from_json(F.lit("[]"), _HIT)).alias("found"))
    return hits.withColumn("kept", _suppressed("found", "n_words"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and places of the base phrases, labels and the surest detection's confidence."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    base_labels = F.transform(base, lambda x: x["label"])
    labels = F.concat(base_labels, F.transform("kept", lambda x: x["label"]))
    sure = F.transform(F.concat(base, F.col("kept")), lambda x: x["confidence"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )
