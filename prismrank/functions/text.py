"""Answer and passage text as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ARTICLES = r"(?U)\b(a|an|the)\b"


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's too, become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def normalize_answer(c: Column) -> Column:
    """Lower case, then articles, then ASCII punctuation, then white space."""
    return squeeze(F.translate(F.regexp_replace(F.lower(c), _ARTICLES, " "), PUNCTUATION, ""))


def normalize_answer_official(c: Column) -> Column:
    """Lower case, then ASCII punctuation, then articles, then white space: "a-b" differs from the other order."""
    return squeeze(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), _ARTICLES, " "))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def answer_words(c: Column, normalize=normalize_answer) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def token_f1(p: Column, g: Column) -> Column:
    """F1 of two arrays of words as multisets; two empty ones match fully, one empty one not at all. The arrays should be columns already, or each word would normalise the text again."""
    least = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * least / (F.size(p) + F.size(g)))


def official_f1(p: Column, g: Column) -> Column:
    """token_f1 of officially normalised words, where yes, no and noanswer only match themselves."""
    fixed = lambda w: (F.size(w) == 1) & w[0].isin("yes", "no", "noanswer")
    return F.when((fixed(p) | fixed(g)) & (p != g), 0.0).otherwise(token_f1(p, g))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of an integer."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(p: pd.Series, g: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two arrays of words; 0 if either is empty. Spark's functions have no such table in linear memory."""
    return pd.Series([2.0 * longest_common(list(a), list(b)) / (len(a) + len(b)) if a is not None and b is not None and len(a) and len(b) else 0.0 for a, b in zip(p, g, strict=True)], dtype="float64")


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")


def parse_line(c: Column, field: str, allowed: list[str] | None = None) -> Column:
    """The value of the only line "field: value", else null. Of allowed values, if they are given (in lower case), the one it is in any case."""
    found = F.regexp_extract_all(line_feeds(c), F.lit(rf"(?md)^{field}:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    value = F.when(F.size(found) == 1, F.nullif(found[0], F.lit("")))
    return F.when(F.lower(strip(value)).isin(allowed), F.lower(strip(value))) if allowed else value


def parse_whole(c: Column, field: str) -> Column:
    """The rest of a text that begins with "field:", else null."""
    return F.nullif(F.regexp_extract(c, rf"(?is)\A\s*{field}:[ \t]*(.*?)\s*\z", 1), F.lit(""))


#: What an answer that refuses begins with, in any case and after white space.
REFUSALS = (
    r"i\s+(?:cannot|can't|am\s+unable\s+to|won't)\s+(?:answer|provide\s+an\s+answer|help)",
    r"i\s+(?:must|have\s+to)\s+(?:decline|refuse)",
    r"sorry,?\s+i\s+(?:cannot|can't|am\s+unable\s+to)\s+(?:answer|help)",
)


def is_refusal(c: Column) -> Column:
    return c.rlike(rf"(?isU)\A\s*(?:{'|'.join(REFUSALS)})")


def classify_response(error: Column, finish_reason: Column, text: Column, parsed: Column, refused: Column | None = None) -> Column:
    """ERROR, TRUNCATED, REFUSAL (by the provider's word or the text's), PARSE_FAILURE or OK; the first that holds.

    An error that comes with a text, and no error without one, contradict
    themselves and are errors when they are read.
    """
    truncated = F.lower(strip(finish_reason)).isin("length", "max_tokens", "max_output_tokens", "token_limit")
    by_provider = F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))
    against = F.when(error.isNotNull() & text.isNotNull(), "an error with a response's text").when(error.isNull() & text.isNull(), "a response without text")
    status = F.when(error.isNotNull(), "ERROR").when(truncated, "TRUNCATED").when(by_provider | is_refusal(text), "REFUSAL").when(parsed.isNull(), "PARSE_FAILURE").otherwise("OK")
    return F.when(against.isNotNull(), F.raise_error(against)).otherwise(status)


#: Abbreviations after which a sentence goes on, and signs around a word that don't belong to it.
ABBREVIATIONS = ["e.g.", "i.e.", "dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "vs.", "etc.", "fig.", "eq.", "no.", "nos.", "st.", "mt."]
AROUND = "*_`\"“”'‘’()[]{}"
_AROUND = AROUND.replace("[", "\\[").replace("]", "\\]")
#: A separator of information, which counts as white space and so isn't in a squeezed text.
_BREAK = "\x1e"


def sentences(c: Column) -> Column:
    """Sentences of a text; a piece that ends in an abbreviation or in initials goes on with the next. Work grows with the text, as pieces are joined all at once."""
    pieces = F.filter(F.split(squeeze(c), r"(?<=[.!?]) (?=\S)"), lambda s: s != "")
    last = lambda s: F.lower(F.regexp_replace(F.substring_index(s, " ", -1), f"^[{_AROUND}]+|[{_AROUND}]+$", ""))
    goes_on = lambda w: w.isin(ABBREVIATIONS) | w.rlike(r"^(?:[a-z]\.)+$")
    joined = F.array_join(F.transform(pieces, lambda s: F.concat(s, F.when(goes_on(last(s)), F.lit(" ")).otherwise(F.lit(_BREAK)))), "")
    return F.filter(F.transform(F.split(joined, _BREAK), lambda s: F.trim(s)), lambda s: s != "")


def retrieval_content(title: Column, text: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def context_block(passages: Column) -> Column:
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def split_context(c: Column, n: int | None = None) -> Column:
    """The documents of a context; with n, other than n documents, numbered from 1 to n, are an error."""
    found = F.filter(F.transform(F.split(c, r"\[Document \d+\]\s*" if n is None else rf"\[Document [1-{n}]\]\s*"), strip), lambda s: s != "")
    return found if n is None else F.when(F.size(found) == n, found).otherwise(F.raise_error(F.lit(f"not {n} documents in a context")))


def explanation(c: Column) -> Column:
    """What follows the first "Explanation:", null without one."""
    return F.when(F.instr(c, "Explanation:") > 0, strip(F.regexp_extract(c, r"(?s)Explanation:(.*)\z", 1)))


#: What comes before a secret, which stays, and the secret.
SECRETS = ((r"authorization\s*[:=]\s*bearer\s+", r"[^\s,;]+"), (r"api[_-]?key\s*[:=]\s*", r"[^\s,;]+"), (r"bearer\s+", r"[A-Za-z0-9._~+/=-]+"))
#: Characters of an error message that are kept.
MESSAGE_CHARS = 1000


def redact_keys(c: Column, most: int | None = MESSAGE_CHARS) -> Column:
    """A message, cut to so many characters if any, with authorisations, keys and bearer tokens masked."""
    out = c if most is None else F.left(c, F.lit(most))
    for before, secret in SECRETS:
        out = F.regexp_replace(out, f"(?i)({before}){secret}", "$1[REDACTED]")
    return out


def stable_id(c: Column, kind: str) -> Column:
    """An id as canonical JSON, so that the number 1 and the text "1" differ; kind is the column's type. A blank text, a truth value, a fraction and a null are errors."""
    if kind == "string":
        return F.when(strip(c) != "", F.to_json(F.struct(c.alias("id")))).otherwise(F.raise_error(F.lit("an id must not be empty")))
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"an id is a text or a whole number, not {kind}")
    return F.when(c.isNotNull(), F.to_json(F.struct(c.cast("long").alias("id")))).otherwise(F.raise_error(F.lit("an id must not be null")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def run_id(parts: list[Column], identity: Column) -> Column:
    """run-, the slugs of the parts, "na" for those without any, and 24 digits of the identity's sha256."""
    slugs = [F.coalesce(F.nullif(slug(p), F.lit("")), F.lit("na")) for p in parts]
    return F.concat_ws("-", F.lit("run"), *slugs, F.left(F.sha2(identity, 256), F.lit(24)))


def contains_tokens(haystack: Column, needle: Column) -> Column:
    """Whether the needle's words stand together in the haystack; both are arrays of words without spaces."""
    return F.when(F.size(needle) == 0, False).otherwise(F.contains(F.concat(F.lit(" "), F.array_join(haystack, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" "))))
