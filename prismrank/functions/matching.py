"""Matching aliases word by word in passages, for coverage of aspects."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from prismrank.functions.text import contains_tokens

#: Signs that count as an apostrophe.
APOSTROPHES = "‘’ʼ＇"
_LOOSE_APOSTROPHE = re.compile(r"(?<![^\W_])'|'(?![^\W_])")


def normal_tokens(text: str | None) -> list[str]:
    """Words after composing characters; punctuation, symbols and separators become spaces, but an apostrophe between letters or digits stays; controls stay, except those that are white space."""
    if not text:
        return []
    text = unicodedata.normalize("NFC", text).translate({ord(c): "'" for c in APOSTROPHES})
    text = "".join(c if c == "'" or unicodedata.category(c)[0] not in "PSZ" else " " for c in text)
    return _LOOSE_APOSTROPHE.sub(" ", text).split()


@F.pandas_udf(ArrayType(StringType()))
def tokens_udf(text: pd.Series) -> pd.Series:
    """normal_tokens by Arrow batches; Spark has no function that composes characters."""
    return text.map(normal_tokens)


@F.pandas_udf(ArrayType(StringType()))
def folded_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [w.casefold() for w in normal_tokens(t)])


def alias_matches(passage: Column, folded_passage: Column, alias: Column, folded_alias: Column) -> Column:
    """One word is matched with its case, more without. All are arrays from the functions above."""
    return F.when(F.size(alias) == 1, contains_tokens(passage, alias)).otherwise(contains_tokens(folded_passage, folded_alias))


def aspect_matches(passage: Column, folded_passage: Column, aliases: Column) -> Column:
    """Whether any of aliases, an array of (tokens, folded), stands in the passage."""
    return F.exists(aliases, lambda a: alias_matches(passage, folded_passage, a["tokens"], a["folded"]))
