"""Text expressions: whitespace, statistics and lexicon hits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
# Punctuation removed from both ends of a word before lexicon lookup.
WORD_EDGE = ".,;:!?()[]{}\"'"


def strip_text(text: Column) -> Column:
    """Remove every kind of Unicode whitespace from both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_whitespace(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def replace_tokens(text: Column, tokens: Iterable[str], replacement: str = "unknown") -> Column:
    """Exact matches of a missing-value token become ``replacement``."""
    tokens = list(tokens)
    return F.when(text.isin(tokens), F.lit(replacement)).otherwise(text) if tokens else text


def normalize_label(label: Column) -> Column:
    return F.lower(strip_text(label))


def _per_character(count: Column, text: Column) -> Column:
    return count.cast("double") / F.greatest(F.char_length(text), F.lit(1)).cast("double")


def text_length(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Whitespace-separated words of a text of any spacing."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("bigint")


def digit_ratio(text: Column) -> Column:
    return _per_character(F.regexp_count(text, F.lit(r"(?U)\d")), text)


def uppercase_ratio(text: Column) -> Column:
    """Share of ASCII capitals."""
    return _per_character(F.regexp_count(text, F.lit("[A-Z]")), text)


def hint_count(text: Column, lexicon: Iterable[str]) -> Column:
    """How many words of the text, without edge punctuation and in lower case, are in the lexicon."""
    words = sorted(set(lexicon))
    if not words:
        return F.lit(0).cast("bigint")
    tokens = F.split(collapse_whitespace(F.coalesce(text, F.lit(""))), " ")
    hits = F.filter(tokens, lambda w: F.lower(F.btrim(w, F.lit(WORD_EDGE))).isin(words))
    return F.size(hits).cast("bigint")
