"""Text functions: fingerprints, clean titles, keyword tests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words and phrases of the default relevance lexicon, an input that callers may replace.
DEFAULT_WORDS = ("ceasefire", "shelling", "drone", "curfew", "sanctions", "evacuation", "convoy", "prisoner", "border")
DEFAULT_PHRASES = ("air raid", "prisoner exchange", "peace talks", "hospital evacuation")

# Format marks that titles lose, and the characters that count as blanks.
_FORMAT_MARKS = "[\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"
_BLANKS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalise_summary(text: Column) -> Column:
    """Lower case, composed, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(nfc(F.lower(text)), "[^\\p{L}\\p{N}]+", " "))


def body_hash(text: Column, least: int = 40) -> Column:
    """SHA-256 of the normalised text; null below ``least`` characters."""
    n = normalise_summary(text)
    return F.when(F.char_length(n) >= least, F.sha2(n, 256))


def clean_title(title: Column) -> Column:
    """Composed, without format marks, blanks collapsed; letter case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfc(title), _FORMAT_MARKS, ""), _BLANKS, " "))


def keyword_relevant(title: Column, summary: Column, words: tuple[str, ...] = DEFAULT_WORDS, phrases: tuple[str, ...] = DEFAULT_PHRASES) -> Column:
    """Whether an ASCII word of the lexicon stands in the text, or a phrase is part of it."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))
    tokens = F.split(text, "[^0-9A-Za-z_]+")
    hit = F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in words)))
    for p in phrases:
        hit = hit | F.contains(text, F.lit(p))
    return F.coalesce(hit, F.lit(False))
