"""Text analysis: tokens, case folding, NFC, stopwords and stems.

The same rules exist twice: as Spark columns for documents and in Python for
query strings; a test holds one against the other. Tokens are maximal runs of
letters and decimal digits with ordinal positions; dropping stopwords leaves
gaps, so phrases keep their distances.

All but two rules are JVM expressions. NFC changes so few letters that texts
without them are found by one pattern; the others' token arrays go to Python.
Stems are made once for each distinct word and joined.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaspark.functions import porter2

TOKEN = r"[\p{L}\p{Nd}]+"

# The words that are not indexed.
STOPWORDS = "a an the and or but in on at to for of with by from is it its as be was are were has have had he she they we i you that this which who not no so if do did will can may about than into".split()

# The words that the stemmer leaves as they are.
UNSTEMMED = frozenset("""
a about above after again against all am an and any are as at be because been before being below between both but by can did do
does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s
same she should so some such t than that the their theirs them themselves then there these they this those through to too under
until up very was we were what when where which while who whom why will with you your yours yourself yourselves
""".split())


@dataclass(frozen=True)
class AnalyzerConfig:
    """Kept with an index, so that documents and queries are analyzed alike."""

    stem: bool = False
    nfc: bool = True
    stopwords: bool = True


# --- Spark


def tokenize(text: Column) -> Column:
    """Array of tokens in order; their index is their position."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lowercase(text: Column) -> Column:
    """Letter by letter: a final sigma and a dotted capital I are no exceptions."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


@cache
def changed_letters() -> str:
    """A pattern of the letters that NFC changes, alone or beside others: those that are not
    their own NFC, and the vowels and finals that compose to Hangul syllables."""
    other = [c for c in range(0x250, 0x110000) if (x := chr(c)) and not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", x) and unicodedata.category(x)[0] in "LN"]
    other += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    ranges: list[list[int]] = []
    for c in sorted(other):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def has_changed_letters(text: Column) -> Column:
    """The first pattern is quick, and all that Latin texts need."""
    return text.rlike("[^\\x00-\\x{24F}]") & text.rlike(changed_letters())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_udf(terms: pd.Series) -> pd.Series:
    one = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t)
    return terms.map(lambda ts: None if ts is None else [one(t) for t in ts])


def normalized(terms: Column, text: Column) -> Column:
    """NFC of the token array of a text. Tokens hold no combining marks, so few letters can
    change; only arrays of texts with one of them are handed to Python, all
    others go there as null and come back unchanged."""
    return F.coalesce(_nfc_udf(F.when(has_changed_letters(text), terms)), terms)


def is_stopword(term: Column) -> Column:
    return term.isin(STOPWORDS)


def kept_terms(text: Column, config: AnalyzerConfig) -> Column:
    """Array of the lower-cased tokens, null where one is dropped, so that the index
    of a term is its position. NFC and stems come later, where they are rare."""
    low = F.transform(tokenize(text), lowercase)
    return F.transform(low, lambda t: F.when(~is_stopword(t), t)) if config.stopwords else low


def stems(words: DataFrame) -> DataFrame:
    """``words`` (term) -> term, stem of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["term"], pa.array([stem_text(t) for t in batch["term"].to_pylist()], pa.string())], ["term", "stem"])

    return words.select("term").where("term IS NOT NULL").distinct().mapInArrow(run, "term string, stem string")


@F.pandas_udf(T.StringType())
def _stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem_text(t))


def stemmed(term: Column) -> Column:
    """Stems row by row, for a few rows: the words of queries and of the k best texts."""
    return _stem_udf(term)


# --- Python


def stem_text(word: str) -> str:
    """The stem of a lower-case word."""
    return word if word in UNSTEMMED else porter2.stem(word)


def tokenize_text(text: str) -> list[str]:
    out, start = [], None
    for i, c in enumerate(text):
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            start = i if start is None else start
        elif start is not None:
            out.append(text[start:i])
            start = None
    return out + ([text[start:]] if start is not None else [])


def lowercase_text(text: str) -> str:
    return "".join("i" if c == "İ" else c.lower() for c in text)


def analyze_text(text: str, config: AnalyzerConfig = AnalyzerConfig()) -> list[tuple[int, str]]:
    """(position, term) of the terms that are kept."""
    out = []
    for pos, token in enumerate(tokenize_text(text)):
        low = lowercase_text(unicodedata.normalize("NFC", token) if config.nfc else token)
        if not (config.stopwords and low in STOPWORDS):
            out.append((pos, stem_text(low) if config.stem else low))
    return out
