"""Snippets: the window of a text with most query words, and its highlighting."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaspark.functions.analysis import AnalyzerConfig, lowercase, stem_text, tokenize

WINDOW_CHARACTERS = 160
BOLD, PLAIN = "\x1b[1m", "\x1b[0m"


def window_words(characters: int = WINDOW_CHARACTERS) -> int:
    return max(5, characters // 6)


def window_start(text: Column, terms: list[str], config: AnalyzerConfig = AnalyzerConfig(), characters: int = WINDOW_CHARACTERS) -> Column:
    """Index of the first word of the first window with most hits; null without
    words. Words are compared after analysis. Meant for the top k rows: with stems,
    their words go to Python."""
    words = F.transform(tokenize(text), lowercase)
    width = window_words(characters)
    if config.stem:
        return _stemmed_start(frozenset(terms), width)(words)
    hits = F.transform(words, lambda w: w.isin(terms).cast("int"))
    inside = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.aggregate(F.slice(hits, i, F.lit(width)), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(hits) > 0, F.array_position(inside, F.array_max(inside)) - 1)


def _stemmed_start(terms: frozenset, width: int):
    @F.pandas_udf(T.LongType())
    def start(words: pd.Series) -> pd.Series:
        def one(ws):
            hits = [0, *np.cumsum([stem_text(w) in terms for w in ws]).tolist()] if ws is not None and len(ws) else []
            n = len(hits) - 1
            return max(range(n), key=lambda i: (hits[min(n, i + width)] - hits[i], -i)) if n > 0 else None

        return words.map(one).astype("Int64")

    return start


def window_text(text: Column, start: Column, characters: int = WINDOW_CHARACTERS) -> Column:
    """The text from the window's first to its last word, as it stands; empty without words."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*"), F.lit(0))
    span = F.array_join(F.slice(pieces, (start + 1).cast("int"), F.lit(window_words(characters))), "")
    return F.coalesce(F.regexp_replace(span, r"[^\p{L}\p{Nd}]+$", ""), F.lit(""))


def highlighted(snippet: Column, terms: list[str]) -> Column:
    """Every occurrence of a term, in any case, in bold; one pass, longest first."""
    if not terms:
        return snippet
    either = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(snippet, f"(?iu)({either})", f"{BOLD}$1{PLAIN}")
