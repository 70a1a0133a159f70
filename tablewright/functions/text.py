"""Text column expressions: normalisation, tokens and n-grams (JVM built-ins only)."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
# A token is a run of at least two letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# -------------------------------------------------------------------------------------------


@functools.cache
def accent_map() -> tuple[str, str]:
    """Every letter of the basic plane that decomposes into one letter and marks, and that
    letter (built from the Unicode tables); marks standing alone go."""
    pairs, marks = [], []
    for point in range(0x80, 0x10000):
        c = chr(point)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        parts = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != c and unicodedata.category(c)[0] == "L":
            pairs.append((c, parts[0]))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(base for _, base in pairs)


def strip_accents(col: Column) -> Column:
    """Letters without their accents, composed or not."""
    return F.translate(col, *accent_map())


def tokens(col: Column) -> Column:
    """Lower-case, accent-stripped word tokens (NULL text -> no tokens)."""
    norm = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    return F.regexp_extract_all(norm, F.lit(TOKEN_PATTERN), 0)


# Bigrams from the space-joined tokens: at the start and at every space, look ahead for
# "token token" (tokens never contain spaces).  One regex pass, no per-element lambda.
BIGRAM_PATTERN = r"(?:^| )(?=([^ ]+ [^ ]+))"


# The same where rare words are RARE_WORD: only pairs of other words are bigrams.
RARE_WORD = "|"
KEPT_BIGRAM_PATTERN = r"(?:^| )(?=([^ |]+ [^ |]+))"


def bigrams_of(toks: Column, words: list[str]) -> Column:
    """The bigrams of consecutive tokens that are both among ``words``."""
    kept = F.transform(toks, lambda t: F.when(t.isin(*words), t).otherwise(F.lit(RARE_WORD)))
    return F.regexp_extract_all(F.array_join(kept, " "), F.lit(KEPT_BIGRAM_PATTERN), 1)


def with_bigrams(toks: Column) -> Column:
    """Unigrams followed by the bigrams of consecutive tokens ('a b')."""
    bi = F.regexp_extract_all(F.array_join(toks, " "), F.lit(BIGRAM_PATTERN), 1)
    return F.concat(toks, bi)


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({expr}, ''))), '{TOKEN_PATTERN}')"
