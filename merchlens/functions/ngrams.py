"""Word and character n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are letters, numbers and underscore, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body) -> Column:
    """Bind an expression to a name so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_tokens(c: Column, lowercase: bool = False) -> Column:
    c = F.lower(c) if lowercase else c
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _join_grams(words: Column, n: int) -> Column:
    """n-grams of an array: each (n-1)-gram is extended by the word after it."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
    return F.zip_with(
        F.slice(_join_grams(words, n - 1), F.lit(1), count),
        F.slice(words, F.lit(n), count),
        lambda gram, word: F.concat(gram, F.lit(" "), word),
    )


def word_ngrams(c: Column, lo: int = 1, hi: int = 2, lowercase: bool = False) -> Column:
    tokens = word_tokens(c, lowercase)
    if lo == hi == 1:
        return tokens
    return let(tokens, lambda w: F.concat(*[_join_grams(w, n) for n in range(lo, hi + 1)]))


def char_ngrams(c: Column, lo: int = 3, hi: int = 5, lowercase: bool = False) -> Column:
    """n-grams over raw characters, blanks included; runs of white space count as one blank.

    The pattern looks ahead over n characters and then moves on by one, so a single
    regex pass yields all overlapping n-grams of one length.
    """
    c = F.lower(c) if lowercase else c
    c = F.regexp_replace(c, r"(?U)\s\s+", " ")
    windows = [F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}})).")) for n in range(lo, hi + 1)]
    return windows[0] if lo == hi else F.concat(*windows)
