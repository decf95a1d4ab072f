"""Length, composition, keyword, unit and language features of text columns."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import KEYWORDS, STOPWORDS_EN, STOPWORDS_FR, UNIT_PATTERNS
from ..schemas import require_columns, string_columns
from .text_merge import blank, merge_title_description

FEATURE_SUFFIXES = (
    "len_char", "len_words", "num_digits", "num_punctuation", "uppercase_ratio", "digit_ratio",
)


def char_length(c: Column) -> Column:
    return F.length(blank(c))


def words(c: Column) -> Column:
    return F.filter(F.split(blank(c), r"(?U)\s+"), lambda t: t != "")


def word_length(c: Column) -> Column:
    return F.size(words(c))


def count_class(c: Column, outside: str) -> Column:
    """Characters left after deleting every run of the characters ``outside``."""
    return F.length(F.regexp_replace(blank(c), outside, ""))


def digit_count(c: Column) -> Column:
    return count_class(c, r"\P{Nd}+")


def punctuation_count(c: Column) -> Column:
    return count_class(c, r"(?U)[\p{L}\p{N}_\s]+")


def uppercase_count(c: Column) -> Column:
    return count_class(c, r"\P{Lu}+")


def _ratio(count: Column, c: Column) -> Column:
    return F.when(char_length(c) == 0, F.lit(0.0)).otherwise(count / char_length(c))


def feature_names(columns: list[str]) -> list[str]:
    return [f"{c}_{s}" for c in columns for s in FEATURE_SUFFIXES]


def text_features(columns: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name in columns:
        c = F.col(name)
        out[f"{name}_len_char"] = char_length(c)
        out[f"{name}_len_words"] = word_length(c)
        out[f"{name}_num_digits"] = digit_count(c)
        out[f"{name}_num_punctuation"] = punctuation_count(c)
        out[f"{name}_uppercase_ratio"] = _ratio(uppercase_count(c), c)
        out[f"{name}_digit_ratio"] = _ratio(digit_count(c), c)
    return out


def add_text_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return require_columns(df, columns).withColumns(text_features(columns))


def extract_text_features(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    features = text_features(columns)
    return require_columns(df, columns).select(*keep, *[c.alias(n) for n, c in features.items()])


def text_lengths(
    df: DataFrame, columns: list[str], unit: str = "char", name_prefix: str | None = None
) -> DataFrame:
    measures = {"char": char_length, "word": word_length}
    if unit not in measures:
        raise ValueError(f"unit must be one of {sorted(measures)}, not {unit!r}")
    prefix = f"{name_prefix}_" if name_prefix else ""
    return require_columns(df, columns).withColumns(
        {prefix + c: measures[unit](F.col(c)) for c in columns}
    )


def token_frequencies(
    df: DataFrame,
    tokens: list[str],
    columns: list[str] | None = None,
    normalize: bool = False,
    name_prefix: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Count every pattern in the blank-joined columns, optionally per character.

    Tokens are regular expressions; ``literal=True`` counts them as plain text.
    """
    columns = string_columns(df) if columns is None else columns
    prefix = f"{name_prefix}_" if name_prefix else ""
    df = df.withColumn("_joined", F.concat(*[F.concat(F.lit(" "), blank(F.col(c))) for c in columns]))
    out = {}
    for t in tokens:
        pattern = rf"\Q{t}\E" if literal else t
        count = F.regexp_count(F.col("_joined"), F.lit(pattern))
        if normalize:
            count = F.when(F.length("_joined") == 0, F.lit(0.0)).otherwise(count / F.length("_joined"))
        out[prefix + t] = count
    return df.withColumns(out).drop("_joined")


def _any_of(terms: list[str]) -> str:
    """Alternation of the terms; plain words get a first-letter check that skips most positions."""
    pattern = "|".join(terms)
    if all(t.isalnum() for t in terms):
        return f"(?=[{''.join(sorted({t[0] for t in terms}))}])(?:{pattern})"
    return pattern


def _families(terms: list[str]) -> list[list[str]]:
    """Terms in groups; places of terms of different groups never overlap in a text."""

    def meet(x: str, y: str) -> bool:
        return x in y or y in x or any(a.endswith(b[:k]) for a, b in ((x, y), (y, x)) for k in range(1, len(b)))

    groups: list[list[int]] = []
    for i, t in enumerate(terms):
        near = [g for g in groups if any(meet(t, terms[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sorted([i, *(j for g in near for j in g)])]
    return [[terms[i] for i in g] for g in groups]


def _word_count(c: Column, term: str) -> Column:
    rest = F.octet_length(F.replace(c, F.lit(term), F.lit("")))
    count = ((F.octet_length(c) - rest) / len(term.encode())).cast("int")
    return F.when(F.contains(c, F.lit(term)), count).otherwise(0)


def _hits(c: Column, terms: list[str]) -> Column:
    """Non-overlapping hits of the alternation of the terms; plain words that stay apart are searched one by one."""

    def matched(words: list[str]) -> Column:
        return F.regexp_count(c, F.lit(_any_of(words)))

    if not terms or not all(t.isalnum() for t in terms):
        return matched(terms)
    counts = []
    for words in _families(terms):
        some = reduce(or_, [F.contains(c, F.lit(t)) for t in words])
        counts.append(_word_count(c, words[0]) if len(words) == 1 else F.when(some, matched(words)).otherwise(0))
    return reduce(add, counts)


def keyword_counts(c: Column, keywords: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Non-overlapping keyword hits per category, case-sensitive, inside words too."""
    keywords = KEYWORDS if keywords is None else keywords
    return {f"{category}_keywords": _hits(blank(c), terms) for category, terms in keywords.items()}


def unit_flags(c: Column) -> dict[str, Column]:
    """Digit count, presence of a numbering mark, presence of any unit of measure."""
    any_unit = "(?iU)" + "|".join(f"(?:{p})" for p in UNIT_PATTERNS.values())
    text = blank(c)
    return {
        "nb_digits_text": count_class(c, r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]+"),
        "contains_numerotation": text.rlike(r"n° ?[0-9]").cast("int"),
        "has_any_unit": text.rlike(any_unit).cast("int"),
    }


def language_vote(c: Column) -> Column:
    """'fr' or 'en' by the larger number of function words, 'other' on a tie."""
    tokens = F.filter(F.split(F.lower(blank(c)), r"[^\p{L}']+"), lambda t: t != "")

    def votes(only: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(only)))

    fr = votes(sorted(set(STOPWORDS_FR) - set(STOPWORDS_EN)))
    en = votes(sorted(set(STOPWORDS_EN) - set(STOPWORDS_FR)))
    return F.when(fr > en, "fr").when(en > fr, "en").otherwise("other")


def language_flags(lang: Column) -> dict[str, Column]:
    return {
        "txt_fr": (lang == "fr").cast("int"),
        "txt_en": (lang == "en").cast("int"),
        "txt_other": (~lang.isin("fr", "en")).cast("int"),
    }


def language_vote_flags(df: DataFrame, title: str = "designation", description: str = "description") -> DataFrame:
    df = df.withColumn("_lang", language_vote(merge_title_description(F.col(title), F.col(description))))
    return df.withColumns(language_flags(F.col("_lang"))).drop("_lang")


def weight_features(values: Column, weight: float) -> Column:
    """Multiply a feature block (array column) by one factor."""
    return F.transform(values, lambda v: v * F.lit(float(weight)))
