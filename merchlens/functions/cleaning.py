"""Text cleaning steps and the flag-driven cleaner.

Each step is a plain expression. Only entity decoding and NFC need Python: both
run in one Arrow UDF that receives null for every row that cannot change, so
untouched text never reaches the Python worker.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BOILERPLATE_PHRASES, PUNCTUATION, STOPWORDS
from .ngrams import let

# --- Fixed values: Windows-1252 characters and the bytes they stand for ---------------------
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = [
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F,
]
_C1 = "".join(map(chr, CP1252_BYTES))

# A UTF-8 sequence that was read as Latin-1 or Windows-1252. Two-byte leads are kept to
# the ones that do not collide with French, German or Spanish capitals before a quote.
_TAIL = "[\u0080-\u00BF" + CP1252_CHARS + "]"
_MOJIBAKE = (
    f"(?:[ÂÃ]{_TAIL}|Å[\u0092\u0093’“]|â{_TAIL}{{2}}|ð{_TAIL}{{3}})+"
)

_LIGATURES = {"ĳ": "ij", "Ĳ": "IJ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_CURLY = "\u02BC\u2018\u2019\u201A\u201B\u201C\u201D\u201E\u201F"
_STRAIGHT = "'" * 5 + '"' * 4
_NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))
_CONTROL = r"[\x00-\x08\x0B\x0E-\x1F\x7F\u206A-\u206F\uFEFF\uFFF9-\uFFFC]"


def _decode_run(run: Column) -> Column:
    raw = F.encode(F.translate(run, CP1252_CHARS, _C1), "ISO-8859-1")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(run)


def fix_mojibake(c: Column) -> Column:
    """Undo double encoding run by run; text without such runs is returned as it is."""
    fixed = F.array_join(
        F.flatten(
            F.zip_with(
                F.split(c, _MOJIBAKE, -1),
                F.transform(F.regexp_extract_all(c, F.lit(_MOJIBAKE), F.lit(0)), _decode_run),
                lambda part, run: F.array(part, F.coalesce(run, F.lit(""))),
            )
        ),
        "",
    )
    return F.when(c.rlike(_MOJIBAKE), fixed).otherwise(c)


def tidy_characters(c: Column) -> Column:
    """Straight quotes, plain ligatures, half-width forms, one kind of line break, no controls."""
    out = F.regexp_replace(c, r"\x1b\[[\d;]*[a-zA-Z]", "")
    for ligature, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(plain))
    out = F.translate(out, _WIDE, _NARROW)
    out = F.translate(out, _CURLY, _STRAIGHT)
    out = F.regexp_replace(out, r"\r\n|[\r\u0085\u2028\u2029]", "\n")
    return F.regexp_replace(out, _CONTROL, "")


# Characters that tidy_characters can change; text without any of them skips the chain.
_UNTIDY = (
    r"[\x00-\x08\x0B\x0D-\x1F\x7F\u0085\u02BC\u2018-\u201F\u2028\u2029\u206A-\u206F\u3000\uFEFF\uFF01-\uFF5E\uFFF9-\uFFFC"
    + "".join(_LIGATURES)
    + "]"
)


def _tidy_if_needed(c: Column) -> Column:
    return F.when(c.rlike(_UNTIDY), tidy_characters(c)).otherwise(c)


def fix_encoding(c: Column) -> Column:
    return _tidy_if_needed(let(c, fix_mojibake))


# Text made only of characters outside this class is already in NFC.
_MAY_CHANGE_NFC = r"[\u0300-\u1FFF\u2000\u2001\u20D0-\x{10FFFF}]"


@lru_cache(maxsize=None)
def _decoder(unescape: bool, nfc: bool):
    def decode(text: pd.Series) -> pd.Series:
        out = text
        if unescape:
            out = out.map(html.unescape, na_action="ignore")
        if nfc:
            out = out.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")
        return out

    decode.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "string")


def _decode_text(c: Column, unescape: bool, nfc: bool) -> Column:
    needs = []
    if unescape:
        needs.append(F.contains(c, F.lit("&")))
    if nfc:
        needs.append(c.rlike(_MAY_CHANGE_NFC))
    guard = needs[0] if len(needs) == 1 else needs[0] | needs[1]
    return F.coalesce(_decoder(unescape, nfc)(F.when(guard, c)), c)


def unescape_html(c: Column) -> Column:
    return _decode_text(c, True, False)


def normalize_unicode(c: Column) -> Column:
    return _decode_text(c, False, True)


# --- Fixed values: the five entities that have a purely native decoder ----------------------
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape_basic_entities(c: Column) -> Column:
    """Native decoder for text known to hold only the five basic entities."""
    for entity, char in BASIC_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def remove_html_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def _rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# --- Fixed values: number and unit rewriting rules, applied in order -------------------------
DIMENSION_RULES = [
    (r"(?iU)\b(\d+)\s*x\s*(\d+)\s*x\s*(\d+)\b", "$1x$2x$3"),
    (r"(?iU)\b(\d+)\s*x\s*(\d+)\b", "$1x$2"),
    (r"(?iU)\b([lh])\s*x\s*([lh])\s*x\s*([lh])\b", "$1x$2x$3"),
]
UNIT_RULES = [
    (r"(?iU)\b(\d+)\s*(kg|g|mg|ml|l)\b", "$1$2"),
    (r"(?iU)\b(\d+)\s*(mm|cm|m)\b", "$1$2"),
    (r"(?iU)\b(\d+)\s*(go|gb|mo|mb)\b", "$1$2"),
    (r"(?iU)\b(\d+)\s*%\b", "$1pct"),
    (r"(?iU)\b(\d+)\s*(mah|ah)\b", "$1$2"),
]
DURATION_RULES = [
    (r"(?iU)\b(\d+)\s*(h|heures?)\b", "$1h"),
    (r"(?iU)\b(\d+)\s*(j|jours?)\b", "$1j"),
    (r"(?iU)\b(\d+)\s*mois\b", "$1mois"),
    (r"(?iU)\b(\d+)\s*ans?\b", "$1ans"),
    (r"(?iU)\b24\s*h\s*/\s*24\b", "24h24"),
    (r"(?iU)\b7\s*j\s*/\s*7\b", "7j7"),
]
AGE_RULES = [
    (r"(?iU)\b(\d+)\s*-\s*(\d+)\s*ans\b", "$1_$2ans"),
    (r"(?iU)\b(\d+)\s*-\s*(\d+)ans\b", "$1_$2ans"),
    (r"(?iU)\b(\d+)\s*ans?\s*et\s*plus\b", "$1plus_ans"),
]
YEAR_RULES = [(r"(?U)\b((?:18|19|20)\d{2})\b", " year$1 ")]
PUNCTUATION_RULES = [
    (r"(?U)(?<!\d)\.(?!\d)", " "),
    (r"(?U)(?<!\S)[-:·/+](?!\S)", " "),
    (r"////", " "),
]


def merge_dimensions(c: Column) -> Column:
    return _rewrite(c, DIMENSION_RULES)


def merge_units(c: Column) -> Column:
    return _rewrite(c, UNIT_RULES)


def merge_durations(c: Column) -> Column:
    return _rewrite(c, DURATION_RULES)


def merge_age_ranges(c: Column) -> Column:
    return _rewrite(c, AGE_RULES)


def tag_years(c: Column) -> Column:
    return _rewrite(c, YEAR_RULES)


def remove_punctuation(c: Column) -> Column:
    return _rewrite(c, PUNCTUATION_RULES)


def remove_boilerplate(c: Column, phrases: list[str] | None = None) -> Column:
    phrases = BOILERPLATE_PHRASES if phrases is None else phrases
    return _rewrite(c, [(rf"(?iU)\b\Q{p}\E\b", " ") for p in phrases if p])


def _punctuation_class() -> str:
    return "[" + re.escape(PUNCTUATION) + "]"


def filter_tokens(
    c: Column,
    stopwords: bool = False,
    single_letters: bool = False,
    single_digits: bool = False,
    pure_punctuation: bool = False,
    words: list[str] | None = None,
) -> Column:
    """Drop white-space tokens by rule and join the rest by one blank."""
    words = STOPWORDS if words is None else words

    def keep(token: Column) -> Column:
        ok = token != ""
        if stopwords:
            ok = ok & ~F.lower(token).isin(words)
        if single_letters:
            ok = ok & ~token.rlike(r"^\p{L}\z")
        if single_digits:
            ok = ok & ~token.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]\z")
        if pure_punctuation:
            ok = ok & ~token.rlike(f"^{_punctuation_class()}+\\z")
        return ok

    return F.array_join(F.filter(F.split(c, r"(?U)\s+"), keep), " ")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


CLEANING_FLAGS = (
    "fix_encoding", "unescape_html", "normalize_unicode", "remove_html_tags", "remove_boilerplate",
    "lowercase", "merge_dimensions", "merge_units", "merge_durations", "merge_age_ranges", "tag_years",
    "remove_punctuation", "remove_stopwords", "remove_single_letters", "remove_single_digits",
    "remove_pure_punct_tokens",
)


def _stages(flags: dict[str, bool]) -> list:
    """Steps in their fixed order. A stage uses its input several times, so each gets its own projection."""
    unknown = set(flags) - set(CLEANING_FLAGS)
    if unknown:
        raise TypeError(f"unknown cleaning flags {sorted(unknown)}")
    on = {name for name, value in flags.items() if value}
    stages = [lambda c: F.coalesce(c.cast("string"), F.lit(""))]
    if "fix_encoding" in on:
        stages += [fix_mojibake, _tidy_if_needed]
    if on & {"unescape_html", "normalize_unicode", "fix_encoding"}:
        unescape, nfc = "unescape_html" in on, bool(on & {"normalize_unicode", "fix_encoding"})
        stages.append(lambda c: _decode_text(c, unescape, nfc))

    def native(c: Column) -> Column:
        for name, step in (
            ("remove_html_tags", remove_html_tags),
            ("lowercase", F.lower),
            ("merge_dimensions", merge_dimensions),
            ("merge_units", merge_units),
            ("merge_durations", merge_durations),
            ("merge_age_ranges", merge_age_ranges),
            ("tag_years", tag_years),
            ("remove_punctuation", remove_punctuation),
            ("remove_boilerplate", remove_boilerplate),
        ):
            if name in on:
                c = step(c)
        filters = {
            "stopwords": "remove_stopwords" in on,
            "single_letters": "remove_single_letters" in on,
            "single_digits": "remove_single_digits" in on,
            "pure_punctuation": "remove_pure_punct_tokens" in on,
        }
        if any(filters.values()):
            c = filter_tokens(c, **filters)
        return collapse_whitespace(c)

    return [*stages, native]


def clean_text(c: Column, **flags: bool) -> Column:
    """Apply the switched-on steps in their fixed order; null becomes the empty text."""
    for stage in _stages(flags):
        c = stage(c)
    return c


def clean_frame(df: DataFrame, columns: dict[str, Column], **flags: bool) -> DataFrame:
    """The same for whole columns, one projection per stage: {output name: text expression}."""
    df = df.withColumns(columns)
    for stage in _stages(flags):
        df = df.withColumns({name: stage(F.col(name)) for name in columns})
    return df


FINAL_FLAGS = dict.fromkeys(
    ("fix_encoding", "unescape_html", "normalize_unicode", "remove_html_tags", "lowercase", "remove_punctuation"),
    True,
)


def final_clean(c: Column) -> Column:
    """The production preset of the cleaner."""
    return clean_text(c, **FINAL_FLAGS)


def clean_columns(
    df: DataFrame,
    columns: list[str] = ("designation", "description"),
    name_prefix: str = "",
    lowercase: bool = False,
    remove_html: bool = True,
) -> DataFrame:
    """Encoding, entity, NFC and tag cleaning of several columns; outputs are prefixed."""
    prefix = f"{name_prefix}_" if name_prefix else ""
    flags = {
        "fix_encoding": True,
        "unescape_html": True,
        "normalize_unicode": True,
        "remove_html_tags": remove_html,
        "lowercase": lowercase,
    }
    return clean_frame(df, {prefix + c: F.col(c) for c in columns}, **flags)
