"""Text steps written for DuckDB (RE2: no lookaround, ASCII word classes)."""

from __future__ import annotations

from ..dims import BOILERPLATE_PHRASES, PUNCTUATION, STOPWORDS

WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTER = r"\p{L}\p{N}_"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def rewrite(x: str, rules: list[tuple[str, str]]) -> str:
    """Spark rewrite rules on ASCII text: (?U) is dropped and $1 becomes \\1."""
    for pattern, replacement in rules:
        pattern = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
        for i in "123":
            replacement = replacement.replace(f"${i}", f"\\{i}")
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return x


def tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def dots_list(chars: str) -> str:
    """Dots without a digit on either side become blanks, over a list of characters."""
    return (
        f"array_to_string(list_transform({chars}, lambda ch, i: CASE WHEN ch = '.' "
        f"AND NOT regexp_matches(coalesce(CASE WHEN i > 1 THEN {chars}[i - 1] END, ''), '\\p{{Nd}}') "
        f"AND NOT regexp_matches(coalesce({chars}[i + 1], ''), '\\p{{Nd}}') THEN ' ' ELSE ch END), '')"
    )


def lone_marks(x: str) -> str:
    kept = f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: t NOT IN ('-', ':', '·', '/', '+'))"
    return f"replace(array_to_string({kept}, ' '), '////', ' ')"


def boilerplate(x: str) -> str:
    """Whole phrases become a blank; run twice since neighbours share their boundary character."""
    for phrase in BOILERPLATE_PHRASES:
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i)(^|[^{LETTER}]){phrase}([^{LETTER}]|$)', '\\1 \\2', 'g')"
    return x


def punctuation_class() -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in PUNCTUATION).replace("'", "''") + "]"


def filter_tokens(x: str, stopwords=False, single_letters=False, single_digits=False, pure_punctuation=False) -> str:
    conditions = ["t <> ''"]
    if stopwords:
        conditions.append("lower(t) NOT IN (" + ", ".join(quoted(w) for w in STOPWORDS) + ")")
    if single_letters:
        conditions.append("NOT regexp_full_match(t, '\\p{L}')")
    if single_digits:
        conditions.append("NOT regexp_full_match(t, '\\p{Nd}|[²³¹⁰⁴-⁹₀-₉①-⑨]')")
    if pure_punctuation:
        conditions.append(f"NOT regexp_full_match(t, '{punctuation_class()}+')")
    return f"array_to_string(list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: {' AND '.join(conditions)}), ' ')"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '[{WS}]+'), lambda t: t <> ''))"


def keep_only(x: str, outside: str) -> str:
    return f"length(regexp_replace(coalesce({x}, ''), '{outside}', '', 'g'))"
