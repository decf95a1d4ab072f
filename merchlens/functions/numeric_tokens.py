"""Measurements in text: extraction, unit conversion, buckets, in-place tokens.

The patterns run in a fixed order because each one sees the text the earlier ones
left behind. Every pattern is one projection of its own, so the plan grows by one
Project per pattern and no expression is repeated.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import BUCKETS, UNIT_FACTORS, UNIT_SPELLINGS
from ..session import local_rows
from .ngrams import let
from .text_merge import blank

TITLE_TOKEN, DESCRIPTION_TOKEN = "[TITRE]", "[DESC]"

# --- Fixed values: sub-patterns of numbers and units ------------------------------------------
NUMBER = r"(\d+[.,]?\d*)"
DISTANCE = r"(mm|millim[eèé]tres?|cm|centim[eèé]tres?|m|m[eèé]tres?)"
VOLUME = r"([mcd]?m3|[mcd]?l|millilitres?|centilitres?|litres?)"
WEIGHT = r"(g|grammes?|kg|kilogrammes?|kilo|tonnes?)"
TIMES = r"\s*[xX*]\s*"


@dataclass(frozen=True)
class Measure:
    """One pattern: which groups hold numbers, which the unit, and whether it is a range."""

    name: str
    core: str
    values: tuple[int, ...] = ()
    unit: int | None = None
    is_range: bool = False
    regex: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", rf"(?iU)\b{self.core}\b")


# --- Fixed values: the patterns in application order -----------------------------------------
MEASURES: list[Measure] = [
    Measure("volume", rf"{NUMBER}{TIMES}{NUMBER}{TIMES}{NUMBER}\s*{DISTANCE}", (1, 2, 3), 4),
    Measure("volume", rf"{NUMBER}\s*{VOLUME}", (1,), 2),
    Measure("surface", rf"{NUMBER}{TIMES}{NUMBER}\s*{DISTANCE}", (1, 2), 3),
    Measure("surface", rf"{NUMBER}\s*([mcd]?m2)", (1,), 2),
    Measure("length", rf"(?:{NUMBER}\s*-\s*)?{NUMBER}\s*{DISTANCE}", (1, 2), 3, True),
    Measure("weight", rf"{NUMBER}\s*{WEIGHT}", (1,), 2),
    Measure("price", rf"{NUMBER}\s*(€|eur|euros?)", (1,), 2),
    Measure("age", r"(?:(\d+)\s*-\s*)?(\d+)\s*(mois|ans?)", (1, 2), 3, True),
    Measure("memory", r"(\d+)\s*([gmt][ob])", (1,), 2),
    Measure("date", r"(?:\d{2}/\d{2}/|\d{2}/)?((?:18|19|20)\d{2})", (1,)),
    Measure("numero", r"(num[eé]ro|num|n°|n[^\n]?|no[^\n]?)\s*(\d+)", (2,), 1),
    Measure("power", rf"{NUMBER}\s*(cv|w|watts?)", (1,), 2),
    Measure("energy", rf"{NUMBER}\s*(kw|kilowatts?)", (1,), 2),
    Measure("capacity", rf"{NUMBER}\s*(m?ah)", (1,), 2),
    Measure("temperature", rf"{NUMBER}\s*(°[ck]?|degr[eé]s?)", (1,), 2),
    Measure("tension", rf"{NUMBER}\s*(v|volts?)", (1,), 2),
    Measure("card", r"(\d+)\s*(cartes?)", (1,), 2),
    Measure("piece", r"(\d+)\s*(pi[eè]ces?|pcs)", (1,), 2),
    Measure("integer", r"(\d+)", (1,)),
    Measure("float", NUMBER, (1,)),
]

# --- Fixed values: measures of each mode -------------------------------------------------------
PHYSICAL = ("volume", "surface", "length", "weight")
LIGHT = PHYSICAL + ("memory", "age", "card", "piece", "power", "energy", "capacity", "temperature", "tension")
FULL = LIGHT + ("date", "numero", "integer", "float", "price")
MODES: dict[str, tuple[str, ...]] = {"light": LIGHT, "full": FULL, "phys": PHYSICAL}


def measures_of(strategy: str | list[str]) -> list[Measure]:
    """Patterns of a named mode, or of an explicit list of measure names."""
    names = MODES[strategy] if isinstance(strategy, str) else strategy
    unknown = set(names) - {m.name for m in MEASURES}
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    return [m for m in MEASURES if m.name in names]


def _map_literal(entries: dict[str, object], kind: str) -> Column:
    """A constant map; folded to a literal before execution."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>")


def unit_symbol(unit: Column) -> Column:
    """Lower-cased unit with written-out spellings mapped to their symbol."""
    return let(
        F.lower(unit), lambda u: F.coalesce(F.try_element_at(_map_literal(UNIT_SPELLINGS, "string"), u), u)
    )


def unit_factor(symbol: Column) -> Column:
    """Factor to the base unit; units without one are left as they are."""
    return F.coalesce(F.try_element_at(_map_literal(UNIT_FACTORS, "double"), symbol), F.lit(1.0))


def bucket_label(value: Column, measure: str) -> Column:
    """Label of the half-open bucket that holds the value."""
    if measure not in BUCKETS:
        return F.lit(measure)
    bounds, labels = BUCKETS[measure]

    def pick(v: Column) -> Column:
        out = F.when((v < bounds[0]) | (v >= float("inf")) | v.isNull(), F.lit(measure + "inconnu"))
        for upper, label in zip(bounds[1:], labels):
            out = out.when(v < upper, label)
        return out.otherwise(labels[-1])

    return let(value, pick)


# Unicode noncharacters that mark a match and its groups while a text is rewritten.
MARK, GROUP, ESCAPE = "\uFDD0", "\uFDD1", "\uFDD2"
_ESCAPES = [(ESCAPE, ESCAPE + "\uFDD5"), (MARK, ESCAPE + "\uFDD3"), (GROUP, ESCAPE + "\uFDD4")]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has_unit(m: Measure) -> bool:
    # the marker word of a numbering ("n°") has no unit table
    return m.unit is not None and m.name != "numero"


# The steps below are SQL text: one parse per pattern instead of hundreds of calls from
# Python. In each of them ``g`` is the bound array of captured groups of one match.


def _pieces(text: str, m: Measure) -> str:
    """Text cut at the matches of one pattern in a single pass.

    Even elements are plain text, odd ones hold the captured groups of a match. An
    optional group that did not take part is empty.
    """
    groups = [*m.values] + ([m.unit] if _has_unit(m) else [])
    marked = MARK + GROUP.join(f"${g}" for g in groups) + MARK
    return f"split(regexp_replace({text}, {_quoted(m.regex)}, '{marked}'), '{MARK}', -1)"


# The patterns take decimal digits of every script; these are the ones besides ASCII and their values.
DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decimal(c, None) is not None)
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def _numbers(m: Measure) -> list[str]:
    return [f"try_cast(translate(g[{i}], {_quoted(',' + DIGITS)}, {_quoted('.' + VALUES)}) AS DOUBLE)" for i in range(len(m.values))]


def _base_numbers(m: Measure) -> list[str]:
    """Numbers of one match in base units; null where an optional group is empty."""
    if not _has_unit(m):
        return _numbers(m)
    factors = {s: UNIT_FACTORS[u] for s, u in UNIT_SPELLINGS.items()} | UNIT_FACTORS
    known = {s: f for s, f in factors.items() if re.search(m.core + r"\Z", "1 x 1 x 1 " + s)}
    if not known:
        return _numbers(m)
    table = f"from_json({_quoted(json.dumps(known))}, 'map<string,double>')"
    factor = f"coalesce(try_element_at({table}, lower(g[{len(m.values)}])), 1D)"
    return [f"{v} * {factor}" for v in _numbers(m)]


def _label(value: str, m: Measure, fmt: str = "{}") -> str:
    """Label of the half-open bucket that holds the value, bound once as ``v``."""
    bounds, labels = BUCKETS[m.name]
    labels = [_quoted(fmt.format(x)) for x in labels]
    unknown = _quoted(fmt.format(m.name + "inconnu"))
    cases = " ".join(f"WHEN v < {upper}D THEN {x}" for upper, x in zip(bounds[1:], labels))
    outside = f"v IS NULL OR v < {bounds[0]}D OR v >= double('infinity')"
    return f"transform(array({value}), v -> CASE WHEN {outside} THEN {unknown} {cases} ELSE {labels[-1]} END)[0]"


def _token(value: str, m: Measure) -> str:
    return f"translate({_label(value, m, '[{}]')}, ' ', '_')"


def _replacement(m: Measure) -> str:
    if m.name not in BUCKETS:
        return _quoted(f"[{m.name}]")
    values = _base_numbers(m)
    if not m.is_range:
        return _token(" * ".join(values), m)
    low, high = (_token(v, m) for v in values)
    return f"CASE WHEN g[0] <> '' THEN concat('entre ', {low}, ' et ', {high}) ELSE {high} END"


def _measured(m: Measure) -> str:
    """Array of the (measure, value, unit, base_value, label) rows of one match."""
    raw, base = _numbers(m), _base_numbers(m)
    if m.name not in BUCKETS:
        rows = [(raw[0], raw[0])]
    elif m.is_range:
        rows = list(zip(raw, base))
    else:
        rows = [(" * ".join(raw), " * ".join(base))]
    unit = "CAST(NULL AS STRING)"
    if _has_unit(m):
        symbols = f"from_json({_quoted(json.dumps(UNIT_SPELLINGS))}, 'map<string,string>')"
        low = f"lower(g[{len(m.values)}])"
        unit = f"coalesce(try_element_at({symbols}, {low}), {low})"
    cells = [
        f"named_struct('measure', {_quoted(m.name)}, 'value', {value}, 'unit', {unit}, 'base_value', {number}, "
        f"'label', {_label(number, m) if m.name in BUCKETS else _quoted(m.name)})"
        for value, number in rows
    ]
    return f"array({', '.join(cells)})"


def _per_match(piece: str, body: str) -> str:
    return f"transform(array(split({piece}, '{GROUP}', -1)), g -> {body})[0]"


def _woven(pieces: str, m: Measure) -> str:
    token = _per_match("p", _replacement(m))
    return f"array_join(transform({pieces}, (p, i) -> CASE WHEN i % 2 = 0 THEN p ELSE {token} END), '')"


def _escaped(text: Column) -> Column:
    for mark, escape in _ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(escape))
    return text


def _unescaped(text: Column) -> Column:
    for mark, escape in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escape), F.lit(mark))
    return text


def plain_powers(text: Column) -> Column:
    return F.translate(text, "²³", "23")


def replace_measures(df: DataFrame, columns: list[str], strategy: str | list[str] = "light") -> DataFrame:
    """Replace every measurement in the given text columns by its token; nulls become ''."""
    df = df.withColumns({c: _escaped(plain_powers(blank(F.col(c)))) for c in columns})
    for m in measures_of(strategy):
        df = df.withColumns({c: F.expr(_woven(_pieces(f"`{c}`", m), m)) for c in columns})
    return df.withColumns({c: _unescaped(F.col(c)) for c in columns})


def merge_numeric_text(
    df: DataFrame,
    out: str = "text",
    title: str = "designation",
    description: str = "description",
    strategy: str | list[str] = "light",
) -> DataFrame:
    """Tokenised title and description in one column, each behind its own marker."""
    df = df.withColumns({"_title": F.col(title), "_description": F.col(description)})
    df = replace_measures(df, ["_title", "_description"], strategy)
    text = F.concat(
        F.lit(TITLE_TOKEN + " "), F.col("_title"), F.lit(f" {DESCRIPTION_TOKEN} "), F.col("_description")
    )
    return df.withColumn(out, text).drop("_title", "_description")


def extract_measures(
    df: DataFrame, text: str, keep: list[str], strategy: str | list[str] = "full"
) -> DataFrame:
    """One row per measured value: ``keep`` columns + measure, value, unit, base_value, label."""
    measures = measures_of(strategy)
    df = df.select(*keep, _escaped(plain_powers(blank(F.col(text)))).alias("_text"))
    found = []
    for i, m in enumerate(measures):
        name = f"_found{i}"
        found.append(name)
        df = df.withColumn("_pieces", F.expr(_pieces("_text", m)))
        hits = "filter(_pieces, (p, i) -> i % 2 = 1)"
        rows = f"flatten(transform({hits}, h -> {_per_match('h', _measured(m))}))"
        df = df.withColumns({name: F.expr(rows), "_text": F.expr(_woven("_pieces", m))})
    rows = df.select(*keep, F.inline(F.concat(*[F.col(n) for n in found])))
    return rows.filter(F.col("value").isNotNull())


def token_vocabulary(spark: SparkSession, strategy: str | list[str] = "light") -> DataFrame:
    """Every token a strategy can emit, with the two column markers."""
    rows = [(TITLE_TOKEN,), (DESCRIPTION_TOKEN,)] + [(t,) for t in strategy_tokens(strategy)]
    return local_rows(spark, rows, "token string").distinct()


def strategy_tokens(strategy: str | list[str]) -> list[str]:
    tokens: dict[str, None] = {}
    for m in measures_of(strategy):
        labels = BUCKETS[m.name][1] if m.name in BUCKETS else [m.name]
        for label in labels:
            tokens[f"[{label.replace(' ', '_')}]"] = None
    return list(tokens)
