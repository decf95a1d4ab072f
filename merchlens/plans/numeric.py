"""Measurements in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import BUCKETS, UNIT_FACTORS, UNIT_SPELLINGS
from ..functions.numeric_tokens import (
    MODES,
    Measure,
    bucket_label,
    extract_measures,
    measures_of,
    merge_numeric_text,
    replace_measures,
    token_vocabulary,
    unit_factor,
    unit_symbol,
)
from .registry import query
from .sqltext import quoted
from .standins import MEASURE_TEXTS, measure_texts, table


# --- the same rewriting as a chain of DuckDB CTEs ------------------------------------------------
def _sql_map(entries: dict[str, object]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v) if isinstance(v, str) else repr(float(v))}" for k, v in entries.items()) + "}"


def sql_unit(u: str) -> str:
    return f"coalesce({_sql_map(UNIT_SPELLINGS)}[lower({u})], lower({u}))"


def sql_factor(u: str) -> str:
    return f"coalesce({_sql_map(UNIT_FACTORS)}[{sql_unit(u)}], 1.0::DOUBLE)"


def sql_label(value: str, measure: str) -> str:
    if measure not in BUCKETS:
        return quoted(measure)
    bounds, labels = BUCKETS[measure]
    uppers = [repr(b) for b in bounds[1:]] + ["'inf'::DOUBLE"]
    cases = " ".join(
        f"WHEN {value} >= {lo!r} AND {value} < {hi} THEN {quoted(label)}" for lo, hi, label in zip(bounds, uppers, labels)
    )
    return f"CASE {cases} ELSE {quoted(measure + 'inconnu')} END"


def _number(x: str) -> str:
    return f"try_cast(replace({x}, ',', '.') AS DOUBLE)"


def _pattern(m: Measure) -> str:
    return quoted(rf"(?i)\b{m.core}\b")


class _Step:
    """Column expressions of one pattern; match i is addressed inside a list lambda."""

    def __init__(self, m: Measure, text: str):
        self.m, self.text = m, text
        found = {f"g{j}": f"regexp_extract_all({text}, {_pattern(m)}, {g})" for j, g in enumerate(m.values)}
        if m.unit is not None and m.name != "numero":
            found["u"] = f"regexp_extract_all({text}, {_pattern(m)}, {m.unit})"
        self.found = found

    def base(self, j: int) -> str:
        factor = f" * {sql_factor('u[i]')}" if "u" in self.found else ""
        return f"({_number(f'g{j}[i]')}{factor})"

    def product(self, parts: list[str]) -> str:
        return "(" + " * ".join(parts) + ")"

    def token(self) -> str:
        m = self.m
        if m.name not in BUCKETS:
            return quoted(f"[{m.name}]")
        wrap = lambda v: f"'[' || replace({sql_label(v, m.name)}, ' ', '_') || ']'"
        if not m.is_range:
            return wrap(self.product([self.base(j) for j in range(len(m.values))]))
        low, high = wrap(self.base(0)), wrap(self.base(1))
        return f"CASE WHEN g0[i] <> '' THEN 'entre ' || {low} || ' et ' || {high} ELSE {high} END"

    def rows(self) -> str:
        m = self.m
        unit = sql_unit("u[i]") if "u" in self.found else "NULL::VARCHAR"
        raws = [_number(f"g{j}[i]") for j in range(len(m.values))]
        bases = [self.base(j) for j in range(len(m.values))]
        if m.name not in BUCKETS:
            pairs = [(raws[0], raws[0])]
        elif m.is_range:
            pairs = list(zip(raws, bases))
        else:
            pairs = [(self.product(raws), self.product(bases))]
        cells = [
            f"{{'measure': {quoted(m.name)}, 'value': {raw}, 'unit': {unit}, 'base_value': {base}, 'label': {sql_label(base, m.name)}}}"
            for raw, base in pairs
        ]
        return "[" + ", ".join(cells) + "]"


def sql_chain(source: str, columns: list[str], strategy, keep: list[str], collect: bool = False) -> tuple[str, str]:
    """CTEs that rewrite the columns pattern by pattern; returns (ctes, last name)."""
    plain = ", ".join(f"replace(replace(coalesce({c}, ''), '²', '2'), '³', '3') AS {c}" for c in columns)
    ctes = [f"n0 AS (SELECT {', '.join(keep)}, {plain}{', [] AS found' if collect else ''} FROM {source})"]
    last = "n0"
    for k, m in enumerate(measures_of(strategy)):
        for c in columns:
            step = _Step(m, c)
            groups = ", ".join(f"{e} AS {n}" for n, e in step.found.items())
            ctes.append(f"{last}m AS (SELECT *, {groups}, string_split_regex({c}, {_pattern(m)}) AS pieces FROM {last})")
            others = [x for x in columns if x != c]
            woven = (
                f"array_to_string(list_transform(pieces, lambda p, i: p || CASE WHEN i <= len(g0) THEN {step.token()} ELSE '' END), '')"
            )
            extra = ""
            if collect:
                rows = f"list_transform(range(1, len(g0) + 1), lambda i: {step.rows()})"
                extra = f", {'found || ' if k else ''}flatten({rows}) AS found"
            name = f"n{k}{c[:5]}"
            ctes.append(f"{name} AS (SELECT {', '.join(keep + others)}, {woven} AS {c}{extra} FROM {last}m)")
            last = name
    return ",\n".join(ctes), last


def _replace_sql(strategy) -> str:
    ctes, last = sql_chain("measured", ["text"], strategy, ["idx"])
    return f"WITH {MEASURE_TEXTS},\n{ctes}\nSELECT idx, text AS tokens FROM {last}"


def _replace(strategy):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = measure_texts(spark, sf).select("idx", "text")
        return replace_measures(rows, ["text"], strategy).withColumnRenamed("text", "tokens")

    return run


for _mode in MODES:
    query(f"numeric_tokens_{_mode}", _replace_sql(_mode))(_replace(_mode))

CUSTOM = ["length", "weight", "date"]
query("numeric_tokens_custom", _replace_sql(CUSTOM))(_replace(CUSTOM))

_MERGE_CTES, _MERGE_LAST = sql_chain("measured", ["designation", "description"], "light", ["idx"])


@query(
    "numeric_title_merge",
    f"WITH {MEASURE_TEXTS},\n{_MERGE_CTES}\nSELECT idx, '[TITRE] ' || designation || ' [DESC] ' || description AS text FROM {_MERGE_LAST}",
)
def numeric_title_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = measure_texts(spark, sf).select("idx", "designation", "description")
    return merge_numeric_text(rows).select("idx", "text")


_EX_CTES, _EX_LAST = sql_chain("measured", ["text"], "full", ["idx"], collect=True)


@query(
    "measure_extraction",
    f"""WITH {MEASURE_TEXTS},\n{_EX_CTES},
    hits AS (SELECT idx, unnest(found) AS f FROM {_EX_LAST})
    SELECT idx, f.measure AS measure, round(f.value, 6) AS value, f.unit AS unit, round(f.base_value, 6) AS base_value,
           f.label AS label FROM hits WHERE f.value IS NOT NULL""",
)
def measure_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract_measures(measure_texts(spark, sf).select("idx", "text"), "text", ["idx"])
    return rows.withColumns({"value": F.round("value", 6), "base_value": F.round("base_value", 6)})


@query(
    "unit_bucket_labels",
    f"""SELECT p_partkey AS idx, u AS spelling, {sql_unit("u")} AS unit, round(p_retailprice * {sql_factor("u")}, 6) AS base_value,
    {sql_label(f"(p_retailprice * {sql_factor('u')})", "weight")} AS label
    FROM part, (SELECT unnest(['grammes', 'kilo', 'tonne', 'KG', 'livre']) AS u)""",
)
def unit_bucket_labels(spark: SparkSession, sf: str) -> DataFrame:
    spellings = F.array(*[F.lit(u) for u in ("grammes", "kilo", "tonne", "KG", "livre")])
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_retailprice", F.explode(spellings).alias("spelling"))
    rows = rows.withColumn("unit", unit_symbol(F.col("spelling")))
    rows = rows.withColumn("base_value", F.col("p_retailprice") * unit_factor(F.col("unit")))
    return rows.select(
        "idx", "spelling", "unit", F.round("base_value", 6).alias("base_value"), bucket_label(F.col("base_value"), "weight").alias("label")
    )


def _vocabulary_sql(strategy: str) -> str:
    tokens = ["[TITRE]", "[DESC]"]
    for m in measures_of(strategy):
        for label in BUCKETS[m.name][1] if m.name in BUCKETS else [m.name]:
            t = f"[{label.replace(' ', '_')}]"
            if t not in tokens:
                tokens.append(t)
    values = ", ".join(f"({quoted(t)})" for t in tokens)
    return f"""WITH {MEASURE_TEXTS},\n{_MERGE_CTES},
    merged AS (SELECT '[TITRE] ' || designation || ' [DESC] ' || description AS text FROM {_MERGE_LAST}),
    seen AS (SELECT unnest(regexp_extract_all(text, '\\[[^\\[\\] ]+\\]')) AS token FROM merged),
    counts AS (SELECT token, count(*) AS uses FROM seen GROUP BY token)
    SELECT v.token, coalesce(c.uses, 0) AS uses FROM (VALUES {values}) v(token) LEFT JOIN counts c USING (token)"""


@query("token_vocabulary", _vocabulary_sql("light"))
def vocabulary_use(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of the strategy with its number of uses in the rewritten texts."""
    merged = merge_numeric_text(measure_texts(spark, sf).select("idx", "designation", "description"))
    seen = merged.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\[\] ]+\]"), F.lit(0))).alias("token"))
    uses = seen.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return token_vocabulary(spark, "light").join(uses, "token", "left").na.fill(0, ["uses"])
