"""Text preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.text_merge import build_text, fill_text_nulls, merge_title_description, raw_text
from . import sqltext as S
from .registry import query
from .standins import MEASURE_TEXTS, PRODUCTS, measure_texts, products, table


def _measured(column: str) -> str:
    return f"WITH {MEASURE_TEXTS} SELECT idx, {column} AS clean FROM measured"


def _documents(column: str) -> str:
    return f"SELECT doc_id, {column} AS clean FROM documents"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query("fill_text_nulls", f"WITH {PRODUCTS} SELECT idx, coalesce(designation, '') AS designation, coalesce(description, '') AS description FROM products")
def fill_nulls(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("idx", "designation", "description")
    return fill_text_nulls(rows, ["designation", "description"])


@query(
    "merge_title_description",
    f"""WITH {PRODUCTS} SELECT idx, designation || ' ' || coalesce(description, '') AS plain,
    designation || ' [SEP] ' || coalesce(description, '') AS separated FROM products""",
)
def merge_titles(spark: SparkSession, sf: str) -> DataFrame:
    t, d = F.col("designation"), F.col("description")
    return products(spark, sf).select(
        "idx", merge_title_description(t, d).alias("plain"), merge_title_description(t, d, "[SEP]").alias("separated")
    )


_T, _D = S.strip("designation"), S.strip("coalesce(description, '')")
_RAW = S.strip(f"{_T} || ' ' || {_D}")


@query("raw_text", f"WITH {PRODUCTS} SELECT idx, {_RAW} AS text_raw FROM products")
def raw_texts(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select("idx", raw_text(F.col("designation"), F.col("description")).alias("text_raw"))


@query(
    "model_input_text",
    f"""WITH {PRODUCTS}, t AS (SELECT idx, {_RAW} AS both_sides, {_D} AS one_side FROM products)
    SELECT idx, CASE WHEN both_sides = '' THEN '[EMPTY]' ELSE both_sides END AS both_sides,
           CASE WHEN one_side = '' THEN '[EMPTY]' ELSE one_side END AS one_side FROM t""",
)
def model_input_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("idx", "designation", "description")
    both = rows.withColumn("both_sides", build_text(rows))
    only = both.drop("designation")
    return only.withColumn("one_side", build_text(only)).select("idx", "both_sides", "one_side")


@query("repair_double_encoding", "SELECT doc_id, text AS clean, true AS was_broken FROM documents WHERE regexp_matches(text, '[À-ÿ¡-¿]') UNION ALL SELECT doc_id, text, false FROM documents WHERE NOT regexp_matches(text, '[À-ÿ¡-¿]')")
def repair_double_encoding(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = documents(spark, sf).select("doc_id", broken.alias("broken"))
    return rows.select("doc_id", C.fix_mojibake(F.col("broken")).alias("clean"), F.col("broken").rlike("[ÂÃ]").alias("was_broken"))


@query("fix_encoding", "SELECT doc_id, text AS clean FROM documents")
def fix_encoding(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return documents(spark, sf).select("doc_id", C.fix_encoding(broken).alias("clean"))


def _unescape_sql(x: str) -> str:
    for entity, char in C.BASIC_ENTITIES:
        x = f"replace({x}, {S.quoted(entity)}, {S.quoted(char)})"
    return x


@query("unescape_basic_entities", f"SELECT page_id, {_unescape_sql('html')} AS clean FROM pages")
def unescape_basic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.unescape_basic_entities(F.col("html")).alias("clean"))


# the entities of the page table; the last one also occurs without its semicolon
_PAGE_ENTITIES = "replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


@query("unescape_html", f"SELECT page_id, regexp_replace({_PAGE_ENTITIES}, '&amp;?', '&', 'g') AS clean FROM pages")
def unescape_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.unescape_html(F.col("html")).alias("clean"))


@query("normalize_unicode", "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS clean FROM documents")
def normalize_unicode(spark: SparkSession, sf: str) -> DataFrame:
    decomposed = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return documents(spark, sf).select("doc_id", C.normalize_unicode(decomposed).alias("clean"))


@query("remove_html_tags", f"SELECT page_id, {S.tags('html')} AS clean FROM pages")
def remove_html_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.remove_html_tags(F.col("html")).alias("clean"))


@query("lowercase", _documents("lower(text)"))
def lowercase(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.lower("text").alias("clean"))


def _on_measures(step):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return measure_texts(spark, sf).select("idx", step(F.col("text")).alias("clean"))

    return run


for _name, _step, _rules in (
    ("merge_dimensions", C.merge_dimensions, C.DIMENSION_RULES),
    ("merge_units", C.merge_units, C.UNIT_RULES),
    ("merge_durations", C.merge_durations, C.DURATION_RULES),
    ("merge_age_ranges", lambda c: C.merge_age_ranges(C.merge_durations(c)), C.DURATION_RULES + C.AGE_RULES),
    ("tag_years", C.tag_years, C.YEAR_RULES),
):
    query(_name, _measured(S.rewrite("text", _rules)))(_on_measures(_step))

_CHARS = "(SELECT doc_id, string_split(text, '') AS chars FROM documents)"
_PUNCT = S.lone_marks(S.dots_list("chars"))


@query("remove_punctuation", f"SELECT doc_id, {S.collapse(_PUNCT)} AS clean FROM {_CHARS}")
def remove_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", C.clean_text(F.col("text"), remove_punctuation=True).alias("clean"))


@query("remove_boilerplate", _documents(S.collapse(S.boilerplate("text"))))
def remove_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", C.clean_text(F.col("text"), remove_boilerplate=True).alias("clean"))


_ALL_FILTERS = dict.fromkeys(("stopwords", "single_letters", "single_digits", "pure_punctuation"), True)


@query("filter_tokens", _documents(S.filter_tokens("text", **_ALL_FILTERS)))
def filter_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", C.filter_tokens(F.col("text"), **_ALL_FILTERS).alias("clean"))


@query("collapse_whitespace", _documents(S.collapse("text")))
def collapse_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", C.collapse_whitespace(F.col("text")).alias("clean"))


_ALL_FLAGS = dict.fromkeys(C.CLEANING_FLAGS, True)
_RULES = C.DIMENSION_RULES + C.UNIT_RULES + C.DURATION_RULES + C.AGE_RULES + C.YEAR_RULES
_STEPS = S.rewrite("lower(text)", _RULES)
_FULL = S.collapse(S.filter_tokens(S.boilerplate(S.lone_marks(S.dots_list("chars"))), **_ALL_FILTERS))


@query(
    "clean_text_all_flags",
    f"WITH {MEASURE_TEXTS}, c AS (SELECT idx, string_split({_STEPS}, '') AS chars FROM measured) SELECT idx, {_FULL} AS clean FROM c",
)
def clean_text_all_flags(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_frame(measure_texts(spark, sf).select("idx", "text"), {"clean": F.col("text")}, **_ALL_FLAGS).drop("text")


_TIDY = "lower(regexp_replace(nfc_normalize(text), '<[^>]+>', ' ', 'g'))"


@query(
    "final_clean",
    f"SELECT doc_id, {S.collapse(_PUNCT)} AS clean FROM (SELECT doc_id, string_split({_TIDY}, '') AS chars FROM documents)",
)
def final_clean(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_frame(documents(spark, sf), {"clean": F.col("text")}, **C.FINAL_FLAGS).drop("text")


def _column_sql(x: str) -> str:
    return S.collapse(S.tags(f"nfc_normalize(coalesce({x}, ''))"))


@query(
    "clean_columns",
    f"WITH {PRODUCTS} SELECT idx, {_column_sql('designation')} AS c_designation, {_column_sql('description')} AS c_description FROM products",
)
def clean_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("idx", "designation", "description")
    return C.clean_columns(rows, ["designation", "description"], "c").drop("designation", "description")
