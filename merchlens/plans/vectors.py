"""Vocabulary, count and TF-IDF vectors, scaling, feature unions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_merge import blank, raw_text
from ..functions.text_stats import add_text_features
from ..operators.scaling import PopulationScaler
from ..operators.vectorize import Vectorizer, merged_union, sparse_entries, split_union, word_char_union
from ..session import local_rows
from .registry import query
from .sqltext import LETTER
from .standins import PRODUCTS, products, table
from .text_features import FEATURES, RAW_TEXT

# Vocabulary sizes of the exploratory vectorisers and of the word and character union
MAX_WORDS, UNION_WORDS, UNION_CHARS = 10_000, 250_000, 150_000

# Document texts and their n-grams; n_docs counts every document, empty ones too.
_WORD_GRAMS = f"""
docs AS (SELECT doc_id, regexp_extract_all(text, '[{LETTER}]{{2,}}') AS t FROM documents),
grams AS (SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM docs),
tfs AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL),
vocab AS (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM tfs GROUP BY term
          HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM documents)
          ORDER BY tf DESC, term LIMIT {MAX_WORDS})"""

_UNION_GRAMS = _WORD_GRAMS.replace("regexp_extract_all(text", "regexp_extract_all(lower(text)").replace(
    f"LIMIT {MAX_WORDS}", f"LIMIT {UNION_WORDS}"
)

_CHAR_GRAMS = f"""
chars AS (SELECT doc_id, string_split(regexp_replace(lower(text), '\\s\\s+', ' ', 'g'), '') AS c FROM documents),
cgrams AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])
    || list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])
    || list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4])) AS term FROM chars),
ctfs AS (SELECT doc_id, term, count(*) AS n FROM cgrams GROUP BY ALL),
cvocab AS (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM ctfs GROUP BY term HAVING count(*) >= 2
           ORDER BY tf DESC, term LIMIT {UNION_CHARS})"""


def _weights(tfs: str, vocab: str) -> str:
    return f"""SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM (
      SELECT doc_id, t.term, (1 + ln(n)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
      FROM {tfs} t JOIN {vocab} v USING (term))"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _counter() -> Vectorizer:
    return Vectorizer(kind="count", ngram_range=(1, 2), max_features=MAX_WORDS)


@query("vocabulary", f"WITH {_WORD_GRAMS} SELECT term, tf, df FROM vocab")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _counter().vocabulary(_documents(spark, sf), "text")


@query("count_vectors", f"WITH {_WORD_GRAMS} SELECT doc_id, term, n::DOUBLE AS value FROM tfs JOIN vocab USING (term)")
def count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return _counter().fit(docs, "text").entries(docs, "text", ["doc_id"])


@query(
    "tfidf_vectors",
    f"WITH {_WORD_GRAMS} SELECT doc_id, term, round(value, 6) AS value FROM ({_weights('tfs', 'vocab')})",
)
def tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    fitted = Vectorizer(ngram_range=(1, 2), max_features=MAX_WORDS).fit(docs, "text")
    return fitted.entries(docs, "text", ["doc_id"]).withColumn("value", F.round("value", 6))


@query(
    "word_char_union",
    f"""WITH {_UNION_GRAMS}, {_CHAR_GRAMS}
    SELECT 'word__' || term AS feature, count(*) AS documents, round(sum(value), 5) AS total FROM ({_weights("tfs", "vocab")}) GROUP BY ALL
    UNION ALL
    SELECT 'char__' || term, count(*), round(sum(value), 5) FROM ({_weights("ctfs", "cvocab")}) GROUP BY ALL""",
)
def word_char(spark: SparkSession, sf: str) -> DataFrame:
    """Total weight of every column of the word and character union."""
    docs = _documents(spark, sf)
    union = word_char_union("text", (3, 5), {"max_features": UNION_WORDS}, {"max_features": UNION_CHARS}).fit(docs)
    names = list(enumerate(union.feature_names()))
    columns = local_rows(spark, names, "term_idx int, feature string")
    entries = union.transform(docs).select(F.inline(sparse_entries(F.col("features"))))
    totals = entries.groupBy("term_idx").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("value"), 5).alias("total"))
    return totals.join(F.broadcast(columns), "term_idx").drop("term_idx")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "standard_scaler",
    "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in _NUMBERS
    ) + " FROM lineitem",
)
def standard_scaler(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_NUMBERS)
    scaled = PopulationScaler.fit(rows, _NUMBERS).transform(rows)
    return scaled.withColumns({c: F.round(c, 6) for c in _NUMBERS})


MANUAL = ["designation_len_char", "description_len_words", "description_digit_ratio"]


def _featured(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).withColumn("text", raw_text(F.col("designation"), F.col("description")))
    return add_text_features(rows, ["designation", "description"]).withColumn("description", blank(F.col("description")))


def _entries(rows: DataFrame) -> DataFrame:
    """Size and norm of each assembled vector."""
    values = vector_to_array(F.col("features"))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    filled = F.size(F.filter(values, lambda x: x != 0))
    return rows.select("idx", F.size(values).alias("columns"), filled.alias("non_zero"), F.round(F.sqrt(squares), 4).alias("norm"))


def _block_sql(name: str, column: str) -> str:
    """Vocabulary of one text column and the number of its terms in every row."""
    return f"""{name}_t AS (SELECT idx, regexp_extract_all(coalesce({column}, ''), '[{LETTER}]{{2,}}') AS t FROM texts),
    {name}_f AS (SELECT idx, term, count(*) AS n FROM (SELECT idx, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
      FROM {name}_t) GROUP BY ALL),
    {name}_v AS (SELECT term, sum(n) AS tf FROM {name}_f GROUP BY term HAVING count(*) >= 2
      AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM texts) ORDER BY tf DESC, term LIMIT {MAX_WORDS}),
    {name}_c AS (SELECT idx, count(*) AS filled FROM {name}_f JOIN {name}_v USING (term) GROUP BY ALL)"""


def _union_sql(blocks: dict[str, tuple[str, float]]) -> str:
    """Width, filled columns and norm of unit-length blocks next to scaled manual features."""
    means = ", ".join(f"avg({m}) AS mean{i}, stddev_pop({m}) AS std{i}" for i, m in enumerate(MANUAL))
    scaled = ", ".join(f"({m} - mean{i}) / std{i} AS s{i}" for i, m in enumerate(MANUAL))
    joins = " ".join(f"LEFT JOIN {b}_c ON {b}_c.idx = s.idx" for b in blocks)
    width = " + ".join(f"(SELECT count(*) FROM {b}_v)" for b in blocks)
    filled = " + ".join([f"coalesce({b}_c.filled, 0)" for b in blocks] + [f"(s{i} <> 0)::INT" for i in range(len(MANUAL))])
    squares = " + ".join(
        [f"CASE WHEN {b}_c.filled > 0 THEN {w * w!r} ELSE 0 END" for b, (_, w) in blocks.items()]
        + [f"s{i} * s{i}" for i in range(len(MANUAL))]
    )
    ctes = ", ".join(_block_sql(b, column) for b, (column, _) in blocks.items())
    return f"""WITH {PRODUCTS}, {FEATURES},
    texts AS (SELECT idx, designation, coalesce(description, '') AS description, {RAW_TEXT} AS text FROM products), {ctes},
    moments AS (SELECT {means} FROM features), s AS (SELECT idx, {scaled} FROM features, moments)
    SELECT s.idx AS idx, {width} + {len(MANUAL)} AS columns, {filled} AS non_zero, round(sqrt({squares}), 4) AS norm FROM s {joins}"""


@query("split_vectorizer", _union_sql({"a": ("designation", 1.2), "b": ("description", 1.0)}), ints=["columns", "non_zero"])
def split_vectorizer(spark: SparkSession, sf: str) -> DataFrame:
    rows = _featured(spark, sf)
    union = split_union("designation", "description", MANUAL, title_weight=1.2, max_features=MAX_WORDS)
    return _entries(union.fit(rows).transform(rows))


@query("merged_vectorizer", _union_sql({"a": ("text", 1.0)}), ints=["columns", "non_zero"])
def merged_vectorizer(spark: SparkSession, sf: str) -> DataFrame:
    rows = _featured(spark, sf)
    return _entries(merged_union("text", MANUAL, max_features=MAX_WORDS).fit(rows).transform(rows))
