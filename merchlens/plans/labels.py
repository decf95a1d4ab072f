"""Categories, class encoding, splits, signatures, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CANONICAL_CLASSES, CATEGORIES
from ..operators import labels as L
from ..operators import splits as P
from .registry import query
from .sqltext import quoted
from .standins import (
    CODED,
    CODED_KNOWN,
    CODES_SQL,
    PREDICTIONS,
    PROBS,
    PRODUCTS,
    coded_parts,
    predictions,
    probabilities,
    products,
    table,
)

CATEGORY = "category(code, name, short_name, group_name) AS (VALUES " + ", ".join(
    f"({c}, {quoted(n)}, {quoted(s)}, {quoted(g)})" for c, n, s, g in CATEGORIES
) + ")"


@query(
    "category_names",
    f"""WITH {CODED}, {CATEGORY} SELECT idx, prdtypecode, coalesce(name, prdtypecode::VARCHAR) AS category_name,
    coalesce(short_name, prdtypecode::VARCHAR) AS short_name FROM coded LEFT JOIN category ON prdtypecode = code""",
)
def category_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = coded_parts(spark, sf).select("idx", "prdtypecode")
    rows = L.with_category_name(L.with_category_name(rows), out="short_name", short=True)
    return rows.select("idx", "prdtypecode", "category_name", "short_name")


@query(
    "category_groups",
    f"WITH {CODED}, {CATEGORY} SELECT idx, prdtypecode, group_name AS category_group FROM coded LEFT JOIN category ON prdtypecode = code",
)
def category_groups(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_category_group(coded_parts(spark, sf).select("idx", "prdtypecode")).select("idx", "prdtypecode", "category_group")


@query(
    "category_labels",
    f"""WITH {CODED}, {CATEGORY}, named AS (SELECT idx, prdtypecode, coalesce(name, prdtypecode::VARCHAR) AS n
      FROM coded LEFT JOIN category ON prdtypecode = code), l AS (SELECT idx, n, prdtypecode || ': ' || n AS label FROM named)
    SELECT idx, label, CASE WHEN length(label) > 20 THEN left(label, 17) || '...' ELSE label END AS short_label,
           CASE WHEN length(n) > 12 THEN left(n, 9) || '...' ELSE n END AS plain_label FROM l""",
)
def category_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.with_category_name(coded_parts(spark, sf).select("idx", "prdtypecode"))
    code, name = F.col("prdtypecode"), F.col("category_name")
    return rows.select(
        "idx",
        L.category_label(code, name).alias("label"),
        L.category_label(code, name, max_length=20).alias("short_label"),
        L.category_label(code, name, show_code=False, max_length=12).alias("plain_label"),
    )


@query(
    "category_distribution",
    f"""WITH {CODED}, {CATEGORY}, c AS (SELECT prdtypecode AS code, count(*) AS count FROM coded GROUP BY ALL)
    SELECT c.code, coalesce(short_name, c.code::VARCHAR) AS name, count,
           round_even(count * 1.0::DOUBLE / sum(count) OVER () * 100, 2) AS percentage
    FROM c LEFT JOIN category USING (code)""",
)
def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return L.category_distribution(coded_parts(spark, sf))


@query(
    "unknown_categories",
    f"WITH {CODED} SELECT prdtypecode, count(*) AS rows FROM coded WHERE NOT list_contains({CODES_SQL}, prdtypecode) GROUP BY ALL",
)
def unknown_categories(spark: SparkSession, sf: str) -> DataFrame:
    return L.unknown_categories(coded_parts(spark, sf))


@query(
    "category_group_summary",
    f"""WITH {CODED}, {CATEGORY} SELECT group_name, count(*) AS rows, count(DISTINCT prdtypecode) AS categories,
    coalesce(array_to_string(list_sort(list(DISTINCT prdtypecode) FILTER (group_name IS NOT NULL)), ','), '') AS codes
    FROM coded LEFT JOIN category ON prdtypecode = code GROUP BY ALL""",
)
def category_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.group_summary(coded_parts(spark, sf))


@query("encode_labels", f"WITH {CODED_KNOWN} SELECT idx, prdtypecode, list_position({CODES_SQL}, prdtypecode) - 1 AS y FROM coded")
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.encode_labels(coded_parts(spark, sf, True).select("idx", "prdtypecode")).select("idx", "prdtypecode", "y")


@query("decode_labels", f"SELECT p_partkey AS idx, (p_size % 27)::INT AS y, {CODES_SQL}[(p_size % 27 + 1)::INT] AS prdtypecode FROM part")
def decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_size") % 27).cast("int").alias("y"))
    return L.decode_labels(rows)


_MODEL_ORDER = [3, 1, 4, 0, 5, 9, 2, 6, 8, 7]


@query(
    "reorder_probabilities",
    f"WITH {PROBS} SELECT idx, " + ", ".join(
        f"round(alpha[list_position({_MODEL_ORDER}, {c})], 6) AS p{c}" for c in range(10)
    ) + " FROM probs",
)
def reorder_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf).select("idx", L.reorder_probabilities(F.col("alpha"), _MODEL_ORDER, list(range(10))).alias("p"))
    return rows.select("idx", *[F.round(F.get("p", F.lit(c)), 6).alias(f"p{c}") for c in range(10)])


@query(
    "class_fingerprint",
    f"""WITH {CODED} , seen AS (SELECT DISTINCT prdtypecode FROM coded WHERE list_contains({CODES_SQL}, prdtypecode))
    SELECT left(sha256('[' || array_to_string(list_sort(list(prdtypecode)), ', ') || ']'), 16) AS classes_fp,
    count(*) AS classes FROM seen""",
)
def class_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of the known classes that occur in the data (at most 27 values)."""
    seen = coded_parts(spark, sf).filter(F.col("prdtypecode").isin(CANONICAL_CLASSES)).select("prdtypecode").distinct()
    codes = seen.agg(F.array_sort(F.collect_list("prdtypecode")).alias("codes"))
    return codes.select(L.fingerprint_column(F.col("codes")).alias("classes_fp"), F.size("codes").cast("long").alias("classes"))


def _ranked_sql(extra: str = "") -> str:
    return f"""ranked AS (SELECT doc_id AS idx, lang,
      row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS rn,
      count(*) OVER (PARTITION BY lang) AS n FROM documents{extra})"""


@query("stratified_split", f"WITH {_ranked_sql()} SELECT idx, lang, rn <= round(0.7::DOUBLE * n) AS in_first FROM ranked")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified_flag(products(spark, sf).select("idx", "lang"), "lang", "idx", 0.7)


_SPLIT = f"""{_ranked_sql()}, split AS (SELECT idx, lang, CASE WHEN rn <= round(0.7::DOUBLE * n) THEN 'train'
    WHEN rn <= round((0.7::DOUBLE + 0.15) * n) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query("train_val_test_split", f"WITH {_SPLIT} SELECT idx, lang, split FROM split")
def train_val_test(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign_split(products(spark, sf).select("idx", "lang"), "lang", "idx")


_LANE = "sum(('0x' || substr(md5(idx::VARCHAR), {}, 8))::BIGINT)"
_DIGESTS = f"""digests AS (SELECT split, count(*) AS rows, {_LANE.format(1)} AS lane_a, {_LANE.format(9)} AS lane_b
    FROM split GROUP BY split)"""


@query(
    "split_signature",
    f"""WITH {_SPLIT}, {_DIGESTS}, parts AS (SELECT list_sort(list(split || ':' || rows || ':' || lane_a || ':' || lane_b)) AS p FROM digests)
    SELECT left(sha256(array_to_string(p, '|')), 16) AS split_signature FROM parts""",
)
def split_signature(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_signature(P.assign_split(products(spark, sf).select("idx", "lang"), "lang", "idx"))


def _alignment_sql(left: str, right: str) -> str:
    """Report on two queries that give ``idx``; aligned as the counts say."""
    return f"""WITH a AS (SELECT idx, count(*) AS n FROM ({left}) GROUP BY idx), b AS (SELECT idx, count(*) AS n FROM ({right}) GROUP BY idx),
    r AS (SELECT coalesce(sum(a.n), 0)::BIGINT AS rows_left, coalesce(sum(b.n), 0)::BIGINT AS rows_right,
            count(*) FILTER (b.n IS NULL) AS missing_right, count(*) FILTER (a.n IS NULL) AS missing_left,
            count(*) FILTER (a.n <> b.n) AS different_multiplicity
          FROM a FULL JOIN b USING (idx))
    SELECT *, missing_right + missing_left + different_multiplicity = 0 AS aligned FROM r"""


@query("alignment_report", _alignment_sql("SELECT doc_id AS idx FROM documents", "SELECT doc_id AS idx FROM labels"))
def alignment_report(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"))
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"))
    return P.alignment_report(left, right)


_SIDES = {
    "orders and lines": ("SELECT o_orderkey AS idx FROM orders", "SELECT l_orderkey AS idx FROM lineitem"),
    "orders and their first lines": (
        "SELECT DISTINCT l_orderkey AS idx FROM lineitem", "SELECT l_orderkey AS idx FROM lineitem WHERE l_linenumber = 1"
    ),
}


@query("alignment_of_orders", " UNION ALL ".join(f"SELECT '{k}' AS sides, * FROM ({_alignment_sql(*v)})" for k, v in _SIDES.items()))
def alignment_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that occur several times on one side, and two sides that are aligned."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    every = lines.select(F.col("l_orderkey").alias("idx"))
    first = lines.filter(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("idx"))
    pairs = ((orders.select(F.col("o_orderkey").alias("idx")), every), (every.distinct(), first))
    parts = [P.alignment_report(*pair).select(F.lit(k).alias("sides"), "*") for k, pair in zip(_SIDES, pairs, strict=True)]
    return parts[0].unionByName(parts[1])


@query("refit_rows", f"WITH {_SPLIT} SELECT idx, lang, split FROM split WHERE split <> 'test'")
def refit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return P.refit_rows(P.assign_split(products(spark, sf).select("idx", "lang"), "lang", "idx"))


@query(
    "concat_score_tables",
    f"""WITH {PREDICTIONS}, {PRODUCTS}
    SELECT 'blending' AS source, idx, pred_alpha AS pred, NULL::VARCHAR AS lang FROM predictions
    UNION ALL SELECT 'stacking', idx, NULL, lang FROM products""",
)
def concat_score_tables(spark: SparkSession, sf: str) -> DataFrame:
    a = predictions(spark, sf).select("idx", F.col("pred_alpha").alias("pred"))
    b = products(spark, sf).select("idx", "lang")
    return P.concat_tables({"blending": a, "stacking": b})
