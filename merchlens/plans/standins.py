"""Test tables in the shapes the operators expect, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CANONICAL_CLASSES
from ..functions.proba import argmax, softmax
from ..session import spread, use_all_cores

# Rows of narrow tables that a task gets: each becomes a long text, 64 pixels, an image or a vector of a model
TASK_ROWS = 1 << 14


def table(spark: SparkSession, sf: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A test table. Text, part and vector tables feed row-wise work, so every core gets a share."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if name in ("part", "embeddings"):
        return spread(df, TASK_ROWS)
    return use_all_cores(df) if name in ("documents", "pages") else df


# --- products: first line of a document is the title, the rest the description ---------------
def as_products(documents: DataFrame) -> DataFrame:
    newline = F.instr("text", "\n")
    rest = F.substring(F.col("text"), newline + 1, F.length("text"))
    return documents.select(
        F.col("doc_id").alias("idx"),
        F.substring_index("text", "\n", 1).alias("designation"),
        F.when(newline > 0, rest).alias("description"),
        F.col("doc_id").alias("productid"),
        (F.col("doc_id") * 31 + 7).alias("imageid"),
        "lang",
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    return as_products(table(spark, sf, "documents"))


PRODUCTS = """
products AS (
  SELECT doc_id AS idx,
         CASE WHEN strpos(text, chr(10)) > 0 THEN left(text, strpos(text, chr(10)) - 1) ELSE text END AS designation,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS description,
         doc_id AS productid, doc_id * 31 + 7 AS imageid, lang
  FROM documents)"""

# --- category codes: the 27 canonical codes in turn, then three codes nobody knows -----------
CODES_SQL = "[" + ", ".join(str(c) for c in CANONICAL_CLASSES) + "]"


def code_of(position: Column) -> Column:
    known = F.array(*[F.lit(c) for c in CANONICAL_CLASSES])
    at = F.pmod(position, F.lit(30)).cast("int")
    return F.when(at < 27, F.get(known, at)).otherwise(at + 9000)


def coded_parts(spark: SparkSession, sf: str, known_only: bool = False) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_retailprice")
    known = F.array(*[F.lit(c) for c in CANONICAL_CLASSES])
    if known_only:
        return parts.withColumn("prdtypecode", F.get(known, F.pmod("idx", F.lit(27)).cast("int")))
    return parts.withColumn("prdtypecode", code_of(F.col("idx")))


CODED = f"""
coded AS (
  SELECT p_partkey AS idx, p_retailprice,
         CASE WHEN p_partkey % 30 < 27 THEN {CODES_SQL}[(p_partkey % 30 + 1)::INT]
              ELSE (p_partkey % 30 + 9000)::INT END AS prdtypecode
  FROM part)"""
CODED_KNOWN = f"""
coded AS (
  SELECT p_partkey AS idx, p_retailprice, {CODES_SQL}[(p_partkey % 27 + 1)::INT] AS prdtypecode FROM part)"""


# --- text with measures, written from the numeric columns of part ----------------------------
def measure_texts(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")

    def n(c: Column) -> Column:
        return c.cast("long").cast("string")

    title = F.concat(
        F.col("p_name"), F.lit(" "), n(s), F.lit(" x "), n(k % 90 + 1), F.lit(" X "), n(k % 13 + 1), F.lit(" cm "),
        n(k % 40), F.lit(","), n(k % 10), F.lit(" kg "), n(k % 30 + 1), F.lit("-"), n(k % 30 + 20), F.lit(" mm"),
    )
    description = F.concat(
        F.lit("Lot "), n(s), F.lit(" pcs "), n(k % 9), F.lit(" - "), n(k % 9 + 6), F.lit(" ans et plus, "),
        n(k % 12), F.lit(" mois "), n(F.pow(F.lit(2), k % 8)), F.lit(" go "), n(k % 300), F.lit(" euros "),
        n(k % 500 + 1), F.lit(" litres "), n(s), F.lit(" x "), n(k % 200), F.lit(" m "), n(k % 30), F.lit(" m2 "),
        n(k % 220), F.lit(" W "), n(k % 12), F.lit(" V "), n(k % 3000), F.lit(" mAh "), n(k % 7), F.lit(" kw "),
        n(k % 60), F.lit(" cartes "), n(k % 23 + 1), F.lit(" h 24 h / 24 7 j/7 "), n(k % 99), F.lit(" jours "),
        n(k % 250 + 1800), F.lit(" no "), n(k % 33), F.lit(" prix "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit(" 01/02/"), n(k % 40 + 1990), F.lit(" L x H x L "), n(k % 100), F.lit("% bio."),
    )
    return table(spark, sf, "part").select(
        k.alias("idx"), title.alias("designation"), description.alias("description"), F.concat(title, F.lit(" "), description).alias("text")
    )


MEASURE_TEXTS = """
measured0 AS (
  SELECT p_partkey AS idx,
    p_name || ' ' || p_size || ' x ' || (p_partkey % 90 + 1) || ' X ' || (p_partkey % 13 + 1) || ' cm '
    || (p_partkey % 40) || ',' || (p_partkey % 10) || ' kg ' || (p_partkey % 30 + 1) || '-' || (p_partkey % 30 + 20)
    || ' mm' AS designation,
    'Lot ' || p_size || ' pcs ' || (p_partkey % 9) || ' - ' || (p_partkey % 9 + 6) || ' ans et plus, '
    || (p_partkey % 12) || ' mois ' || (1 << (p_partkey % 8)::INT) || ' go ' || (p_partkey % 300) || ' euros '
    || (p_partkey % 500 + 1) || ' litres ' || p_size || ' x ' || (p_partkey % 200) || ' m ' || (p_partkey % 30) || ' m2 '
    || (p_partkey % 220) || ' W ' || (p_partkey % 12) || ' V ' || (p_partkey % 3000) || ' mAh ' || (p_partkey % 7) || ' kw '
    || (p_partkey % 60) || ' cartes ' || (p_partkey % 23 + 1) || ' h 24 h / 24 7 j/7 ' || (p_partkey % 99) || ' jours '
    || (p_partkey % 250 + 1800) || ' no ' || (p_partkey % 33) || ' prix ' || p_retailprice::DECIMAL(12,2)
    || ' 01/02/' || (p_partkey % 40 + 1990) || ' L x H x L ' || (p_partkey % 100) || '% bio.' AS description
  FROM part),
measured AS (SELECT idx, designation, description, designation || ' ' || description AS text FROM measured0)"""

# --- logits: slices of ten embedding values stand for the outputs of pseudo-models -------------
MODELS = {"alpha": 0, "beta": 10, "gamma": 20}
N_CLASSES = 10


def logits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    slices = [
        F.transform(F.slice("embedding", start + 1, N_CLASSES), lambda x: x.cast("double") * 8).alias(f"z_{m}")
        for m, start in MODELS.items()
    ]
    return rows.select(F.col("vec_id").alias("idx"), F.col("label").alias("y"), *slices)


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    z = logits(spark, sf)
    return z.select("idx", "y", *[softmax(F.col(f"z_{m}")).alias(m) for m in MODELS])


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table: one row per id and model."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("probs")) for m in MODELS])
    return probabilities(spark, sf).select("idx", "y", F.inline(cells))


def sql_softmax(x: str) -> str:
    shifted = f"list_transform({x}, lambda v: exp(v - list_max({x})))"
    return f"list_transform({shifted}, lambda v: v / greatest(list_sum({shifted}), 1e-12))"


LOGITS = "logits AS (SELECT vec_id AS idx, label AS y, " + ", ".join(
    f"list_transform(embedding[{s + 1}:{s + N_CLASSES}], lambda x: x::DOUBLE * 8) AS z_{m}" for m, s in MODELS.items()
) + " FROM embeddings)"
PROBS = LOGITS + ",\nprobs AS (SELECT idx, y, " + ", ".join(f"{sql_softmax(f'z_{m}')} AS {m}" for m in MODELS) + " FROM logits)"


def sql_argmax(x: str) -> str:
    return f"(list_position({x}, list_max({x})) - 1)"


def sql_nll(p: str, y: str) -> str:
    return f"(-ln(least(greatest({p}[{y} + 1], 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"


# --- pixels: an 8 x 8 image per part -----------------------------------------------------------
def pixels(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    k, i, s = F.col("p_partkey"), F.col("i"), F.col("p_size")
    inside = (i % 8 >= k % 4) & (i % 8 <= k % 4 + s % 5) & (F.floor(i / 8) >= k % 3) & (F.floor(i / 8) < k % 3 + s % 6)
    return cells.select(
        k.alias("image_id"),
        F.floor(i / 8).cast("int").alias("row"),
        (i % 8).cast("int").alias("col"),
        F.when(inside, (k * 7 + i * 13) % 256).otherwise(250).cast("int").alias("r"),
        F.when(inside, (k * 11 + i * 29 + s) % 256).otherwise(250).cast("int").alias("g"),
        F.when(inside, (k * 3 + i * 5 + s * 17) % 256).otherwise(250).cast("int").alias("b"),
    )


PIXELS = """
cells AS (SELECT p_partkey AS k, p_size AS s, unnest(range(0, 64)) AS i FROM part),
marked AS (SELECT *, (i % 8 >= k % 4 AND i % 8 <= k % 4 + s % 5 AND i // 8 >= k % 3 AND i // 8 < k % 3 + s % 6) AS fg FROM cells),
pixels AS (
  SELECT k AS image_id, (i // 8)::INT AS row, (i % 8)::INT AS col,
         CASE WHEN fg THEN (k * 7 + i * 13) % 256 ELSE 250 END::INT AS r,
         CASE WHEN fg THEN (k * 11 + i * 29 + s) % 256 ELSE 250 END::INT AS g,
         CASE WHEN fg THEN (k * 3 + i * 5 + s * 17) % 256 ELSE 250 END::INT AS b
  FROM marked)"""

# --- experiment results: one configuration per flag, status and month of lineitem ----------------
def experiment_results(spark: SparkSession, sf: str) -> DataFrame:
    month = F.month("l_shipdate")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus", month).alias("experiment"), F.col("l_returnflag").alias("group"))
        .agg(
            F.round(F.avg("l_discount") * 10, 9).alias("f1_weighted"),
            F.round(F.avg("l_tax") * 10, 9).alias("accuracy"),
        )
    )


RESULTS = """
results AS (
  SELECT l_returnflag || '-' || l_linestatus || '-' || month(l_shipdate) AS experiment, l_returnflag AS "group",
         round(avg(l_discount) * 10, 9) AS f1_weighted, round(avg(l_tax) * 10, 9) AS accuracy
  FROM lineitem GROUP BY ALL)"""


def grid_results(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.when(F.col("l_linestatus") == "O", "tfidf").otherwise("count").alias("vectorizer"),
            F.when(F.col("l_returnflag") == "A", "split").otherwise("merged").alias("strategy"),
            F.when(line % 2 == 0, "logreg").otherwise("svm").alias("model"),
            (F.lit(1.0) + (line % 3) * 0.5).alias("title_weight"),
            (F.col("l_suppkey") % 2 == 0).alias("use_features"),
        )
        .agg(F.round(F.avg("l_discount") * 10, 9).alias("f1_score"), F.round(F.avg("l_tax") * 10, 9).alias("accuracy"))
    )


GRID = """
grid AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'tfidf' ELSE 'count' END AS vectorizer,
         CASE WHEN l_returnflag = 'A' THEN 'split' ELSE 'merged' END AS strategy,
         CASE WHEN l_linenumber % 2 = 0 THEN 'logreg' ELSE 'svm' END AS model,
         1.0::DOUBLE + (l_linenumber % 3) * 0.5::DOUBLE AS title_weight,
         l_suppkey % 2 = 0 AS use_features,
         round(avg(l_discount) * 10, 9) AS f1_score, round(avg(l_tax) * 10, 9) AS accuracy
  FROM lineitem GROUP BY ALL)"""


# --- coefficients: mean embedding per label, one row per position --------------------------------
def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .select(F.col("label").alias("class_idx"), F.posexplode("embedding").alias("pos", "x"))
        .groupBy("class_idx", "pos")
        .agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("coef"))
        .withColumn("feature", F.format_string("%s__%02d", F.when(F.col("pos") < 32, "title").otherwise("desc"), "pos"))
    )


COEFFICIENTS = """
coefficients AS (
  SELECT label AS class_idx, pos, round(avg(embedding[pos + 1]::DOUBLE), 9) AS coef,
         CASE WHEN pos < 32 THEN 'title' ELSE 'desc' END || '__' || lpad(pos::VARCHAR, 2, '0') AS feature
  FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) GROUP BY ALL)"""


# --- predictions: arg-max of two pseudo-models against the label ---------------------------------
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = probabilities(spark, sf)
    return p.select("idx", F.col("y").alias("y_true"), *[argmax(F.col(m)).alias(f"pred_{m}") for m in MODELS])


PREDICTIONS = PROBS + ",\npredictions AS (SELECT idx, y AS y_true, " + ", ".join(
    f"{sql_argmax(m)} AS pred_{m}" for m in MODELS
) + " FROM probs)"
