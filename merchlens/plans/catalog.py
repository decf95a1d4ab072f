"""Sources and sinks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proba import argmax, array_sum
from ..operators.blending import model_log_losses, weights_from_log_loss
from ..operators.calibrate import temperature_grid
from ..operators.labels import fingerprint, join_labels
from ..operators.splits import split_signature
from ..schemas import LABEL, PRODUCT
from ..session import scratch_path
from ..sources.catalog import read_product_csv, with_image_path, write_product_csv
from ..sources.predictions import export_predictions, load_predictions
from ..sources.results import (
    fusion_values,
    load_fusion_params,
    load_model,
    load_results,
    save_fusion_params,
    save_model,
    save_results,
)
from .registry import query
from .standins import (
    MODELS,
    PROBS,
    PRODUCTS,
    RESULTS,
    experiment_results,
    logits,
    probabilities,
    products,
    sql_argmax,
    sql_nll,
    table,
)

_PRODUCT_ROWS = f"WITH {PRODUCTS} SELECT idx, designation, description, productid, imageid FROM products"


@query("catalog_scan", _PRODUCT_ROWS)
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(*PRODUCT.fieldNames())


@query("product_csv_roundtrip", _PRODUCT_ROWS)
def product_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "products-csv")
    write_product_csv(products(spark, sf).select(*PRODUCT.fieldNames()), path)
    return read_product_csv(spark, path)


@query(
    "features_labels_join",
    f"""WITH {PRODUCTS}
    SELECT p.idx, p.designation, l.quality AS prdtypecode FROM products p JOIN labels l ON p.idx = l.doc_id""",
)
def features_labels_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("prdtypecode"))
    labels = labels.select(*LABEL.fieldNames())
    return join_labels(products(spark, sf).select("idx", "designation"), labels)


@query(
    "prediction_export_roundtrip",
    f"""WITH {PROBS}
    SELECT idx, y AS y_true, {sql_argmax("alpha")} AS pred, len(alpha) AS classes,
           round(list_sum(alpha), 4) AS total, round(alpha[1], 4) AS p0 FROM probs""",
    ints=["classes"],
)
def prediction_export_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf).select("idx", F.col("alpha").alias("probs"), F.col("y").alias("y_true"))
    signature = split_signature(rows.withColumn("split", F.lit("val"))).first()[0]
    root, classes = scratch_path(spark, "exports"), list(range(10))
    export_predictions(rows, root, "alpha", "val", signature, classes, {"source": "embeddings"}, canonical=classes)
    fp = fingerprint(classes)
    loaded = load_predictions(spark, root, "alpha", "val", signature, fp, True, canonical_fingerprint=fp)
    p = F.col("probs").cast("array<double>")
    return loaded.select(
        "idx", F.col("y_true").cast("int"), argmax(p).alias("pred"), F.size("probs").alias("classes"),
        F.round(array_sum(p), 4).alias("total"), F.round(F.get(p, F.lit(0)), 4).alias("p0"),
    )


@query("results_csv_roundtrip", f"WITH {RESULTS} SELECT experiment, \"group\", f1_weighted, accuracy FROM results")
def results_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results-csv")
    results = experiment_results(spark, sf)
    save_results(results, path, {"source": "lineitem"})
    return load_results(spark, path, "experiment string, `group` string, f1_weighted double, accuracy double")


_GRID = [round(0.25 * i, 2) for i in range(1, 25)]
_GRID_SQL = "[" + ", ".join(map(str, _GRID)) + "]::DOUBLE[]"


def _sql_best_temperature(m: str) -> str:
    z = f"list_transform(z_{m}, lambda v: v / t)"
    nll = f"avg(list_max({z}) + ln(list_sum(list_transform({z}, lambda v: exp(v - list_max({z}))))) - z_{m}[y + 1] / t)"
    return (
        f"(SELECT arg_min(t, nll) FROM (SELECT t, {nll} AS nll "
        f"FROM logits, (SELECT unnest({_GRID_SQL}) AS t) GROUP BY t))"
    )


@query(
    "fusion_params_roundtrip",
    f"""WITH {PROBS},
    losses AS (""" + " UNION ALL ".join(
        f"SELECT '{m}' AS model, avg({sql_nll(m, 'y')}) AS ll, {_sql_best_temperature(m)} AS temperature FROM probs"
        for m in MODELS
    ) + """)
    SELECT 'text' AS modality, model, round((1 / ll) / (SELECT sum(1 / ll) FROM losses), 6) AS weight, temperature
    FROM losses""",
)
def fusion_params_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    z = logits(spark, sf)
    best = None
    for m in MODELS:
        grid = temperature_grid(z, f"z_{m}", "y", _GRID).agg(F.min_by("temperature", "nll").alias("temperature"))
        grid = grid.withColumn("model", F.lit(m))
        best = grid if best is None else best.unionByName(grid)
    weights = weights_from_log_loss(model_log_losses(probabilities(spark, sf), list(MODELS), "y"))
    params = weights.join(best, "model").withColumn("modality", F.lit("text"))
    path = scratch_path(spark, "fusion-params")
    save_fusion_params(params, path)
    loaded = load_fusion_params(spark, path)
    fusion_values(loaded, "text")
    return loaded.withColumn("weight", F.round("weight", 6))


@query("model_store_roundtrip")
def model_store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("label").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("x"),
    )
    stages = [
        VectorAssembler(inputCols=["x"], outputCol="features"),
        LogisticRegression(labelCol="y", regParam=0.01, maxIter=20, standardization=False),
    ]
    path = scratch_path(spark, "model")
    save_model(Pipeline(stages=stages).fit(rows), path)
    return load_model(path).transform(rows).select("idx", "y", F.col("prediction").cast("int").alias("pred"))


@query(
    "image_paths",
    f"""WITH {PRODUCTS} SELECT idx, 'images/image_' || imageid || '_product_' || productid || '.jpg' AS image_path
    FROM products""",
)
def image_paths(spark: SparkSession, sf: str) -> DataFrame:
    return with_image_path(products(spark, sf), "images/").select("idx", "image_path")
