"""Batch and stream scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proba import array_sum
from ..functions.text_merge import merge_title_description
from ..schemas import DOCUMENT
from ..session import scratch_path
from ..streaming import scoring as S
from .models import with_language_index
from .pixels import label_centroids
from .probabilities import CLASSES, WEIGHTS, spread_out, sql_blend, sql_spread
from .registry import query
from .standins import MODELS, PROBS, as_products, logits, products, sql_argmax, table


TEMPERATURES = {"alpha": 1.0, "beta": 1.0, "gamma": 1.0}


@query(
    "batch_scoring",
    f"WITH {PROBS}, b AS (SELECT idx, {sql_blend(WEIGHTS)} AS p FROM probs) SELECT {sql_spread('p', 'idx')}, {CLASSES}[{sql_argmax('p')} + 1] AS label_pred FROM b",
)
def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.score_calibrated(logits(spark, sf), {m: f"z_{m}" for m in MODELS}, TEMPERATURES, WEIGHTS, "p")
    named = S.name_predictions(rows, "p", CLASSES)
    return spread_out(named, "p", ["idx", "label_pred"])


def _centroid_model(centroids: list[list[float]]):
    """Builds a function that turns a batch of vectors into class scores."""

    def make_predict():
        matrix = np.array(centroids, dtype="float64")

        def predict(inputs: np.ndarray) -> np.ndarray:
            return np.asarray(inputs, dtype="float64") @ matrix.T

        return predict

    return make_predict


@query(
    "batch_model_scoring",
    """WITH cent AS (SELECT label AS k, list(x ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(embedding[pos + 1]::DOUBLE), 9) AS x
        FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id AS idx, k, list_sum(list_transform(c, lambda x, i: x * embedding[i]::DOUBLE)) AS z FROM embeddings, cent)
    SELECT idx, arg_max(k, z) AS pred, round(max(z), 6) AS score FROM s GROUP BY ALL""",
    longs=["pred"],
)
def batch_model_scoring(spark: SparkSession, sf: str) -> DataFrame:
    predict = S.batch_predictor(_centroid_model(label_centroids(spark, sf)), batch_size=64, input_width=64)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    scored = rows.withColumn("z", predict(F.col("embedding")))
    return scored.select(
        "idx", (F.array_position("z", F.array_max("z")) - 1).alias("pred"), F.round(F.array_max("z"), 6).alias("score")
    )


def request_model(spark: SparkSession, sf: str):
    text = merge_title_description(F.col("designation"), F.col("description"), "[SEP]")
    rows = with_language_index(products(spark, sf)).withColumn("text", text)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 12),
        LogisticRegression(labelCol="y", regParam=0.01, maxIter=10, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_requests(model, requests: DataFrame) -> DataFrame:
    text = merge_title_description(F.col("designation"), F.col("description"), "[SEP]")
    accepted = S.accept_requests(requests).withColumn("text", text)
    scored = model.transform(accepted).withColumn("probs", vector_to_array("probability"))
    named = S.name_predictions(scored, "probs", [10, 2705, 2280, 2403])
    return named.select("idx", "designation", "label_pred", "category_name", "p_max", "probs")


@query("stream_scoring")
def stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    model = request_model(spark, sf)
    stream = S.request_stream(spark, sf, DOCUMENT, "documents.parquet")
    out = S.run_scoring_stream(
        as_products(stream),
        lambda requests: score_requests(model, requests),
        scratch_path(spark, "scores"),
        scratch_path(spark, "scores-checkpoint"),
    )
    return out.select("idx", "label_pred", "category_name", F.round(array_sum(F.col("probs")), 6).alias("total"))


