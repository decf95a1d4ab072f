"""Result tables, fusion parameters and fitted models on disk."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FUSION_PARAM
from ..session import local_rows


def save_results(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A result table (one row per run) as one CSV file, with a JSON row beside it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    if metadata is not None:
        text = local_rows(df.sparkSession, [(json.dumps(metadata, default=str),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_metadata")


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_result_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path.rstrip("/") + "_metadata").first()["value"])


def save_fusion_params(params: DataFrame, path: str) -> None:
    """Weights and temperatures, one row per model."""
    params.select(*FUSION_PARAM.fieldNames()).coalesce(1).write.mode("overwrite").json(path)


def load_fusion_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FUSION_PARAM).json(path)


def fusion_values(params: DataFrame, modality: str) -> tuple[dict[str, float], dict[str, float]]:
    """(weights, temperatures) of one modality; a model without temperature is already calibrated."""
    rows = params.filter(F.col("modality") == modality).collect()
    weights = {r["model"]: r["weight"] for r in rows}
    temperatures = {r["model"]: r["temperature"] for r in rows if r["temperature"] is not None}
    return weights, temperatures


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
