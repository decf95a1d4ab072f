"""Explicit schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("designation", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("productid", T.LongType()),
        T.StructField("imageid", T.LongType()),
    ]
)

LABEL = T.StructType(
    [T.StructField("idx", T.LongType()), T.StructField("prdtypecode", T.IntegerType())]
)

FUSION_PARAM = T.StructType(
    [
        T.StructField("modality", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
    ]
)

EXPORT_META = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("split_name", T.StringType()),
        T.StructField("split_signature", T.StringType()),
        T.StructField("classes_fp", T.StringType()),
        T.StructField("num_classes", T.IntegerType()),
        T.StructField("num_samples", T.LongType()),
        T.StructField("has_y_true", T.BooleanType()),
        T.StructField("probs_shape", T.ArrayType(T.LongType())),
        T.StructField("probs_dtype", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data_path", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Plan-time check; no job is run."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; have {df.columns}")
    return df


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
