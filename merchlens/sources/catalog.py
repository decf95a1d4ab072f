"""Product and label tables, image paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LABEL, PRODUCT, require_columns

_CSV = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_product_csv(spark: SparkSession, path: str, schema: T.StructType = PRODUCT) -> DataFrame:
    """Products from quoted CSV whose first column is the row id; no inference pass."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_product_csv(spark, path, LABEL)


def write_product_csv(df: DataFrame, path: str) -> None:
    df.write.options(**_CSV).csv(path)


def image_path(imageid: Column, productid: Column, root: str) -> Column:
    name = F.format_string("image_%d_product_%d.jpg", imageid.cast("long"), productid.cast("long"))
    return F.concat_ws("/", F.lit(root.rstrip("/")), name)


def with_image_path(df: DataFrame, root: str, out: str = "image_path") -> DataFrame:
    require_columns(df, ["imageid", "productid"])
    return df.withColumn(out, image_path(F.col("imageid"), F.col("productid"), root))
