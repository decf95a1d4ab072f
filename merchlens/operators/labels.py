"""Categories, class encoding, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CANONICAL_CLASSES, category_dim, class_dim


def join_labels(products: DataFrame, labels: DataFrame, key: str = "idx") -> DataFrame:
    return products.join(labels, key, "inner")


def with_category_name(
    df: DataFrame, code: str = "prdtypecode", out: str = "category_name", short: bool = False
) -> DataFrame:
    """Category name by code; an unknown code is shown as text."""
    names = category_dim(df.sparkSession).select(
        F.col("code").alias(code), F.col("short_name" if short else "name").alias("_name")
    )
    named = df.join(F.broadcast(names), code, "left")
    return named.withColumn(out, F.coalesce("_name", F.col(code).cast("string"))).drop("_name")


def with_category_group(df: DataFrame, code: str = "prdtypecode", out: str = "category_group") -> DataFrame:
    groups = category_dim(df.sparkSession).select(F.col("code").alias(code), F.col("group_name").alias(out))
    return df.join(F.broadcast(groups), code, "left")


def category_label(code: Column, name: Column, show_code: bool = True, max_length: int | None = None) -> Column:
    label = F.concat(code.cast("string"), F.lit(": "), name) if show_code else name
    if not max_length:
        return label
    cut = F.concat(F.substring(label, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(label) > max_length, cut).otherwise(label)


def category_distribution(
    df: DataFrame, code: str = "prdtypecode", short: bool = True, sort_by: str = "count"
) -> DataFrame:
    """Rows and share per category. The total is taken over the grouped counts, not over rows."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("count"))
    share = F.bround(F.col("count") / F.sum("count").over(Window.partitionBy()) * 100, 2)
    out = with_category_name(counts, code, "name", short)
    out = out.select(F.col(code).alias("code"), "name", "count", share.alias("percentage"))
    order = {"count": [F.desc("count"), "code"], "code": ["code"], "name": ["name", "code"]}[sort_by]
    return out.orderBy(*order)


def unknown_categories(df: DataFrame, code: str = "prdtypecode") -> DataFrame:
    """Codes of the data that the category table does not know, with their row counts."""
    known = category_dim(df.sparkSession).select(F.col("code").alias(code))
    return df.groupBy(code).agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(known), code, "left_anti")


def group_summary(df: DataFrame, code: str = "prdtypecode") -> DataFrame:
    """Per category group: rows, distinct categories seen, and the sorted list of known codes.

    Codes without a category form the null group; they may be many, so they are counted but not listed.
    """
    known = F.when(F.col("group_name").isNotNull(), F.col(code))
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("rows"))
    return (
        with_category_group(counts, code, "group_name")
        .groupBy("group_name")
        .agg(
            F.sum("rows").alias("rows"),
            F.count(F.lit(1)).alias("categories"),
            F.array_join(F.array_sort(F.collect_list(known)).cast("array<string>"), ",").alias("codes"),
        )
    )


def encode_labels(df: DataFrame, code: str = "prdtypecode", out: str = "y", classes: list[int] | None = None) -> DataFrame:
    """Canonical class index of every code; an unknown code fails the query."""
    dim = class_dim(df.sparkSession, classes).select(F.col("code").alias(code), F.col("class_idx").alias("_idx"))
    message = F.concat(F.lit("unknown class "), F.col(code).cast("string"))
    checked = F.when(F.col("_idx").isNull(), F.raise_error(message).cast("int")).otherwise(F.col("_idx"))
    return df.join(F.broadcast(dim), code, "left").withColumn(out, checked).drop("_idx")


def decode_labels(df: DataFrame, idx: str = "y", out: str = "prdtypecode", classes: list[int] | None = None) -> DataFrame:
    lookup = F.array(*[F.lit(c) for c in classes or CANONICAL_CLASSES])
    return df.withColumn(out, F.element_at(lookup, F.col(idx) + 1))


def reorder_probabilities(probs: Column, model_classes: list[int], classes: list[int] | None = None) -> Column:
    """Permute a probability array from a model's class order to the canonical one."""
    classes = classes or CANONICAL_CLASSES
    if sorted(model_classes) != sorted(classes):
        raise AssertionError("model classes and canonical classes are different sets")
    if list(model_classes) == list(classes):
        return probs
    position = {c: i for i, c in enumerate(model_classes)}
    order = F.array(*[F.lit(position[c]) for c in classes])
    return F.transform(order, lambda i: F.get(probs, i))


def fingerprint(classes: list[int]) -> str:
    return hashlib.sha256(json.dumps([int(c) for c in classes]).encode()).hexdigest()[:16]


def fingerprint_column(codes: Column) -> Column:
    """The same fingerprint computed in Spark over an ordered array of codes."""
    text = F.concat(F.lit("["), F.array_join(codes.cast("array<string>"), ", "), F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, 16)
