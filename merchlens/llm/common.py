"""Shared Spark pieces: narrow input, tables in the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_to_table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the folder all executors share and read back: a lost executor costs a read, not a recomputation."""
    return persist_to_table(df, name, **options)


def among(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose whole number ``key`` is one in column ``name`` of ``keys``.

    The keys travel as bitmaps to all tasks, 4 KB for each 32,768 numbers from the least to the largest that hold one, so
    ``df`` is not shuffled. Null keys are among none.
    """
    bits = keys.groupBy(F.bitmap_bucket_number(name).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("_bits"))
    found = df.withColumns({"_bucket": F.bitmap_bucket_number(key), "_at": F.bitmap_bit_position(key)}).join(F.broadcast(bits), "_bucket")
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    return found.filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*df.columns)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest connected node.

    Alternates the large-star and small-star steps until no edge changes. Each step is a minimum per node, which
    is combined before the shuffle, and a join back on the node, which AQE splits where one node has most edges.
    Null ends are ignored; an empty input gives an empty result.
    """
    edges = edges.select("a", "b").filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges = written(edges, name)
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").selectExpr("b AS a", "m AS b").filter("a <> b")
        edges = written(small.union(root.selectExpr("a", "m AS b")).distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.selectExpr("a AS node", "b AS component").union(edges.selectExpr("b AS node", "b AS component")).distinct()
