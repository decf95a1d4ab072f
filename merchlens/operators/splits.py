"""Seeded stratified splits, split signatures, alignment checks, unions.

A stratified split needs the rows of a class in hash order and takes the first n.
Ranking a class in one window would put a third of the data into one task, so the
cut is found in two steps: counts per (class, hash prefix) locate the prefix that
holds the cut row, and only the rows of that prefix (1/65536 of a class) are ranked.
The split itself is then a comparison per row, without any shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import lookup_join

PREFIX = 4  # hex digits, 65536 prefixes


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def _ordered(hash_column: str, key: str) -> Column:
    return F.struct(F.col(hash_column).alias("h"), F.col(key).alias("k"))


def _cut_rows(df: DataFrame, label: str, key: str, fractions: list[float], seed: int) -> DataFrame:
    """Per class and fraction the (hash, key) of the last row inside that first part of the class."""
    rows = df.select(label, key, row_hash(key, seed).alias("_hash"))
    rows = rows.withColumn("_prefix", F.substring("_hash", 1, PREFIX))
    counts = rows.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    in_class = Window.partitionBy(label)
    running = in_class.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = counts.withColumn("_upto", F.sum("_n").over(running)).withColumn("_total", F.sum("_n").over(in_class))
    located = (
        cumulated.select("*", F.posexplode(F.array(*[F.lit(f) for f in fractions])).alias("_cut", "_fraction"))
        .withColumn("_take", F.round(F.col("_fraction") * F.col("_total")).cast("long"))
        .filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
        .select(label, "_prefix", "_cut", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    ranked = lookup_join(rows, located, [label, "_prefix"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(label, "_prefix", "_cut").orderBy("_hash", key))
    )
    last = [
        F.max(F.when(F.col("_cut") == i, _ordered("_hash", key))).alias(f"_last{i}") for i in range(len(fractions))
    ]
    return ranked.filter(F.col("_rn") == F.col("_rank")).groupBy(label).agg(*last)


def _with_parts(df: DataFrame, label: str, key: str, fractions: list[float], seed: int) -> DataFrame:
    """Flags _in0, _in1, ... for the first part of every class at each fraction."""
    cuts = _cut_rows(df, label, key, fractions, seed)
    joined = lookup_join(df, cuts, [label], "left").withColumn("_hash", row_hash(key, seed))
    flags = {
        f"_in{i}": F.coalesce(_ordered("_hash", key) <= F.col(f"_last{i}"), F.lit(False)) for i in range(len(fractions))
    }
    return joined.withColumns(flags).drop("_hash", *[f"_last{i}" for i in range(len(fractions))])


def stratified_flag(
    df: DataFrame, label: str, key: str, fraction: float, seed: int = 42, out: str = "in_first"
) -> DataFrame:
    """True for the first round(fraction * n) rows of every class in seeded hash order."""
    return _with_parts(df, label, key, [fraction], seed).withColumnRenamed("_in0", out)


def assign_split(
    df: DataFrame, label: str, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42, out: str = "split"
) -> DataFrame:
    """train / val / test, stratified by label and reproducible from the seed."""
    df = _with_parts(df, label, key, [train, train + val], seed)
    name = F.when(F.col("_in0"), "train").when(F.col("_in1"), "val").otherwise("test")
    return df.withColumn(out, name).drop("_in0", "_in1")


def split_digests(df: DataFrame, key: str = "idx", split: str = "split") -> DataFrame:
    """Order-free digest of the ids of each split: row count and two sums of hash halves."""
    digest = F.md5(F.col(key).cast("string"))

    def lane(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")

    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), lane(1).alias("lane_a"), lane(9).alias("lane_b")
    )


def split_signature(df: DataFrame, key: str = "idx", split: str = "split") -> DataFrame:
    """One-row signature over the digests of all splits (three rows at most)."""
    part = F.concat_ws(":", F.col(split), F.col("rows"), F.col("lane_a"), F.col("lane_b"))
    parts = split_digests(df, key, split).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select(F.substring(F.sha2(F.array_join("parts", "|"), 256), 1, 16).alias("split_signature"))


def alignment_report(left: DataFrame, right: DataFrame, key: str = "idx") -> DataFrame:
    """Rows on both sides, ids missing on either side; aligned when nothing is missing."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, key, "full_outer")
    n = both.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("rows_left"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("rows_right"),
        F.count_if(F.col("_r").isNull()).alias("missing_right"),
        F.count_if(F.col("_l").isNull()).alias("missing_left"),
        F.count_if(F.col("_l") != F.col("_r")).alias("different_multiplicity"),
    )
    ok = (F.col("missing_left") + F.col("missing_right") + F.col("different_multiplicity")) == 0
    return n.withColumn("aligned", ok)


def refit_rows(df: DataFrame, split: str = "split", parts: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Rows used for the final refit: the union of the named splits, in one scan."""
    return df.filter(F.col(split).isin(*parts))


def concat_tables(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of tables with different columns; each row carries the name of its table."""
    out = None
    for name, df in tables.items():
        tagged = df.select(F.lit(name).alias(tag), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
