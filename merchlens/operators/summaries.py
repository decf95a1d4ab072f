"""Descriptive statistics of feature columns with exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_rows

QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
ACCURACY = 10_000
# Rows between the ends of a bracket that one task may rank
INSIDE = 100_000


def _moments(df: DataFrame, features: list[str]):
    """One row with all moments and, per quantile, a bracket that must hold its exact value."""
    slack = 2.0 / ACCURACY
    aggs: list[Column] = []
    for i, name in enumerate(features):
        x = F.col(name).cast("double")
        marks = [min(max(q + d, 0.0), 1.0) for q in QUANTILES.values() for d in (-slack, slack)]
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.percentile_approx(x, F.array(*[F.lit(m) for m in marks]), F.lit(ACCURACY)).alias(f"marks{i}"),
        ]
    return df.agg(*aggs).first()


def _narrowed(df: DataFrame, brackets: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Brackets (feature, q, position, lo, hi) with at most ``INSIDE`` rows strictly between their ends, and the rows below each.

    A pass counts the rows below, at and between the ends of all brackets, and sketches the ranks around the wanted
    position among those between. Rows equal to an end are one value, however many they are, and need no narrowing.
    """
    slack = 2.0 / ACCURACY
    under = [0] * len(brackets)
    left_open = list(range(len(brackets)))
    while left_open:
        aggs: list[Column] = []
        for k in left_open:
            name, _, _, lo, hi = brackets[k]
            x = F.col(name).cast("double")
            aggs += [F.count_if(x < lo).alias(f"b{k}"), F.count_if(x == lo).alias(f"l{k}"), F.count_if((x > lo) & (x < hi)).alias(f"n{k}")]
        counts = df.agg(*aggs).first()
        wide = {}
        for k in left_open:
            _, _, pos, lo, hi = brackets[k]
            under[k], at_lo, between = counts[f"b{k}"], counts[f"l{k}"], counts[f"n{k}"]
            if between <= INSIDE or lo == hi:
                continue
            first = pos - under[k] - at_lo  # rank of the wanted position among the rows between the ends
            wide[k] = [first / between - slack, (first + 1) / between + slack]
        if not wide:
            break
        aggs = []
        for k, marks in wide.items():
            name, _, _, lo, hi = brackets[k]
            x = F.col(name).cast("double")
            at = F.array(*[F.lit(min(max(m, 0.0), 1.0)) for m in marks])
            aggs.append(F.percentile_approx(F.when((x > lo) & (x < hi), x), at, F.lit(ACCURACY)).alias(f"m{k}"))
        found = df.agg(*aggs).first()
        for k, (left, right) in wide.items():
            name, q_name, pos, lo, hi = brackets[k]
            low, high = found[f"m{k}"]
            brackets[k] = (name, q_name, pos, float(low) if left > 0 else lo, float(high) if right < 1 else hi)
        left_open = list(wide)
    return brackets, under


def describe_features(df: DataFrame, features: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max: one row per feature.

    Quartiles interpolate linearly between the two neighbouring order statistics.
    A sketch brackets each of them within 4/10000 of the ranks, and further sketches of
    what lies inside narrow the brackets until none holds more than ``INSIDE`` rows
    between its ends. Only the values of the brackets are counted and ranked, so the
    work of the largest task is bounded at any number of rows.
    """
    m = _moments(df, features)
    brackets, rows = [], []
    for i, name in enumerate(features):
        n, marks = m[f"n{i}"], m[f"marks{i}"]
        rows.append((name, n, m[f"mean{i}"], m[f"std{i}"], m[f"min{i}"], m[f"max{i}"]))
        if not n:
            continue
        for j, (q_name, q) in enumerate(QUANTILES.items()):
            brackets.append((name, q_name, q * (n - 1), float(marks[2 * j]), float(marks[2 * j + 1])))
    brackets, under = _narrowed(df, brackets)
    spark = df.sparkSession
    base = local_rows(
        spark, rows, "feature string, count long, mean double, std double, min double, max double"
    )
    if not brackets:
        return base.select("feature", "count", "mean", "std", "min", *[F.lit(None).cast("double").alias(q) for q in QUANTILES], "max")

    structs = []
    for k, (name, _, _, lo, hi) in enumerate(brackets):
        x = F.col(name).cast("double")
        structs.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(k).alias("k"), x.alias("value"))))
    plan = local_rows(
        spark,
        [(k, name, q, pos, under[k]) for k, (name, q, pos, _, _) in enumerate(brackets)],
        "k int, feature string, q string, pos double, below long",
    )
    inside = (
        df.select(F.explode(F.array_compact(F.array(*structs))).alias("s"))
        .groupBy("s.k", "s.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(plan), "k")
    )
    upto = F.sum("n").over(
        Window.partitionBy("k").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = inside.withColumn("end", F.col("below") + upto).withColumn("start", F.col("end") - F.col("n"))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("value")))

    exact = ranked.groupBy("feature", "q").agg(
        at_rank(F.floor("pos")).alias("lo"), at_rank(F.ceil("pos")).alias("hi"), F.first("pos").alias("pos")
    )
    found = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    checked = F.when(found.isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(found)
    wide = exact.withColumn("x", checked).groupBy("feature").pivot("q", list(QUANTILES)).agg(F.first("x"))
    return base.join(F.broadcast(wide), "feature", "left").select(
        "feature", "count", "mean", "std", "min", *QUANTILES, "max"
    )


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column the mean lengths, mean counts and mean ratios in percent."""
    means = []
    for c in columns:
        means.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(f"{c}_len_char").alias("mean_chars"),
                F.avg(f"{c}_len_words").alias("mean_words"),
                F.avg(f"{c}_num_digits").alias("mean_digits"),
                F.avg(f"{c}_num_punctuation").alias("mean_punctuation"),
                (F.avg(f"{c}_uppercase_ratio") * 100).alias("uppercase_pct"),
                (F.avg(f"{c}_digit_ratio") * 100).alias("digit_pct"),
            ).alias(f"s_{c}")
        )
    return df.agg(*means).select(F.inline(F.array(*[F.col(f"s_{c}") for c in columns])))
