"""Late fusion: weights, blends, configuration sweeps, stacking features, contributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.proba import argmax, at, negative_log_likelihood, normalize, ranked, rescale, weighted_sum
from ..session import local_rows
from .metrics import class_scores, score_summary


def check_weights(models: list[str], weights: dict[str, float]) -> dict[str, float]:
    """Names must match both ways; weights are scaled to sum to 1."""
    if not models or not weights:
        raise ValueError("models and weights must not be empty")
    missing, extra = sorted(set(models) - set(weights)), sorted(set(weights) - set(models))
    if missing:
        raise KeyError(f"no weight for {missing}")
    if extra:
        raise KeyError(f"weights for unknown models {extra}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {m: weights[m] / total for m in models}


def model_log_losses(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """Mean log loss of each model's probability column: one pass, one row per model."""
    means = [F.avg(negative_log_likelihood(F.col(m), F.col(y))).alias(f"l{i}") for i, m in enumerate(models)]
    cells = [F.struct(F.lit(m).alias("model"), F.col(f"l{i}").alias("log_loss")) for i, m in enumerate(models)]
    return df.agg(*means).select(F.inline(F.array(*cells)))


def weights_from_log_loss(losses: DataFrame) -> DataFrame:
    """Inverse log losses scaled to sum to 1 (one row per model)."""
    inverse = 1.0 / F.col("log_loss")
    return losses.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))


def blend_columns(models: list[str], weights: dict[str, float]) -> Column:
    """Weighted mean of probability columns of the same row; nothing is shuffled."""
    w = check_weights(models, weights)
    return rescale(weighted_sum([F.col(m) for m in models], [w[m] for m in models]))


def blend_scores(scores: DataFrame, weights: dict[str, float], n_classes: int, key: str = "idx") -> DataFrame:
    """Blend a long score table (key, model, probs).

    Each class is one sum, so partial sums are combined before the single shuffle by
    key. A key that lacks one of the models, or has it twice, fails the query.
    """
    w = check_weights(list(weights), weights)
    table = F.create_map(*[F.lit(x) for pair in w.items() for x in pair])
    rows = scores.withColumn("_w", F.try_element_at(table, F.col("model")))
    sums = [F.sum(F.col("_w") * F.get("probs", F.lit(i))).alias(f"_c{i}") for i in range(n_classes)]
    each = [F.count_if(F.col("model") == m).alias(f"_n{j}") for j, m in enumerate(w)]
    out = rows.groupBy(key).agg(*each, *sums)
    complete = reduce(lambda a, b: a & b, [F.col(f"_n{j}") == 1 for j in range(len(w))])
    probs = F.array(*[F.col(f"_c{i}") for i in range(n_classes)])
    checked = F.when(complete, probs).otherwise(
        F.raise_error(F.concat(F.lit("incomplete scores for "), F.col(key).cast("string"))).cast("array<double>")
    )
    return out.select(key, rescale(checked).alias("probs"))


def model_subsets(models: list[str], smallest: int = 2) -> list[list[str]]:
    return [list(c) for n in range(smallest, len(models) + 1) for c in combinations(models, n)]


def configuration_scores(scored: DataFrame) -> DataFrame:
    """Weighted F1 and log loss of each configuration, from rows (configuration, y_true, probs)."""
    nll = negative_log_likelihood(F.col("probs"), F.col("y_true"))
    counts = (
        scored.withColumn("y_pred", argmax(F.col("probs")))
        .groupBy("configuration", "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(nll).alias("nll"))
    )
    by = ["configuration"]
    f1 = score_summary(class_scores(counts, by), by).select("configuration", "f1_weighted")
    loss = counts.groupBy("configuration").agg((F.sum("nll") / F.sum("n")).alias("log_loss"))
    return f1.join(loss, "configuration")


def blend_sweep(
    df: DataFrame, models: list[str], y: str, is_eval: Column, configurations: list[list[str]] | None = None,
    weights_on_fit_rows_only: bool = False,
) -> DataFrame:
    """Weights, weighted F1 and log loss of several blends, measured on the evaluation rows.

    Weights come from log losses over all rows, or only over the non-evaluation rows
    with ``weights_on_fit_rows_only``. All blends are scored in one pass.
    """
    configurations = configurations or model_subsets(models)
    fit_rows = df.filter(~is_eval) if weights_on_fit_rows_only else df
    losses = {r["model"]: r["log_loss"] for r in model_log_losses(fit_rows, models, y).collect()}
    entries, weight_rows = [], []
    for members in configurations:
        name = " + ".join(members)
        inverse = {m: 1.0 / losses[m] for m in members}
        total = sum(inverse.values())
        w = {m: v / total for m, v in inverse.items()}
        blend = normalize(weighted_sum([F.col(m) for m in members], [w[m] for m in members]))
        entries.append(F.struct(F.lit(name).alias("configuration"), blend.alias("probs")))
        weight_rows.append((name, *[w.get(m, 0.0) for m in models]))
    scored = df.filter(is_eval).select(F.col(y).alias("y_true"), F.inline(F.array(*entries)))
    summary = configuration_scores(scored)
    names = ", ".join(f"w_{m} double" for m in models)
    weights = local_rows(df.sparkSession, weight_rows, f"configuration string, {names}")
    return F.broadcast(weights).join(summary, "configuration")


def stack_features(df: DataFrame, models: list[str], out: str = "stacked") -> DataFrame:
    """Probability vectors side by side in one array."""
    return df.withColumn(out, F.concat(*[F.col(m) for m in models]))


def stack_tables(tables: list[DataFrame], key: str = "idx", probs: str = "probs", out: str = "stacked") -> DataFrame:
    """Join score tables on their key and concatenate the vectors."""
    named = [t.select(key, F.col(probs).alias(f"_p{i}")) for i, t in enumerate(tables)]
    joined = reduce(lambda a, b: a.join(b, key), named)
    return stack_features(joined, [f"_p{i}" for i in range(len(tables))], out).drop(
        *[f"_p{i}" for i in range(len(tables))]
    )


def predict_labels(df: DataFrame, probs: str, classes: list[int], out: str = "label_pred") -> DataFrame:
    lookup = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.get(lookup, argmax(F.col(probs))))


def with_contributions(df: DataFrame, final: str, text: str, image: str, classes: list[int]) -> DataFrame:
    """Predicted label and the three probabilities of the predicted class."""
    lookup = F.array(*[F.lit(c) for c in classes])
    df = df.withColumn("_pred", argmax(F.col(final)))
    return df.withColumns(
        {
            "label_pred": F.get(lookup, F.col("_pred")),
            "P_final": at(F.col(final), F.col("_pred")),
            "P_text": at(F.col(text), F.col("_pred")),
            "P_image": at(F.col(image), F.col("_pred")),
        }
    ).drop("_pred")


def top_classes(df: DataFrame, final: str, text: str, image: str, keep: list[str], k: int = 5) -> DataFrame:
    """The k most probable classes of every row, ranked inside the row."""
    rows = df.select(*keep, F.col(text), F.col(image), F.inline(ranked(F.col(final), k)))
    return rows.select(
        *keep,
        "rank",
        F.col("pos").alias("class_idx"),
        F.col("p").alias("P_final"),
        at(F.col(text), F.col("pos")).alias("P_text"),
        at(F.col(image), F.col("pos")).alias("P_image"),
    )
