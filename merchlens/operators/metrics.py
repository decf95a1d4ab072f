"""Classification metrics from confusion counts.

Every metric starts from counts per (true, predicted) pair. That is one
map-side-combined aggregate over the predictions; all later steps see at most
classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.proba import negative_log_likelihood
from .labels import with_category_name


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_scores(confusion: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class in truth or prediction; 0 on division by zero."""
    zero, hit = F.lit(0).cast("long"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("_s"), zero.alias("_p"), hit.cast("long").alias("_t")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("_s"), F.col("n").alias("_p"), zero.alias("_t")),
    )
    counts = confusion.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("_s").alias("support"), F.sum("_p").alias("predicted"), F.sum("_t").alias("hits")
    )
    precision = _safe_ratio(F.col("hits"), F.col("predicted"))
    recall = _safe_ratio(F.col("hits"), F.col("support"))
    f1 = _safe_ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    return counts.select(
        *by, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits"
    )


def score_summary(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, weighted F1, macro F1 and row count from per-class scores."""
    return scores.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.sum("support").alias("rows"),
    )


def evaluate(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: list[str] = ()) -> DataFrame:
    return score_summary(class_scores(confusion_counts(df, y_true, y_pred, by), by), by)


def log_loss(df: DataFrame, probs: str, y_true: str, by: list[str] = ()) -> DataFrame:
    nll = negative_log_likelihood(F.col(probs), F.col(y_true))
    return df.groupBy(*by).agg(F.avg(nll).alias("log_loss"))


def classification_report(df: DataFrame, y_true: str, y_pred: str, named: bool = True) -> DataFrame:
    """Per-class rows with names, then accuracy, macro and weighted averages."""
    scores = class_scores(confusion_counts(df, y_true, y_pred))
    rows = scores.withColumn("kind", F.lit("class"))
    if named:
        rows = with_category_name(rows, "label", "name", short=True)
    else:
        rows = rows.withColumn("name", F.col("label").cast("string"))
    rows = rows.select("kind", "name", "precision", "recall", "f1", "support")
    w = F.col("support") / F.sum("support").over(Window.partitionBy())
    weighted = scores.withColumn("_w", w)
    total = weighted.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.sum(F.col(m) * F.col("_w")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )

    def line(kind: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(kind).alias("name"), p.alias("precision"),
            r.alias("recall"), f.alias("f1"), F.col("support").alias("support"),
        )

    acc = F.col("accuracy")
    lines = [line("accuracy", acc, acc, acc)]
    for kind in ("macro", "weighted"):
        lines.append(line(kind, *[F.col(f"{kind}_{m}") for m in ("precision", "recall", "f1")]))
    return rows.unionByName(total.select(F.inline(F.array(*lines))))


def top_confusions(confusion: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent wrong predictions of every true class, with their share of the class."""
    in_class = Window.partitionBy("y_true")
    share = confusion.withColumn("share", F.col("n") / F.sum("n").over(in_class))
    order = in_class.orderBy(F.desc("n"), "y_pred")
    return (
        share.filter(F.col("y_true") != F.col("y_pred"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def confusion_matrix(confusion: DataFrame, classes: list[int]) -> DataFrame:
    """Pivoted counts, one column per predicted class."""
    return confusion.groupBy("y_true").pivot("y_pred", classes).agg(F.sum("n")).na.fill(0)


def best_and_worst(scores: DataFrame, k: int) -> DataFrame:
    """The k best and k worst classes by F1."""
    best = Window.orderBy(F.desc("f1"), "label")
    worst = Window.orderBy("f1", "label")
    ranked = scores.withColumn("best_rank", F.row_number().over(best)).withColumn("worst_rank", F.row_number().over(worst))
    return ranked.filter((F.col("best_rank") <= k) | (F.col("worst_rank") <= k))


def confusion_rate(confusion: DataFrame, true_class: int, pred_class: int) -> DataFrame:
    """Percentage of one class predicted as another; 0 when the class is empty."""
    is_true = F.col("y_true") == true_class
    total = F.coalesce(F.sum(F.when(is_true, F.col("n"))), F.lit(0))
    hit = F.coalesce(F.sum(F.when(is_true & (F.col("y_pred") == pred_class), F.col("n"))), F.lit(0))
    return confusion.agg(
        F.lit(true_class).alias("true_class"),
        F.lit(pred_class).alias("pred_class"),
        _safe_ratio(hit * 100.0, total).alias("rate"),
    )


def f1_delta(new: DataFrame, reference: DataFrame) -> DataFrame:
    """Per-class F1 of two models and their difference."""
    a = new.select("label", F.col("f1").alias("f1_new"))
    b = reference.select("label", F.col("f1").alias("f1_ref"))
    both = a.join(b, "label", "full_outer").na.fill(0.0, ["f1_new", "f1_ref"])
    return both.withColumn("delta", F.col("f1_new") - F.col("f1_ref"))


def modality_importance(coefficients: DataFrame, n_classes: int) -> DataFrame:
    """Mean absolute coefficient of the text half and the image half, per class and overall."""
    is_text = F.col("pos") < n_classes
    size = F.abs("coef")
    text, image = F.avg(F.when(is_text, size)), F.avg(F.when(~is_text, size))
    per_class = coefficients.rollup("class_idx").agg(
        text.alias("text_importance"), image.alias("image_importance"), (text / (text + image)).alias("text_rate")
    )
    return per_class.orderBy(F.desc("text_rate"), "class_idx")


def top_features(coefficients: DataFrame, k: int) -> DataFrame:
    """The k largest coefficients of each class by size, L1-normalised within the class."""
    in_class = Window.partitionBy("class_idx")
    norm = coefficients.withColumn("coef_norm", F.col("coef") / F.sum(F.abs("coef")).over(in_class))
    order = in_class.orderBy(F.desc(F.abs("coef")), "feature")
    return norm.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_row_per_run(history: DataFrame, name: str, metric: str, tiebreak: str) -> DataFrame:
    """The whole row with the best metric of every run (max_by keeps state per group small)."""
    row = F.struct(*[F.col(c) for c in history.columns if c != name])
    order = F.struct(F.col(metric), (-F.col(tiebreak)).alias("t"))
    best = history.groupBy(name).agg(F.max_by(row, order).alias("r"))
    return best.select(name, "r.*")


def best_values_per_run(history: DataFrame, name: str, metric: str, tiebreak: str) -> DataFrame:
    """Per column the first non-null value in best-first order."""
    order = F.struct(F.col(metric), (-F.col(tiebreak)).alias("t"))
    columns = [c for c in history.columns if c != name]
    return history.groupBy(name).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )
