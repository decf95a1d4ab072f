"""Classical classifiers on Spark ML with the reference parameterisation.

The usual strength parameter C divides the summed loss; Spark averages the loss, so
the matching penalty is 1 / (C * n) on unscaled features.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, linear
from .boosting import BoostedTrees
from .linear import LinearModel
from .lookup import lookup_join
from .metrics import evaluate


@dataclass
class Columns:
    features: str = "features"
    label: str = "y"
    weight: str | None = None


def _common(c: Columns) -> dict:
    return {"featuresCol": c.features, "labelCol": c.label} | ({"weightCol": c.weight} if c.weight else {})


# Fixed value: stopping tolerance of the linear solvers
TOLERANCE = 1e-4


def logistic_regression(
    df: DataFrame, cols: Columns = Columns(), C: float = 1.0, max_iter: int = 1000, n: int | None = None, tolerance: float = TOLERANCE
):
    n = df.count() if n is None else n
    return LogisticRegression(
        **_common(cols), family="multinomial", regParam=1.0 / (C * n), standardization=False, maxIter=max_iter, tol=tolerance
    ).fit(df)


def _ovr(classifier, cols: Columns, parallelism: int):
    extra = {"weightCol": cols.weight} if cols.weight else {}
    return OneVsRest(
        classifier=classifier, featuresCol=cols.features, labelCol=cols.label, parallelism=parallelism, **extra
    )


def linear_svm(
    df: DataFrame, cols: Columns = Columns(), C: float | None = None, alpha: float = 1e-4,
    max_iter: int = 1000, parallelism: int = 4, n: int | None = None,
):
    """One-vs-rest SVM with plain hinge loss: penalty ``alpha``, or 1 / (C * n) when C is given."""
    if C is not None:
        n = df.count() if n is None else n
        alpha = 1.0 / (C * n)
    svc = LinearSVC(regParam=alpha, standardization=False, maxIter=max_iter, tol=TOLERANCE)
    return _ovr(svc, cols, parallelism).fit(df)


def squared_hinge_svm(df: DataFrame, n_classes: int, cols: Columns = Columns(), C: float = 1.0, max_iter: int = 1000) -> LinearModel:
    """One-vs-rest support vector classifier with squared hinge loss and strength C, all classes fitted together."""
    return linear.squared_hinge_svm(df, n_classes, cols.features, cols.label, C, TOLERANCE, max_iter)


def softmax_regression(df: DataFrame, n_classes: int, cols: Columns = Columns(), C: float = 1.0, max_iter: int = 1000) -> LinearModel:
    """The model of ``logistic_regression``, by joint Newton steps on packed rows; rows have no weights."""
    return linear.softmax_regression(df, n_classes, cols.features, cols.label, C, TOLERANCE, max_iter)


def ridge_classifier(df: DataFrame, n_classes: int, cols: Columns = Columns(), alpha: float = 1.0) -> LinearModel:
    """Least squares on -1/+1 targets, all classes solved together."""
    return linear.ridge(df, n_classes, cols.features, cols.label, alpha)


def complement_naive_bayes(df: DataFrame, cols: Columns = Columns(), smoothing: float = 1.0):
    return NaiveBayes(**_common(cols), modelType="complement", smoothing=smoothing).fit(df)


def random_forest(df: DataFrame, cols: Columns = Columns(), trees: int = 100, max_depth: int = 30, seed: int = 42):
    """Unlimited depth is cut at Spark's limit of 30."""
    return RandomForestClassifier(**_common(cols), numTrees=trees, maxDepth=max_depth, seed=seed).fit(df)


def boosted_trees(
    df: DataFrame, cols: Columns = Columns(), rounds: int = 100, max_depth: int = 6, learning_rate: float = 0.3, bins: int = 64,
    n_classes: int | None = None,
) -> BoostedTrees:
    """Second-order boosting of one tree a class and round; classes are 0 to the largest label unless their number is given."""
    if n_classes is None:
        n_classes = int(df.agg(F.max(cols.label)).first()[0]) + 1
    return boosting.boosted_trees(df, n_classes, cols.features, cols.label, rounds, max_depth, learning_rate, bins=bins)


def _all_classes(fit):
    """``fit`` for classes from 0 to the largest label."""

    def fitted(df: DataFrame, cols: Columns = Columns(), **params):
        return fit(df, int(df.agg(F.max(cols.label)).first()[0]) + 1, cols, **params)

    return fitted


def fit_model(name: str, df: DataFrame, cols: Columns = Columns(), **params):
    """Fit a classifier by its short name."""
    fits = {
        "logreg": logistic_regression,
        "softmax": _all_classes(softmax_regression),
        "svm": linear_svm,
        "linear_svc": _all_classes(squared_hinge_svm),
        "ridge": _all_classes(ridge_classifier),
        "xgboost": boosted_trees,
        "rf": random_forest,
        "complement_nb": complement_naive_bayes,
    }
    name = name.lower().strip()
    if name not in fits:
        raise ValueError(f"unknown model {name!r}; have {sorted(fits)}")
    return fits[name](df, cols, **params)


def linear_margins(model):
    """(df, out) -> df with one decision value per class, for a one-vs-rest linear model."""
    raw = [m.copy() for m in model.models]

    def add(df: DataFrame, out: str) -> DataFrame:
        names = []
        for k, m in enumerate(raw):
            name = f"_raw{k}"
            m = m.setRawPredictionCol(name).setPredictionCol("_unused").setFeaturesCol(model.getFeaturesCol())
            df = m.transform(df).drop("_unused")
            names.append(name)
        values = F.array(*[F.get(vector_to_array(F.col(n)), F.lit(1)) for n in names])
        return df.withColumn(out, values).drop(*names)

    return add


def fit_evaluate_time(fit, transform, train: DataFrame, val: DataFrame, y: str = "y") -> dict:
    """Fit, score both sides and report F1 and wall-clock; each timing covers a finished job."""
    start = time.perf_counter()
    model = fit(train)
    train_time = time.perf_counter() - start
    start = time.perf_counter()
    both = transform(model, train).select(F.lit("train").alias("part"), y, "prediction").unionByName(
        transform(model, val).select(F.lit("val").alias("part"), y, "prediction")
    )
    scores = {r["part"]: r for r in evaluate(both, y, "prediction", ["part"]).collect()}
    pred_time = time.perf_counter() - start
    return {
        "f1_train": scores["train"]["f1_weighted"],
        "f1_val": scores["val"]["f1_weighted"],
        "accuracy": scores["val"]["accuracy"],
        "train_time_s": train_time,
        "pred_time_s": pred_time,
        "model": model,
    }


def linear_scores(features: DataFrame, weights: DataFrame, key: str, max_rows: int = 250_000) -> DataFrame:
    """Decision values of a linear model: features (key, term, value) with weights (term, class, w).

    Weights are folded to one row per term before the join, so the long feature table
    is not multiplied by the number of classes until after the partial sums.
    """
    folded = weights.groupBy("term").agg(
        F.collect_list(F.struct(F.col("class_idx"), F.col("w"))).alias("_ws")
    )
    joined = lookup_join(features, folded, ["term"], max_rows=max_rows)
    products = joined.select(key, "value", F.inline("_ws"))
    return products.groupBy(key, "class_idx").agg(F.sum(F.col("value") * F.col("w")).alias("score"))


def complement_log_weights(counts: DataFrame, classes: list[int], alpha: float = 1.0) -> DataFrame:
    """Complement naive Bayes weights by SQL: counts (class_idx, term, n) -> (class_idx, term, w).

    ``classes`` lists the class indices; terms a class never used still get a weight.
    """
    per_term = counts.groupBy("term").agg(
        F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("class_idx", "n"))).alias("_by")
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_idx"),
                (F.col("_all") + F.lit(alpha) - F.coalesce(F.try_element_at("_by", F.lit(c)), F.lit(0))).alias("_comp"),
            )
            for c in classes
        ]
    )
    comp = per_term.select("term", F.inline(cells))
    totals = comp.groupBy("class_idx").agg(F.sum("_comp").alias("_total"))
    return comp.join(F.broadcast(totals), "class_idx").select(
        "class_idx", "term", (-F.log(F.col("_comp") / F.col("_total"))).alias("w")
    )


