"""Experiment runners and the analytics over their result tables."""

from __future__ import annotations

import time
from functools import partial, reduce
from itertools import product

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_frame
from ..functions.proba import argmax
from ..session import local_rows, persist_to_table, run_all
from .classifiers import Columns, fit_evaluate_time, fit_model
from .linear import LinearModel, softmax_fits, squared_hinge_strengths
from .metrics import evaluate
from .scaling import PopulationScaler
from .vectorize import FeatureUnion, merged_union, split_union

BASELINE = "baseline_raw"
_ENCODING = ("fix_encoding", "unescape_html", "normalize_unicode")
_MERGES = ("merge_dimensions", "merge_units", "merge_durations", "merge_age_ranges")

# --- Fixed values: the cleaning configurations under test: name, group, switched-on flags ------
CLEANING_EXPERIMENTS: list[tuple[str, str, tuple[str, ...]]] = [
    (BASELINE, "0_Baseline", ()),
    ("fix_encoding", "1_Encodage", ("fix_encoding",)),
    ("unescape_html", "1_Encodage", ("unescape_html",)),
    ("normalize_unicode", "1_Encodage", ("normalize_unicode",)),
    ("all_encoding_fixes", "1_Encodage", _ENCODING),
    ("remove_html_tags", "2_HTML", ("remove_html_tags",)),
    ("remove_boilerplate", "2_HTML", ("remove_boilerplate",)),
    ("lowercase", "3_Casse", ("lowercase",)),
    ("merge_dimensions", "4_Fusions", ("merge_dimensions",)),
    ("merge_units", "4_Fusions", ("merge_units",)),
    ("merge_durations", "4_Fusions", ("merge_durations",)),
    ("merge_age_ranges", "4_Fusions", ("merge_age_ranges",)),
    ("tag_years", "4_Fusions", ("tag_years",)),
    ("all_merges", "4_Fusions", _MERGES),
    ("remove_punctuation", "5_Ponctuation", ("remove_punctuation",)),
    ("remove_stopwords", "6_Filtrage", ("remove_stopwords",)),
    ("remove_single_letters", "6_Filtrage", ("remove_single_letters",)),
    ("remove_single_digits", "6_Filtrage", ("remove_single_digits",)),
    ("remove_pure_punct_tokens", "6_Filtrage", ("remove_pure_punct_tokens",)),
    (
        "traditional_cleaning",
        "7_Combos",
        (*_ENCODING, "remove_html_tags", "lowercase", "remove_punctuation", "remove_stopwords"),
    ),
    ("conservative_cleaning", "7_Combos", (*_ENCODING, "remove_html_tags")),
    ("merges_only", "7_Combos", _MERGES),
]

RESULT_SCHEMA = "experiment string, group string, f1_weighted double, accuracy double"


def run_union(
    train: DataFrame, val: DataFrame, union: FeatureUnion, model: str, y: str = "y", cols: Columns | None = None, **params
) -> dict:
    """Fit a feature union and a classifier, then score both sides."""
    cols = cols or Columns(label=y)
    written: dict[str, DataFrame] = {}

    def vectors(fitted, rows: DataFrame, side: str) -> DataFrame:
        # solver and evaluation read the vectors, the texts are vectorised once per side
        if side not in written:
            out = fitted.transform(rows, cols.features).select(cols.label, cols.features)
            written[side] = persist_to_table(out, f"vectors-{side}")
        return written[side]

    def fit(rows: DataFrame):
        features = union.fit(rows)
        return features, fit_model(model, vectors(features, rows, "train"), cols, **params)

    def transform(fitted, rows: DataFrame) -> DataFrame:
        features, classifier = fitted
        return classifier.transform(vectors(features, rows, "train" if rows is train else "val"))

    return fit_evaluate_time(fit, transform, train, val, y)


MERGED = "_all_text"


def run_vectorizer_experiment(
    train: DataFrame, val: DataFrame, kind: str = "tfidf", strategy: str = "split",
    text_columns: tuple[str, ...] = ("title_clean", "desc_clean"), feature_columns: list[str] | None = None,
    max_features: int = 10_000, ngram_range: tuple[int, int] = (1, 2), model: str = "logreg",
    title_weight: float = 1.0, solver: str | None = None, **params,
) -> dict:
    """One experiment record: scores, times and its configuration.

    ``solver`` is the name of another fit of the same model, as ``softmax`` is of ``logreg``.

    Strategy ``split`` gives title and description a block each; any other strategy joins all text columns by a space
    into one block.
    """
    common = {"kind": kind, "max_features": max_features, "ngram_range": ngram_range}
    if strategy != "split":
        whole = F.concat_ws(" ", *text_columns)
        train, val = (df.withColumn(MERGED, whole) for df in (train, val))
        union = merged_union(MERGED, feature_columns, **common)
    elif len(text_columns) == 2:
        union = split_union(*text_columns, feature_columns, title_weight, **common)
    else:
        raise ValueError("the split strategy needs two text columns")
    result = run_union(train, val, union, solver or model, **params)
    return {
        "vectorizer": kind, "strategy": strategy, "max_features": max_features, "ngram_range": str(ngram_range),
        "title_weight": float(title_weight), "model": model, "use_features": bool(feature_columns),
        "f1_score": result["f1_val"], "accuracy": result["accuracy"],
        "train_time": result["train_time_s"], "predict_time": result["pred_time_s"],
    }


GRID_SCHEMA = (
    "vectorizer string, strategy string, max_features int, ngram_range string, title_weight double, model string, "
    "use_features boolean, f1_score double, accuracy double, train_time double, predict_time double"
)


def result_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in GRID_SCHEMA.split(", ")]
    rows = [tuple(r.get(n) for n in names) for r in records]
    return local_rows(spark, rows, GRID_SCHEMA).orderBy(F.desc("f1_score"))


def grid_search(
    train: DataFrame, val: DataFrame, max_features_list=(5000, 10_000, 20_000),
    ngram_ranges=((1, 1), (1, 2), (1, 3)), parallelism: int = 1, model: str = "logreg", **params,
) -> DataFrame:
    """Every max_features x n-gram combination on one fixed split; ``logreg`` is fitted by the joint solver."""
    params = {"solver": "softmax" if model == "logreg" else None, **params}
    jobs = [
        partial(run_vectorizer_experiment, train, val, max_features=m, ngram_range=n, model=model, **params)
        for m, n in product(max_features_list, ngram_ranges)
    ]
    records = run_all(jobs, parallelism)
    return result_table(train.sparkSession, records)


def _vector_sides(fitted, train: DataFrame, val: DataFrame, y: str, name: str, *weights) -> tuple[DataFrame, DataFrame]:
    """Vectors of both sides, written because every fit reads them several times."""
    train, val = (persist_to_table(fitted.transform(rows, "features", *weights).select(y, "features"), name) for rows in (train, val))
    return train, val


def evaluate_fits(models: list[LinearModel], train: DataFrame, val: DataFrame, y: str = "y") -> dict[int, dict]:
    """Weighted F1 of both sides and accuracy of several linear models by their place, in one pass over the vectors."""
    sides = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    margins = sides.select("part", y, *[m.margin(F.col(m.features)).alias(f"_m{i}") for i, m in enumerate(models)])
    each = [F.struct(F.lit(i).alias("fit"), argmax(F.col(f"_m{i}")).cast("double").alias("prediction")) for i in range(len(models))]
    rows = margins.select("part", y, F.inline(F.array(*each)))
    out: dict[int, dict] = {}
    for r in evaluate(rows, y, "prediction", ["fit", "part"]).collect():
        scores = out.setdefault(r["fit"], {})
        scores[f"f1_{r['part']}"] = float(r["f1_weighted"])
        if r["part"] == "val":
            scores["accuracy"] = float(r["accuracy"])
    return out


def penalty_search(train: DataFrame, val: DataFrame, union: FeatureUnion, C_values, model: str = "linear_svc", y: str = "y", **params) -> DataFrame:
    """Several penalties on one set of features, which are fitted only once.

    ``linear_svc`` and ``logreg`` fit all penalties in joint passes; every row then has the time of the joint fit.
    """
    C_values = [float(C) for C in C_values]
    a, b = _vector_sides(union.fit(train), train, val, y, "penalty-vectors")
    if model in ("linear_svc", "logreg"):
        start = time.perf_counter()
        classes = int(a.agg(F.max(y)).first()[0]) + 1
        if model == "linear_svc":
            models = squared_hinge_strengths(a, classes, C_values, label=y, **params)
        else:
            models = softmax_fits(a, classes, [(C, None) for C in C_values], label=y, **params)
        took = time.perf_counter() - start
        scores = evaluate_fits(models, a, b, y)
        records = [(C, scores[i]["f1_train"], scores[i]["f1_val"], took) for i, C in enumerate(C_values)]
    else:
        records = []
        for C in C_values:
            r = fit_evaluate_time(
                lambda rows, C=C: fit_model(model, rows, Columns(label=y), C=C, **params), lambda m, rows: m.transform(rows), a, b, y
            )
            records.append((C, r["f1_train"], r["f1_val"], r["train_time_s"]))
    return local_rows(train.sparkSession, records, "C double, f1_train double, f1_val double, train_time_s double")


def compare_strategies(
    train: DataFrame, val: DataFrame, text_columns: tuple[str, str], feature_columns: list[str],
    models: tuple[str, ...] = ("logreg",), y: str = "y", max_features: int = 10_000,
    ngram_range: tuple[int, int] = (1, 2), parallelism: int = 1, **params,
) -> DataFrame:
    """Manual features alone, counts, TF-IDF, and both with the manual features."""
    plans = [
        ("manual", None, True), ("count", "count", False), ("tfidf", "tfidf", False),
        ("manual+count", "count", True), ("manual+tfidf", "tfidf", True),
    ]

    def run(plan: tuple, model: str) -> dict:
        name, kind, manual = plan
        if kind is None:
            result = run_manual_features(train, val, feature_columns, model, y, **params)
            record = {"vectorizer": "None", "model": model, "use_features": True, **result}
        else:
            record = run_vectorizer_experiment(
                train, val, kind=kind, text_columns=text_columns, feature_columns=feature_columns if manual else None,
                max_features=max_features, ngram_range=ngram_range, model=model, y=y, **params,
            )
        return {**record, "strategy": name}

    records = run_all([partial(run, *job) for job in product(plans, models)], parallelism)
    return result_table(train.sparkSession, records)


def run_manual_features(train: DataFrame, val: DataFrame, columns: list[str], model: str, y: str = "y", **params) -> dict:
    scaler = PopulationScaler.fit(train, columns)
    assemble = VectorAssembler(inputCols=[f"_s_{c}" for c in columns], outputCol="features")

    def features(rows: DataFrame) -> DataFrame:
        return assemble.transform(scaler.transform(rows, "_s_"))

    r = fit_evaluate_time(
        lambda rows: fit_model(model, features(rows), Columns(label=y), **params),
        lambda m, rows: m.transform(features(rows)), train, val, y,
    )
    return {
        "f1_score": r["f1_val"], "accuracy": r["accuracy"],
        "train_time": r["train_time_s"], "predict_time": r["pred_time_s"],
    }


def title_weight_sweep(
    train: DataFrame, val: DataFrame, text_columns: tuple[str, str], weights=(1.0, 1.5, 2.0, 2.5, 3.0),
    model: str = "logreg", y: str = "y", max_features: int = 10_000, ngram_range=(1, 2), C: float = 1.0, **params,
) -> DataFrame:
    """Several title weights; vocabularies are fitted once, only the weighting is redone.

    ``logreg`` reads one set of vectors for all weights, which are factors of the title's columns in joint passes; every
    row then has the times of all weights together. Other models are fitted for each weight on vectors of its own.
    """
    weights = [float(w) for w in weights]
    union = split_union(*text_columns, max_features=max_features, ngram_range=ngram_range)
    fitted = union.fit(train)
    records = []
    if model == "logreg":
        a, b = _vector_sides(fitted, train, val, y, "title-vectors", {"title": 1.0})
        start = time.perf_counter()
        classes = int(a.agg(F.max(y)).first()[0]) + 1
        in_title = np.array([name.startswith("title__") for name in fitted.feature_names()])
        models = softmax_fits(a, classes, [(C, np.where(in_title, w, 1.0)) for w in weights], label=y, **params)
        middle = time.perf_counter()
        scores = evaluate_fits(models, a, b, y)
        times = {"train_time": middle - start, "predict_time": time.perf_counter() - middle}
        records = [{"f1_score": scores[i]["f1_val"], "accuracy": scores[i]["accuracy"], **times} for i in range(len(weights))]
    else:
        for w in weights:
            a, b = _vector_sides(fitted, train, val, y, "title-vectors", {"title": w})
            r = fit_evaluate_time(
                lambda rows: fit_model(model, rows, Columns(label=y), C=C, **params), lambda m, rows: m.transform(rows), a, b, y
            )
            records.append(
                {"f1_score": r["f1_val"], "accuracy": r["accuracy"], "train_time": r["train_time_s"], "predict_time": r["pred_time_s"]}
            )
    common = {
        "vectorizer": "tfidf", "strategy": "split", "max_features": max_features, "ngram_range": str(ngram_range),
        "model": model, "use_features": False,
    }
    return result_table(train.sparkSession, [{**common, "title_weight": w, **r} for w, r in zip(weights, records, strict=True)])


def cleaning_ablation(
    df: DataFrame, text: str, y: str, is_train: Column, experiments=None, max_features: int = 10_000,
    ngram_range=(1, 2), C: float = 2.0, max_iter: int = 1000, parallelism: int = 1,
) -> DataFrame:
    """Clean, vectorise, fit (by the joint solver) and score once per configuration on one shared split."""

    def run(name: str, group: str, flags: tuple[str, ...]) -> tuple:
        cleaned = clean_frame(df, {"_clean": F.col(text)}, **dict.fromkeys(flags, True))
        union = merged_union("_clean", max_features=max_features, ngram_range=ngram_range)
        r = run_union(cleaned.filter(is_train), cleaned.filter(~is_train), union, "softmax", y, C=C, max_iter=max_iter)
        return name, group, float(r["f1_val"]), float(r["accuracy"])

    records = run_all([partial(run, *e) for e in experiments or CLEANING_EXPERIMENTS], parallelism)
    return with_baseline_delta(local_rows(df.sparkSession, records, RESULT_SCHEMA))


def with_baseline_delta(results: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Absolute and relative F1 gain over the baseline row (0 when there is no baseline score)."""
    base = F.lit(results.filter(F.col("experiment") == baseline).agg(F.max("f1_weighted")).first()[0]).cast("double")
    delta = F.when(F.coalesce(base, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("f1_weighted") - base)
    pct = F.when(F.coalesce(base, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(delta / base * 100)
    return results.withColumns({"delta_f1": delta, "delta_pct": pct})


def extreme_experiments(results: DataFrame, n: int = 10, baseline: str = BASELINE) -> DataFrame:
    """The n largest and n smallest gains, without the baseline."""
    rest = results.filter(F.col("experiment") != baseline)
    best = rest.orderBy(F.desc("delta_f1"), "experiment").limit(n).withColumn("side", F.lit("top"))
    worst = rest.orderBy("delta_f1", "experiment").limit(n).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def group_gains(results: DataFrame) -> DataFrame:
    return results.groupBy("group").agg(
        F.avg("delta_f1").alias("mean_delta"), F.max("delta_f1").alias("max_delta"),
        F.min("delta_f1").alias("min_delta"), F.count("experiment").alias("experiments"),
    )


def result_statistics(results: DataFrame, baseline: float | None = None, score: str = "f1_score") -> DataFrame:
    """Mean, median, min, max, sample deviation and the gain over a baseline; one row."""
    s = F.col(score)
    aggs = [
        F.count(s).alias("experiments"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"),
        F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_samp(s).alias("std"),
    ]
    if baseline:
        aggs += [
            F.count_if(s > baseline).alias("above_baseline"),
            F.when(F.max(s) > baseline, (F.max(s) - baseline) / baseline * 100).alias("best_gain_pct"),
        ]
    return results.agg(*aggs)


def statistics_by(results: DataFrame, column: str, score: str = "f1_score") -> DataFrame:
    return results.groupBy(column).agg(
        F.avg(score).alias("mean"), F.max(score).alias("max"), F.count(score).alias("count")
    ).orderBy(F.desc("mean"), column)


# Fixed names of the configuration columns
TRACKED = ("vectorizer", "max_features", "ngram_range", "title_weight", "use_features", "strategy", "model")


def track_scores(tables: dict[str, DataFrame], score: str = "f1_score") -> DataFrame:
    """Union of result tables: experiment name, scores and the known configuration columns."""
    parts = []
    for name, df in tables.items():
        have = set(df.columns)
        f1 = F.col(score) if score in have else F.lit(0.0)
        acc = F.col("accuracy") if "accuracy" in have else F.lit(0.0)
        known = [F.col(c) for c in TRACKED if c in have]
        parts.append(df.select(F.lit(name).alias("experiment"), f1.alias("f1_score"), acc.alias("accuracy"), *known))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.orderBy(F.desc("f1_score"), "experiment")


def verify_best(scores: DataFrame, final_score: float, tolerance: float = 1e-4) -> DataFrame:
    best = scores.agg(
        F.max("f1_score").alias("best_score"),
        F.max_by("experiment", F.struct("f1_score", "experiment")).alias("best_experiment"),
    )
    gap = F.abs(F.lit(float(final_score)) - F.col("best_score"))
    return best.withColumns({"final_score": F.lit(float(final_score)), "is_optimal": F.coalesce(gap < tolerance, F.lit(False))})


def findings(
    kinds: DataFrame, split_vs_merged: DataFrame, weighting: DataFrame, strategies: DataFrame,
    all_scores: DataFrame, baseline: float,
) -> DataFrame:
    """Relative gains, in percent, drawn from five result tables; one row."""

    def best(df: DataFrame, cond: Column | None, name: str) -> DataFrame:
        score = F.col("f1_score") if cond is None else F.when(cond, F.col("f1_score"))
        return df.agg(F.max(score).alias(name))

    cells = {
        "tfidf": best(kinds, None, "v"),
        "count": best(kinds, F.col("vectorizer") == "count", "v"),
        "split": best(split_vs_merged, F.col("strategy") == "split", "v"),
        "merged": best(split_vs_merged, F.col("strategy") == "merged", "v"),
        "weighted": best(weighting, None, "v"),
        "unweighted": best(weighting, F.col("title_weight") == 1.0, "v"),
        "manual": best(strategies, None, "v"),
        "plain": best(strategies, ~F.col("use_features"), "v"),
        "best": best(all_scores, None, "v"),
    }
    long = reduce(
        lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("k"), F.col("v").alias("v")) for k, df in cells.items()]
    )
    wide = long.groupBy().pivot("k", list(cells)).agg(F.max("v"))

    def gain(new: str, old: str) -> Column:
        return (F.col(new) - F.col(old)) / F.col(old) * 100

    return wide.select(
        gain("tfidf", "count").alias("count_vs_tfidf"),
        gain("split", "merged").alias("split_vs_merged"),
        gain("weighted", "unweighted").alias("title_weighting"),
        gain("manual", "plain").alias("manual_features"),
        F.col("best").alias("best_score"),
        ((F.col("best") - F.lit(baseline)) / F.lit(baseline) * 100).alias("total_gain"),
    )
