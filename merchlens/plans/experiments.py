"""Experiment runs and the analytics over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_merge import blank, raw_text
from ..functions.text_stats import add_text_features
from ..operators import experiments as X
from ..operators.splits import stratified_flag
from ..operators.vectorize import merged_union, split_union
from ..session import local_rows, persist_to_table
from .evaluation import rounded
from .models import MAX_UNION, with_language_index
from .registry import query
from .standins import GRID, RESULTS, experiment_results, grid_results, products

BASE = "A-F-1"
MANUAL = ["designation_len_char", "description_len_words", "description_digit_ratio"]
# Strengths that the support vector classifier is tried with
PENALTIES = (0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)
# A smaller job than the operator's defaults, which take over two minutes at the smallest size (README)
FAST = {"max_iter": 15}


def experiment_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).withColumn("text_raw", raw_text(F.col("designation"), F.col("description")))
    rows = with_language_index(stratified_flag(rows, "lang", "idx", 0.85, out="is_train"))
    rows = add_text_features(rows, ["designation", "description"]).withColumn("description", blank(F.col("description")))
    keep = ["idx", "y", "is_train", "designation", "description", "text_raw", *MANUAL]
    return persist_to_table(rows.select(*keep), "experiment-rows")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("is_train"), rows.filter(~F.col("is_train"))


@query("fit_evaluate_time")
def fit_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    r = X.run_union(train, val, merged_union("text_raw", max_features=10_000, ngram_range=(1, 2)), "logreg")
    names = ("f1_train", "f1_val", "accuracy", "train_time_s", "pred_time_s")
    return local_rows(spark, [tuple(float(r[n]) for n in names)], ", ".join(f"{n} double" for n in names))


@query("cleaning_ablation")
def cleaning_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows = experiment_rows(spark, sf)
    return X.cleaning_ablation(rows, "text_raw", "y", F.col("is_train"), parallelism=4)


@query(
    "baseline_delta",
    f"""WITH {RESULTS}, b AS (SELECT f1_weighted AS base FROM results WHERE experiment = '{BASE}')
    SELECT experiment, "group", round(f1_weighted, 6) AS f1_weighted, round(accuracy, 6) AS accuracy,
    round(f1_weighted - base, 6) AS delta_f1, round((f1_weighted - base) / base * 100, 6) AS delta_pct FROM results, b""",
)
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    out = X.with_baseline_delta(experiment_results(spark, sf), BASE)
    return rounded(out, "f1_weighted", "accuracy", "delta_f1", "delta_pct")


_DELTA = f"""{RESULTS}, b AS (SELECT f1_weighted AS base FROM results WHERE experiment = '{BASE}'),
d AS (SELECT *, f1_weighted - base AS delta_f1 FROM results, b)"""


@query(
    "extreme_experiments",
    f"""WITH {_DELTA}, t AS (SELECT *, row_number() OVER (ORDER BY delta_f1 DESC, experiment) AS a,
      row_number() OVER (ORDER BY delta_f1, experiment) AS z FROM d WHERE experiment <> '{BASE}')
    SELECT 'top' AS side, experiment, round(delta_f1, 6) AS delta_f1 FROM t WHERE a <= 5
    UNION ALL SELECT 'bottom', experiment, round(delta_f1, 6) FROM t WHERE z <= 5""",
)
def extreme_experiments(spark: SparkSession, sf: str) -> DataFrame:
    results = X.with_baseline_delta(experiment_results(spark, sf), BASE)
    return rounded(X.extreme_experiments(results, 5, BASE), "delta_f1").select("side", "experiment", "delta_f1")


@query(
    "group_gains",
    f"""WITH {_DELTA} SELECT "group", round(avg(delta_f1), 6) AS mean_delta, round(max(delta_f1), 6) AS max_delta,
    round(min(delta_f1), 6) AS min_delta, count(*) AS experiments FROM d GROUP BY ALL""",
)
def group_gains(spark: SparkSession, sf: str) -> DataFrame:
    gains = X.group_gains(X.with_baseline_delta(experiment_results(spark, sf), BASE))
    return rounded(gains, "mean_delta", "max_delta", "min_delta")


@query("vectorizer_experiment")
def vectorizer_experiment(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    record = X.run_vectorizer_experiment(
        train, val, text_columns=("designation", "description"), feature_columns=MANUAL, title_weight=1.2
    )
    return X.result_table(spark, [record])


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    return X.grid_search(train, val, parallelism=4, text_columns=("designation", "description"))


@query("penalty_search")
def penalty_search(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    union = split_union("designation", "description", title_weight=1.2, max_features=MAX_UNION, ngram_range=(1, 2))
    return X.penalty_search(train, val, union, PENALTIES)


@query("strategy_comparison")
def strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    return X.compare_strategies(train, val, ("designation", "description"), MANUAL, max_features=200, ngram_range=(1, 1), **FAST)


@query("title_weight_sweep")
def title_weights(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _sides(experiment_rows(spark, sf))
    return X.title_weight_sweep(train, val, ("designation", "description"))


@query(
    "result_statistics",
    f"""WITH {GRID} SELECT count(*) AS experiments, round(avg(f1_score), 6) AS mean, round(median(f1_score), 6) AS median,
    round(min(f1_score), 6) AS min, round(max(f1_score), 6) AS max, round(stddev_samp(f1_score), 6) AS std,
    count(*) FILTER (f1_score > 0.5) AS above_baseline,
    CASE WHEN max(f1_score) > 0.5 THEN round((max(f1_score) - 0.5) / 0.5 * 100, 6) END AS best_gain_pct FROM grid""",
)
def result_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = X.result_statistics(grid_results(spark, sf), 0.5)
    return rounded(out, "mean", "median", "min", "max", "std", "best_gain_pct")


@query(
    "statistics_by_strategy",
    f"""WITH {GRID} SELECT 'strategy' AS by, strategy AS value, round(avg(f1_score), 6) AS mean, round(max(f1_score), 6) AS max, count(*) AS count
    FROM grid GROUP BY ALL UNION ALL SELECT 'model', model, round(avg(f1_score), 6), round(max(f1_score), 6), count(*) FROM grid GROUP BY ALL""",
)
def statistics_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    grid = grid_results(spark, sf)
    parts = [
        X.statistics_by(grid, c).select(F.lit(c).alias("by"), F.col(c).alias("value"), "mean", "max", "count")
        for c in ("strategy", "model")
    ]
    return rounded(parts[0].unionByName(parts[1]), "mean", "max")


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    grid = grid_results(spark, sf)
    return {
        "kinds": grid.drop("strategy", "title_weight"),
        "weighting": grid.filter("strategy = 'split'"),
        "strategies": grid.drop("title_weight"),
    }


@query(
    "tracked_scores",
    f"""WITH {GRID} SELECT 'kinds' AS experiment, round(f1_score, 6) AS f1_score, round(accuracy, 6) AS accuracy, vectorizer,
      NULL::DOUBLE AS title_weight, use_features, NULL::VARCHAR AS strategy, model FROM grid
    UNION ALL SELECT 'weighting', round(f1_score, 6), round(accuracy, 6), vectorizer, title_weight, use_features, strategy, model
      FROM grid WHERE strategy = 'split'
    UNION ALL SELECT 'strategies', round(f1_score, 6), round(accuracy, 6), vectorizer, NULL, use_features, strategy, model FROM grid""",
)
def tracked_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.track_scores(tables(spark, sf)), "f1_score", "accuracy")


@query(
    "verify_best_score",
    f"""WITH {GRID} SELECT round(max(f1_score), 6) AS best_score,
    CASE WHEN (SELECT arg_max(strategy, f1_score) FROM grid) = 'split' THEN 'weighting' ELSE 'strategies' END AS best_experiment,
    0.55::DOUBLE AS final_score, abs(0.55 - max(f1_score)) < 0.0001 AS is_optimal FROM grid""",
)
def verify_best_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.verify_best(X.track_scores(tables(spark, sf)), 0.55), "best_score")


@query(
    "findings_report",
    f"""WITH {GRID}, v AS (SELECT max(f1_score) AS best, max(f1_score) FILTER (vectorizer = 'count') AS cnt,
      max(f1_score) FILTER (strategy = 'split') AS split, max(f1_score) FILTER (strategy = 'merged') AS merged,
      max(f1_score) FILTER (strategy = 'split' AND title_weight = 1.0) AS plain_weight,
      max(f1_score) FILTER (NOT use_features) AS plain FROM grid)
    SELECT round((best - cnt) / cnt * 100, 6) AS count_vs_tfidf, round((split - merged) / merged * 100, 6) AS split_vs_merged,
    round((split - plain_weight) / plain_weight * 100, 6) AS title_weighting, round((best - plain) / plain * 100, 6) AS manual_features,
    round(best, 6) AS best_score, round((best - 0.4) / 0.4 * 100, 6) AS total_gain FROM v""",
)
def findings_report(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    out = X.findings(t["kinds"], grid_results(spark, sf), t["weighting"], t["strategies"], X.track_scores(t), 0.4)
    return rounded(out, *out.columns)
