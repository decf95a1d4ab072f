"""Metrics, reports, confusions, coefficient analysis, best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CANONICAL_CLASSES
from ..operators import metrics as M
from .labels import CATEGORY
from .registry import query
from .standins import (
    COEFFICIENTS,
    N_CLASSES,
    PREDICTIONS,
    PROBS,
    coefficients,
    predictions,
    probabilities,
    sql_nll,
    table,
)

TEN = ", ".join(str(c) for c in CANONICAL_CLASSES[:N_CLASSES])


def sql_class_scores(source: str, y: str, p: str, name: str) -> str:
    return f"""{name}0 AS (SELECT label, count(*) FILTER ({y} = label) AS support, count(*) FILTER ({p} = label) AS predicted,
      count(*) FILTER ({y} = label AND {p} = label) AS hits
      FROM {source}, (SELECT DISTINCT l AS label FROM (SELECT {y} AS l FROM {source} UNION ALL SELECT {p} FROM {source})) GROUP BY label),
    {name} AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END::DOUBLE AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hits / support END::DOUBLE AS recall,
      CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + predicted) END AS f1, support, hits FROM {name}0)"""


SCORES = sql_class_scores("predictions", "y_true", "pred_alpha", "scores")
SCORES_B = sql_class_scores("predictions", "y_true", "pred_beta", "scores_b")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "classification_scores",
    f"""WITH {PREDICTIONS}, {SCORES} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
    round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro, sum(support)::BIGINT AS rows FROM scores""",
)
def classification_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.evaluate(predictions(spark, sf), "y_true", "pred_alpha"), "accuracy", "f1_weighted", "f1_macro")


@query(
    "macro_f1_by_model",
    f"""WITH {PREDICTIONS}, {SCORES}, {SCORES_B} SELECT 'alpha' AS model, round(avg(f1), 6) AS f1_macro FROM scores
    UNION ALL SELECT 'beta', round(avg(f1), 6) FROM scores_b""",
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    both = predictions(spark, sf).select(
        "y_true",
        F.inline(
            F.array(
                F.struct(F.lit("alpha").alias("model"), F.col("pred_alpha").alias("y_pred")),
                F.struct(F.lit("beta").alias("model"), F.col("pred_beta").alias("y_pred")),
            )
        ),
    )
    return rounded(M.evaluate(both, by=["model"]), "f1_macro").select("model", "f1_macro")


@query("log_loss", f"WITH {PROBS} SELECT round(avg({sql_nll('alpha', 'y')}), 6) AS log_loss FROM probs")
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.log_loss(probabilities(spark, sf), "alpha", "y"), "log_loss")


@query(
    "classification_report",
    f"""WITH {PREDICTIONS}, {CATEGORY}, coded AS (SELECT [{TEN}][y_true + 1] AS y_true, [{TEN}][pred_alpha + 1] AS pred FROM predictions),
    {sql_class_scores("coded", "y_true", "pred", "scores")}
    SELECT 'class' AS kind, short_name AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
      FROM scores JOIN category ON label = code
    UNION ALL SELECT 'accuracy', 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
      round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM scores
    UNION ALL SELECT 'macro', 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM scores
    UNION ALL SELECT 'weighted', 'weighted', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM scores""",
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in CANONICAL_CLASSES[:N_CLASSES]])
    rows = predictions(spark, sf).select(F.get(codes, F.col("y_true")).alias("y_true"), F.get(codes, F.col("pred_alpha")).alias("pred"))
    return rounded(M.classification_report(rows, "y_true", "pred"), "precision", "recall", "f1")


_CONFUSION = "confusion AS (SELECT y_true, pred_alpha AS y_pred, count(*) AS n FROM predictions GROUP BY ALL)"


@query(
    "top_confusions",
    f"""WITH {PREDICTIONS}, {_CONFUSION}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY y_true) AS share FROM confusion),
    r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY n DESC, y_pred) AS rank FROM s WHERE y_true <> y_pred)
    SELECT y_true, y_pred, n, round(share, 6) AS share, rank FROM r WHERE rank <= 3""",
    ints=["rank"],
)
def top_confusions(spark: SparkSession, sf: str) -> DataFrame:
    confusion = M.confusion_counts(predictions(spark, sf), "y_true", "pred_alpha")
    return rounded(M.top_confusions(confusion, 3), "share")


@query(
    "confusion_matrix",
    f"""WITH {PREDICTIONS} SELECT y_true, """ + ", ".join(f'count(*) FILTER (pred_alpha = {c}) AS "{c}"' for c in range(N_CLASSES))
    + " FROM predictions GROUP BY ALL",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_matrix(M.confusion_counts(predictions(spark, sf), "y_true", "pred_alpha"), list(range(N_CLASSES)))


@query(
    "best_and_worst_classes",
    f"""WITH {PREDICTIONS}, {SCORES}, r AS (SELECT label, f1, row_number() OVER (ORDER BY f1 DESC, label) AS best_rank,
      row_number() OVER (ORDER BY f1, label) AS worst_rank FROM scores)
    SELECT label, round(f1, 6) AS f1, best_rank, worst_rank FROM r WHERE best_rank <= 3 OR worst_rank <= 3""",
    ints=["best_rank", "worst_rank"],
)
def best_and_worst(spark: SparkSession, sf: str) -> DataFrame:
    scores = M.class_scores(M.confusion_counts(predictions(spark, sf), "y_true", "pred_alpha"))
    return rounded(M.best_and_worst(scores, 3), "f1").select("label", "f1", "best_rank", "worst_rank")


@query(
    "confusion_rate",
    f"""WITH {PREDICTIONS} SELECT t AS true_class, p AS pred_class,
    round(coalesce(count(*) FILTER (y_true = t AND pred_alpha = p) * 100.0::DOUBLE / nullif(count(*) FILTER (y_true = t), 0), 0), 6) AS rate
    FROM predictions, (VALUES (0, 1), (1, 0), (99, 0)) v(t, p) GROUP BY ALL""",
)
def confusion_rate(spark: SparkSession, sf: str) -> DataFrame:
    confusion = M.confusion_counts(predictions(spark, sf), "y_true", "pred_alpha")
    out = None
    for t, p in ((0, 1), (1, 0), (99, 0)):
        row = M.confusion_rate(confusion, t, p)
        out = row if out is None else out.unionByName(row)
    return rounded(out, "rate")


@query(
    "f1_delta",
    f"""WITH {PREDICTIONS}, {SCORES}, {SCORES_B} SELECT label, round(coalesce(a.f1, 0), 6) AS f1_new, round(coalesce(b.f1, 0), 6) AS f1_ref,
    round(coalesce(a.f1, 0) - coalesce(b.f1, 0), 6) AS delta FROM scores a FULL JOIN scores_b b USING (label)""",
)
def f1_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    new = M.class_scores(M.confusion_counts(rows, "y_true", "pred_alpha"))
    ref = M.class_scores(M.confusion_counts(rows, "y_true", "pred_beta"))
    return rounded(M.f1_delta(new, ref), "f1_new", "f1_ref", "delta")


@query(
    "modality_importance",
    f"""WITH {COEFFICIENTS}, m AS (SELECT class_idx, avg(abs(coef)) FILTER (pos < 32) AS t, avg(abs(coef)) FILTER (pos >= 32) AS i
      FROM coefficients GROUP BY ROLLUP (class_idx))
    SELECT class_idx, round(t, 6) AS text_importance, round(i, 6) AS image_importance, round(t / (t + i), 6) AS text_rate FROM m""",
)
def modality_importance(spark: SparkSession, sf: str) -> DataFrame:
    out = M.modality_importance(coefficients(spark, sf), 32)
    return rounded(out, "text_importance", "image_importance", "text_rate")


@query(
    "top_features_per_class",
    f"""WITH {COEFFICIENTS}, n AS (SELECT *, coef / sum(abs(coef)) OVER (PARTITION BY class_idx) AS coef_norm,
      row_number() OVER (PARTITION BY class_idx ORDER BY abs(coef) DESC, feature) AS rank FROM coefficients)
    SELECT class_idx, feature, split_part(feature, '__', 1) AS block, rank, round(coef_norm, 6) AS coef_norm FROM n WHERE rank <= 5""",
    ints=["rank"],
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    top = M.top_features(coefficients(spark, sf), 5)
    return rounded(top, "coef_norm").select("class_idx", "feature", F.substring_index("feature", "__", 1).alias("block"), "rank", "coef_norm")


# run history: one row per customer-status "run" and order month, metric missing for open orders
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.concat_ws("-", "o_orderpriority", F.year("o_orderdate")).alias("name"), F.month("o_orderdate").alias("epoch")
        )
        .agg(
            F.round(F.avg("o_totalprice"), 6).alias("val_f1"),
            F.round(F.avg(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))), 6).alias("val_loss"),
        )
    )


_HISTORY = """history AS (SELECT o_orderpriority || '-' || year(o_orderdate) AS name, month(o_orderdate) AS epoch,
    round(avg(o_totalprice), 6) AS val_f1, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS val_loss FROM orders GROUP BY ALL)"""


@query(
    "best_row_per_run",
    f"""WITH {_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY val_f1 DESC, epoch) AS rn FROM history)
    SELECT name, epoch, val_f1, val_loss FROM r WHERE rn = 1""",
    ints=["epoch"],
)
def best_row(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_row_per_run(run_history(spark, sf), "name", "val_f1", "epoch")


@query(
    "best_values_per_run",
    f"""WITH {_HISTORY} SELECT name, first(epoch ORDER BY val_f1 DESC, epoch) AS epoch, first(val_f1 ORDER BY val_f1 DESC, epoch) AS val_f1,
    first(val_loss ORDER BY val_f1 DESC, epoch) FILTER (val_loss IS NOT NULL) AS val_loss FROM history GROUP BY name""",
    ints=["epoch"],
)
def best_values(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_values_per_run(run_history(spark, sf), "name", "val_f1", "epoch")


