"""Softmax, temperature, blending, stacking features, top-k and contributions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import proba as A
from ..operators import blending as B
from ..operators import calibrate as K
from ..operators.classifiers import Columns, logistic_regression
from ..operators.splits import stratified_flag
from .registry import query
from .standins import (
    LOGITS,
    MODELS,
    N_CLASSES,
    PREDICTIONS,
    PROBS,
    logits,
    probabilities,
    score_rows,
    sql_argmax,
    sql_nll,
    sql_softmax,
)

NAMES = list(MODELS)


def spread_out(df: DataFrame, array: str, keep: list[str], digits: int = 6) -> DataFrame:
    """One column per class, rounded."""
    return df.select(*keep, *[F.round(F.get(array, F.lit(i)), digits).alias(f"p{i}") for i in range(N_CLASSES)])


def sql_spread(array: str, keep: str, digits: int = 6) -> str:
    return f"{keep}, " + ", ".join(f"round({array}[{i + 1}], {digits}) AS p{i}" for i in range(N_CLASSES))


@query("softmax", f"WITH {PROBS} SELECT {sql_spread('alpha', 'idx')} FROM probs")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(logits(spark, sf).withColumn("p", A.softmax(F.col("z_alpha"))), "p", ["idx"])


@query(
    "calibrated_probabilities",
    f"WITH {LOGITS}, c AS (SELECT idx, {sql_softmax('list_transform(z_beta, lambda v: v / 1.7::DOUBLE)')} AS p FROM logits) "
    f"SELECT {sql_spread('p', 'idx')} FROM c",
)
def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(logits(spark, sf).withColumn("p", A.calibrated(F.col("z_beta"), 1.7)), "p", ["idx"])


GRID = [round(0.1 * i, 1) for i in range(2, 42)]


def sql_cross_entropy(z: str, y: str, t: str) -> str:
    s = f"list_transform({z}, lambda v: v / {t})"
    return f"(list_max({s}) + ln(list_sum(list_transform({s}, lambda v: exp(v - list_max({s}))))) - {z}[{y} + 1] / {t})"


@query(
    "temperature_grid",
    f"""WITH {LOGITS}, g AS (SELECT unnest({GRID}::DOUBLE[]) AS temperature)
    SELECT temperature, round(avg({sql_cross_entropy('z_alpha', 'y', 'temperature')}), 6) AS nll FROM logits, g GROUP BY ALL""",
)
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    return K.temperature_grid(logits(spark, sf), "z_alpha", "y", GRID).withColumn("nll", F.round("nll", 6))


@query(
    "best_grid_temperature",
    f"""WITH {LOGITS}, g AS (SELECT unnest({GRID}::DOUBLE[]) AS temperature),
    c AS (SELECT temperature, avg({sql_cross_entropy('z_alpha', 'y', 'temperature')}) AS nll FROM logits, g GROUP BY ALL)
    SELECT arg_min(temperature, nll) AS temperature, round(min(nll), 6) AS nll FROM c""",
)
def best_grid_temperature(spark: SparkSession, sf: str) -> DataFrame:
    best = K.best_temperature(K.temperature_grid(logits(spark, sf), "z_alpha", "y", GRID))
    return best.withColumn("nll", F.round("nll", 6))


def sql_normalize(p: str) -> str:
    c = f"list_transform({p}, lambda v: least(greatest(v, 1e-12), 1))"
    return f"list_transform({c}, lambda v: v / list_sum({c}))"


@query(
    "normalize_probabilities",
    f"WITH {LOGITS}, n AS (SELECT idx, {sql_normalize('z_gamma')} AS p FROM logits) SELECT {sql_spread('p', 'idx')} FROM n",
)
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(logits(spark, sf).withColumn("p", A.normalize(F.col("z_gamma"))), "p", ["idx"])


LOSSES = "losses AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, avg({sql_nll(m, 'y')}) AS log_loss FROM probs" for m in NAMES
) + "), weights AS (SELECT model, log_loss, (1 / log_loss) / sum(1 / log_loss) OVER () AS weight FROM losses)"


@query(
    "weights_from_log_loss",
    f"WITH {PROBS}, {LOSSES} SELECT model, round(log_loss, 6) AS log_loss, round(weight, 6) AS weight FROM weights",
)
def weights_from_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    weights = B.weights_from_log_loss(B.model_log_losses(probabilities(spark, sf), NAMES, "y"))
    return weights.withColumns({c: F.round(c, 6) for c in ("log_loss", "weight")})


WEIGHTS = {"alpha": 3.0, "beta": 2.0, "gamma": 1.0}


def sql_blend(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    cells = ", ".join(
        "(" + " + ".join(f"{m}[{i + 1}] * {w / total!r}::DOUBLE" for m, w in weights.items()) + ")" for i in range(N_CLASSES)
    )
    return f"list_transform([{cells}], lambda v: v / list_sum([{cells}]))"


BLEND = f"blend AS (SELECT idx, y, alpha, beta, gamma, {sql_blend(WEIGHTS)} AS p FROM probs)"


@query("blend_columns", f"WITH {PROBS}, {BLEND} SELECT {sql_spread('p', 'idx')} FROM blend")
def blend_columns(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(probabilities(spark, sf).withColumn("p", B.blend_columns(NAMES, WEIGHTS)), "p", ["idx"])


@query("blend_score_table", f"WITH {PROBS}, {BLEND} SELECT {sql_spread('p', 'idx')} FROM blend")
def blend_score_table(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(B.blend_scores(score_rows(spark, sf), WEIGHTS, N_CLASSES), "probs", ["idx"])


def _eval_flag() -> Column:
    return ~F.col("is_meta")


def with_meta_split(spark: SparkSession, sf: str) -> DataFrame:
    """Seventy percent of every class fits the fusion, the rest evaluates it."""
    return stratified_flag(probabilities(spark, sf), "y", "idx", 0.7, out="is_meta")


META = """meta AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42' || idx::VARCHAR), idx)
    <= round(0.7::DOUBLE * count(*) OVER (PARTITION BY y)) AS is_meta FROM probs)"""


def _sweep_sql() -> str:
    parts = []
    for members in B.model_subsets(NAMES):
        name = " + ".join(members)
        inverse = " + ".join(f"(SELECT 1 / log_loss FROM losses WHERE model = '{m}')" for m in members)
        w = {m: f"((SELECT 1 / log_loss FROM losses WHERE model = '{m}') / ({inverse}))" for m in members}
        cells = ", ".join("(" + " + ".join(f"{m}[{i + 1}] * w_{m}" for m in members) + ")" for i in range(N_CLASSES))
        ws = ", ".join(f"{w.get(m, '0.0::DOUBLE')} AS w_{m}" for m in NAMES)
        parts.append(
            f"SELECT '{name}' AS configuration, w_alpha, w_beta, w_gamma, y, {sql_normalize('[' + cells + ']')} AS p "
            f"FROM (SELECT *, {ws} FROM meta WHERE NOT is_meta)"
        )
    return " UNION ALL ".join(parts)


SWEEP = f"""sweep AS ({_sweep_sql()}),
swept AS (SELECT configuration, w_alpha, w_beta, w_gamma, y, {sql_argmax('p')} AS pred, {sql_nll('p', 'y')} AS nll FROM sweep)"""


@query(
    "blend_sweep",
    f"""WITH {PROBS}, {LOSSES}, {META}, {SWEEP},
    cls AS (SELECT configuration, c, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS predicted,
            count(*) FILTER (y = c AND pred = c) AS hits
            FROM swept, (SELECT unnest(range(0, {N_CLASSES})) AS c) GROUP BY ALL),
    f AS (SELECT configuration, sum(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + predicted) * support END)
          / sum(support) AS f1 FROM cls GROUP BY ALL)
    SELECT configuration, round(any_value(w_alpha), 6) AS w_alpha, round(any_value(w_beta), 6) AS w_beta,
           round(any_value(w_gamma), 6) AS w_gamma, round(any_value(f1), 6) AS f1_weighted, round(avg(nll), 6) AS log_loss
    FROM swept JOIN f USING (configuration) GROUP BY configuration""",
)
def blend_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = B.blend_sweep(with_meta_split(spark, sf), NAMES, "y", _eval_flag())
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "configuration"})


@query(
    "stack_features",
    f"""WITH {PROBS}, s AS (SELECT idx, alpha || beta AS v FROM probs)
    SELECT idx, len(v) AS width, round(v[1], 6) AS first, round(v[11], 6) AS eleventh, round(list_sum(v), 6) AS total FROM s""",
    ints=["width"],
)
def stack_features(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_rows(spark, sf)
    tables = [scores.filter(F.col("model") == m) for m in ("alpha", "beta")]
    v = F.col("stacked")
    return B.stack_tables(tables).select(
        "idx", F.size(v).alias("width"), F.round(F.element_at(v, 1), 6).alias("first"),
        F.round(F.element_at(v, 11), 6).alias("eleventh"), F.round(A.array_sum(v), 6).alias("total"),
    )


def stacked_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    """Stacking model over the three probability vectors, with its scores on all rows."""
    rows = B.stack_features(with_meta_split(spark, sf), NAMES)
    rows = rows.withColumn("features", array_to_vector("stacked"))
    model = logistic_regression(rows.filter("is_meta"), Columns(), C=1.0, max_iter=200)
    scored = model.transform(rows).withColumn("P_final", A.rescale(vector_to_array("probability")))
    return scored, model


@query("stacking_classifier")
def stacking_classifier(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = stacked_rows(spark, sf)
    return scored.select("idx", "y", "is_meta", A.argmax(F.col("P_final")).alias("pred"), F.round(A.array_sum(F.col("P_final")), 6).alias("total"))


@query("argmax_class", f"WITH {PREDICTIONS} SELECT idx, pred_alpha, pred_beta, pred_gamma FROM predictions")
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return probabilities(spark, sf).select("idx", *[A.argmax(F.col(m)).alias(f"pred_{m}") for m in NAMES])


CLASSES = [10, 40, 50, 60, 1140, 1160, 1180, 1280, 1281, 1300]


@query("predict_labels", f"WITH {PROBS} SELECT idx, {CLASSES}[{sql_argmax('alpha')} + 1] AS label_pred FROM probs")
def predict_labels(spark: SparkSession, sf: str) -> DataFrame:
    return B.predict_labels(probabilities(spark, sf), "alpha", CLASSES).select("idx", "label_pred")


@query(
    "predict_with_contributions",
    f"""WITH {PROBS}, {BLEND}, c AS (SELECT *, {sql_argmax('p')} AS k FROM blend)
    SELECT idx, {CLASSES}[k + 1] AS label_pred, round(p[k + 1], 6) AS P_final, round(alpha[k + 1], 6) AS P_text,
           round(beta[k + 1], 6) AS P_image FROM c""",
)
def predict_with_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf).withColumn("final", B.blend_columns(NAMES, WEIGHTS))
    out = B.with_contributions(rows, "final", "alpha", "beta", CLASSES)
    return out.select("idx", "label_pred", *[F.round(c, 6).alias(c) for c in ("P_final", "P_text", "P_image")])


@query(
    "top_classes",
    f"""WITH {PROBS}, {BLEND}, cells AS (SELECT idx, p, alpha, beta, unnest(range(0, {N_CLASSES})) AS k FROM blend),
    r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p[k + 1] DESC, k) AS rank FROM cells)
    SELECT idx, rank, k AS class_idx, round(p[k + 1], 6) AS P_final, round(alpha[k + 1], 6) AS P_text,
           round(beta[k + 1], 6) AS P_image FROM r WHERE rank <= 5""",
    ints=["rank", "class_idx"],
)
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf).withColumn("final", B.blend_columns(NAMES, WEIGHTS))
    out = B.top_classes(rows, "final", "alpha", "beta", ["idx"])
    return out.withColumns({c: F.round(c, 6) for c in ("P_final", "P_text", "P_image")})
