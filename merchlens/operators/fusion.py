"""Stacked fusion: a classifier over probability vectors, and the whole scoring transform in one bundle.

A fitted bundle is plain numbers (temperatures, blend weights, one weight row per
class). Scoring is a column expression of the row alone, so batch and stream run the
same transform and neither shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proba import array_sum, calibrated, rescale, softmax
from ..session import local_rows, persist_to_table, run_all
from ..sources.results import load_fusion_params, save_fusion_params
from .blending import blend_columns, check_weights, configuration_scores, model_log_losses, stack_features
from .calibrate import fit_temperatures
from .classifiers import TOLERANCE, Columns, logistic_regression

# Fixed value: step limit of the stacking classifier
MAX_ITER = 3000
_CELLS = "array<struct<b:double,w:array<double>>>"


@dataclass(frozen=True)
class Stacker:
    """Softmax regression over the probability vectors of ``members``, side by side in this order."""

    members: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(
        cls, df: DataFrame, members: Sequence[str], y: str, C: float = 1.0, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE
    ) -> Stacker:
        """``df`` is read in every step: give a written table."""
        rows = stack_features(df, list(members)).select(F.col(y).cast("double").alias("y"), array_to_vector("stacked").alias("features"))
        model = logistic_regression(rows, Columns(), C=C, max_iter=max_iter, tolerance=tolerance)
        weights = tuple(tuple(w) for w in model.coefficientMatrix.toArray().tolist())
        return cls(tuple(members), tuple(model.interceptVector.toArray().tolist()), weights)

    def probabilities(self) -> Column:
        """Class probabilities from the members' columns of the same row."""
        cells = [{"b": b, "w": w} for b, w in zip(self.intercepts, self.weights, strict=True)]
        table = F.from_json(F.lit(json.dumps(cells)), _CELLS)
        x = F.concat(*[F.col(m) for m in self.members])
        scores = F.transform(table, lambda k: k["b"] + array_sum(F.zip_with(k["w"], x, lambda a, v: a * v)))
        return F.when(x.isNotNull(), softmax(scores))


def stacking_sweep(
    df: DataFrame, configurations: dict[str, Sequence[str]], y: str, is_fit: Column, C: float = 1.0,
    max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, parallelism: int = 4,
) -> tuple[DataFrame, dict[str, Stacker]]:
    """One stacker per configuration (name -> members), fitted on the ``is_fit`` rows and measured on the others.

    The members' columns are written once; the fits run side by side on that table, and
    one pass scores all configurations. Returns (configuration, f1_weighted, log_loss)
    and the stackers. Rows whose ``is_fit`` is null are left out.
    """
    if not configurations:
        raise ValueError("no configurations to fit")
    members = list(dict.fromkeys(m for names in configurations.values() for m in names))
    rows = persist_to_table(df.select(F.col(y).alias("y_true"), is_fit.alias("_fit"), *members), "stacking")
    fit = partial(Stacker.fit, rows.filter("_fit"), y="y_true", C=C, max_iter=max_iter, tolerance=tolerance)
    models = run_all([partial(fit, names) for names in configurations.values()], parallelism)
    stackers = dict(zip(configurations, models, strict=True))
    cells = [F.struct(F.lit(c).alias("configuration"), s.probabilities().alias("probs")) for c, s in stackers.items()]
    return configuration_scores(rows.filter("NOT _fit").select("y_true", F.inline(F.array(*cells)))), stackers


@dataclass(frozen=True)
class FusionModel:
    """Calibration, blend of each modality, stacker over the modalities.

    ``weights`` maps modality -> model -> weight. A model in ``temperatures`` gives
    logits, any other gives probabilities. The stacker's members are the modalities.
    """

    weights: dict[str, dict[str, float]]
    temperatures: dict[str, float]
    stacker: Stacker

    @classmethod
    def fit(
        cls, df: DataFrame, modalities: dict[str, Sequence[str]], y: str, columns: dict[str, str] | None = None,
        probabilities: Sequence[str] = (), C: float = 1.0, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE,
    ) -> FusionModel:
        """Temperatures by least cross-entropy, weights by inverse log loss within a modality, then the stacker on all rows.

        ``columns`` maps a model to its column (its own name by default); the models in
        ``probabilities`` are calibrated already and get no temperature.
        """
        models = [m for names in modalities.values() for m in names]
        if not models or len(set(models)) < len(models):
            raise ValueError("each model belongs to one modality, and there must be one")
        taken = {m: (columns or {}).get(m, m) for m in models}
        narrow = df.select(F.col(y).cast("int").alias("_y"), *[F.col(c).alias(m) for m, c in taken.items()])
        narrow = persist_to_table(narrow, "fusion-inputs")
        raw = [m for m in models if m not in probabilities]
        temperatures = fit_temperatures(narrow, raw, "_y") if raw else {}
        ready = narrow.select("_y", *[_ready(m, F.col(m), temperatures).alias(m) for m in models])
        losses = {r["model"]: r["log_loss"] for r in model_log_losses(ready, models, "_y").collect()}
        weights = {k: check_weights(list(names), {m: 1.0 / losses[m] for m in names}) for k, names in modalities.items()}
        blends = persist_to_table(ready.select("_y", *[blend_columns(list(w), w).alias(k) for k, w in weights.items()]), "fusion-blends")
        return cls(weights, temperatures, Stacker.fit(blends, list(modalities), "_y", C, max_iter, tolerance))

    def score(self, df: DataFrame, columns: dict[str, str] | None = None, final: str = "final") -> DataFrame:
        """Adds one probability array per modality, named as the modality, and the ``final`` one.

        The result is null where a model's array is null. Works on batches and streams.
        """
        hidden = {m: f"_fused_{m}" for names in self.weights.values() for m in names}
        inputs = {h: _ready(m, F.col((columns or {}).get(m, m)), self.temperatures) for m, h in hidden.items()}
        df = df.withColumns(inputs)
        blends = {k: blend_columns([hidden[m] for m in w], {hidden[m]: v for m, v in w.items()}) for k, w in self.weights.items()}
        df = df.withColumns(blends).drop(*hidden.values())
        return df.withColumn(final, self.stacker.probabilities())

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters of the models as JSON rows, the stacker as one Parquet row per class."""
        rows = [(k, m, w, self.temperatures.get(m)) for k, names in self.weights.items() for m, w in names.items()]
        save_fusion_params(local_rows(spark, rows, "modality string, model string, weight double, temperature double"), f"{path}/params")
        s = self.stacker
        cells = [(k, json.dumps(s.members), b, json.dumps(w)) for k, (b, w) in enumerate(zip(s.intercepts, s.weights, strict=True))]
        table = local_rows(spark, cells, "class_idx int, members string, intercept double, weights string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/stacker")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FusionModel:
        weights: dict[str, dict[str, float]] = {}
        temperatures = {}
        for r in load_fusion_params(spark, f"{path}/params").collect():
            weights.setdefault(r["modality"], {})[r["model"]] = r["weight"]
            if r["temperature"] is not None:
                temperatures[r["model"]] = r["temperature"]
        rows = spark.read.parquet(f"{path}/stacker").orderBy("class_idx").collect()
        if not rows or [r["class_idx"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"{path} has no stacker of classes 0, 1, …")
        members = tuple(json.loads(rows[0]["members"]))
        stacker = Stacker(members, tuple(r["intercept"] for r in rows), tuple(tuple(json.loads(r["weights"])) for r in rows))
        return cls({k: weights[k] for k in members}, temperatures, stacker)


def _ready(model: str, scores: Column, temperatures: dict[str, float]) -> Column:
    return calibrated(scores, temperatures[model]) if model in temperatures else rescale(scores)


def expected_totals(df: DataFrame, probs: str, y: str, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each class next to the sum of its probabilities: (*by, class_idx, n, expected).

    For a softmax regression with free intercepts the two agree on its training rows.
    """
    sums = [F.struct(F.lit(k).alias("class_idx"), F.count_if(F.col(y) == k).alias("n"), F.sum(F.get(probs, F.lit(k))).alias("expected"))
            for k in range(n_classes)]
    return df.groupBy(*by).agg(F.array(*sums).alias("_t")).select(*by, F.inline("_t"))
