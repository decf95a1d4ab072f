"""Calibration, blend and stacking as one bundle, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.functions.proba import softmax
from merchlens.operators import blending as B
from merchlens.operators.calibrate import MAX_TEMPERATURE, MIN_TEMPERATURE, fit_temperatures
from merchlens.operators.fusion import FusionModel, Stacker, stacking_sweep
from merchlens.plans import registry

MODALITIES = {"text": ["a", "b"], "image": ["c"]}


def np_softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 300)
    z = {m: rng.normal(size=(300, 4)) * 2 + s * np.eye(4)[y] for m, s in (("a", 3.0), ("b", 1.5), ("c", 2.0))}
    rows = [(i, int(y[i]), *[z[m][i].tolist() for m in z]) for i in range(300)]
    schema = "idx long, y int, a array<double>, b array<double>, c array<double>"
    return y, z, spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def model(made):
    return FusionModel.fit(made[2], MODALITIES, "y", tolerance=1e-8)


def test_temperatures_are_minima(made, model):
    y, z, _ = made

    def loss(m, t):
        return -np.log(np_softmax(z[m] / t)[np.arange(300), y]).mean()

    for m, t in model.temperatures.items():
        assert loss(m, t) < min(loss(m, t * 1.001), loss(m, t / 1.001))


def test_temperatures_at_the_ends_and_without_rows(spark):
    rows = [(0, [5.0, 0.0], [1.0, 1.0], [0.0, 5.0]), (1, [0.0, 5.0], [1.0, 1.0], [5.0, 0.0])]
    df = spark.createDataFrame(rows, "y int, sure array<double>, flat array<double>, wrong array<double>")
    found = fit_temperatures(df, ["sure", "wrong"], "y")
    assert list(found) == ["sure", "wrong"] and found["wrong"] == MAX_TEMPERATURE
    assert MIN_TEMPERATURE <= found["sure"] < 0.05
    with pytest.raises(ValueError):
        fit_temperatures(df.filter("y > 5"), ["sure"], "y")


def test_score_is_the_chain_of_its_parts(made, model):
    y, z, df = made
    cal = {m: np_softmax(z[m] / model.temperatures[m]) for m in z}
    losses = {m: -np.log(p[np.arange(300), y]).mean() for m, p in cal.items()}
    total = 1 / losses["a"] + 1 / losses["b"]
    assert model.weights["text"] == pytest.approx({m: 1 / losses[m] / total for m in "ab"}) and model.weights["image"] == {"c": 1.0}
    text = sum(cal[m] * model.weights["text"][m] for m in "ab")
    x = np.hstack([text, cal["c"]])
    final = np_softmax(x @ np.array(model.stacker.weights).T + np.array(model.stacker.intercepts))
    got = {r["idx"]: r for r in model.score(df).collect()}
    for i in range(300):
        assert np.allclose(got[i]["text"], text[i]) and np.allclose(got[i]["image"], cal["c"][i])
        assert np.allclose(got[i]["final"], final[i])
    # the stacker's penalised loss has no slope left: sums of residual x input against the weights
    residual = final - np.eye(4)[y]
    assert np.abs(residual.sum(axis=0)).max() < 0.01
    assert np.abs(residual.T @ x + np.array(model.stacker.weights)).max() < 0.02


def test_score_shuffles_nothing_and_keeps_columns(made, model):
    df = made[2].withColumn("extra", F.lit(1))
    out = model.score(df)
    assert out.columns == [*df.columns, "text", "image", "final"]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (df, out)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "Python" not in plans[1]


def test_missing_scores_give_null(spark, model):
    row = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], None, [0.0] * 4)], "a array<double>, b array<double>, c array<double>")
    out = model.score(row).first()
    assert out["text"] is None and out["final"] is None and out["image"] == pytest.approx([0.25] * 4)
    assert model.score(row.limit(0)).count() == 0


def test_bundle_comes_back_from_storage(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "bundle"))
    assert FusionModel.load(spark, str(tmp_path / "bundle")) == model


def test_models_that_are_calibrated_get_no_temperature(made):
    df = made[2].withColumns({m: softmax(F.col(m)) for m in "abc"})
    model = FusionModel.fit(df, MODALITIES, "y", probabilities=["a", "b", "c"])
    assert model.temperatures == {}
    assert model.score(df).filter(F.abs(F.aggregate("final", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9).count() == 0


@pytest.mark.parametrize("modalities", [{}, {"text": ["a", "b"], "image": ["b"]}])
def test_modalities_must_share_no_model(made, modalities):
    with pytest.raises(ValueError):
        FusionModel.fit(made[2], modalities, "y")


def test_sweep_measures_each_configuration_on_the_other_rows(made):
    y, z, df = made
    df = df.withColumns({m: softmax(F.col(m)) for m in "abc"})
    wanted = {"a + b": ["a", "b"], "all": ["a", "b", "c"]}
    scores, stackers = stacking_sweep(df, wanted, "y", F.col("idx") % 3 != 0)
    got = {r["configuration"]: r for r in scores.collect()}
    held_out = np.arange(300) % 3 == 0
    for name, members in wanted.items():
        x = np.hstack([np_softmax(z[m]) for m in members])
        s = stackers[name]
        p = np_softmax(x @ np.array(s.weights).T + np.array(s.intercepts))[held_out]
        truth, pred = y[held_out], p.argmax(axis=1)
        f1 = [2 * ((pred == k) & (truth == k)).sum() / max((pred == k).sum() + (truth == k).sum(), 1) for k in range(4)]
        assert got[name]["f1_weighted"] == pytest.approx(sum(f * (truth == k).sum() for k, f in enumerate(f1)) / len(truth))
        assert got[name]["log_loss"] == pytest.approx(-np.log(p[np.arange(len(truth)), truth]).mean())
    with pytest.raises(ValueError):
        stacking_sweep(df, {}, "y", F.col("idx") > 0)


def test_stacking_beats_the_lone_models_on_its_own_rows(made):
    df = made[2].withColumns({m: softmax(F.col(m)) for m in "abc"})
    stacker = Stacker.fit(df, ["a", "b", "c"], "y")
    scored = df.withColumn("p", stacker.probabilities())
    losses = {r["model"]: r["log_loss"] for r in B.model_log_losses(scored, ["a", "b", "c", "p"], "y").collect()}
    assert losses["p"] < min(losses[m] for m in "abc")


def test_queries_of_the_sweep_and_of_scoring(spark, sf):
    sweep = registry.QUERIES["stacking_sweep"](spark, sf).collect()
    assert len(sweep) == 8 and len({(r["method"], r["configuration"]) for r in sweep}) == 8
    assert all(0 <= r["f1_weighted"] <= 1 and r["log_loss"] > 0 for r in sweep)
    scored = registry.QUERIES["fused_scoring"](spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert scored.filter("P_final is null or P_final <= 0 or P_final > 1 or label_pred is null").count() == 0
