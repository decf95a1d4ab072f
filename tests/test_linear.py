"""Joint linear solvers against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from merchlens.operators import linear as L


def made(seed, n=240, d=6, classes=3):
    """Rows of a dense and of a sparse half; some columns are zero in the sparse ones."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) + 1.2 * np.eye(classes, d)[y]
    x[rng.random((n, d)) < 0.3] = 0.0
    return x, y


def frame(spark, x, y, parts=3):
    rows = []
    for i, (v, label) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        at = [k for k, a in enumerate(v) if a]
        rows.append((i, float(label), Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), at, [v[k] for k in at])))
    return spark.createDataFrame(rows, ["idx", "y", "features"]).repartition(parts)


def svm_gradient(x, y, k, w, b, C):
    t = np.where(y == k, 1.0, -1.0)
    short = np.maximum(1 - t * (x @ w + b), 0)
    return 0.5 * (w @ w + b * b) + C * (short**2).sum(), np.append(w - 2 * C * x.T @ (t * short), b - 2 * C * (t * short).sum())


@pytest.mark.parametrize("C", [0.01, 0.2, 5.0])
def test_support_vectors_are_the_minimum(spark, C):
    x, y = made(1)
    model = L.squared_hinge_svm(frame(spark, x, y), 3, C=C)
    for k, (w, b) in enumerate(model.models):
        value, gradient = svm_gradient(x, y, k, w.toArray(), b, C)
        first = np.linalg.norm(svm_gradient(x, y, k, np.zeros(6), 0.0, C)[1])
        assert np.linalg.norm(gradient) <= 1e-4 * first
        assert value == pytest.approx(model.history[-1]["objective"][k])
    objectives = [h["objective"].sum() for h in model.history]
    assert objectives == sorted(objectives, reverse=True) and len(objectives) < 40


def test_margins_and_prediction_are_row_by_row(spark):
    x, y = made(2)
    df = frame(spark, x, y)
    model = L.ridge(df, 3)
    out = {r["idx"]: r for r in model.transform(df).collect()}
    z = x @ model.weights + model.intercepts
    assert all(np.allclose(out[i]["margins"], z[i]) and out[i]["prediction"] == z[i].argmax() for i in range(len(x)))
    scored = model.margins(spark.range(10).selectExpr("id").crossJoin(df.limit(1).coalesce(1)).select("features"))
    before = scored.drop("margins")._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange") == before


@pytest.mark.parametrize("few", [0, 100])
def test_sums_of_many_tasks(spark, monkeypatch, few):
    """All ways of adding up give the same model: on the driver, in one level, in two."""
    x, y = made(3, n=90)
    df = frame(spark, x, y, 5)
    want = L.ridge(df, 3)
    monkeypatch.setattr(L, "FEW", few)
    monkeypatch.setattr(L, "FAN_IN", 2)
    monkeypatch.setattr(L, "SLICE", 4)
    monkeypatch.setattr(L, "BLOCK_VALUES", 20)
    assert np.allclose(L.ridge(df, 3).weights, want.weights)
    assert np.allclose(L.squared_hinge_svm(df, 3).weights, L.squared_hinge_svm(frame(spark, x, y, 1), 3).weights, atol=1e-3)


def test_ridge_with_many_classes_and_absent_ones(spark):
    x, y = made(4, classes=6)
    model = L.ridge(frame(spark, x, y), 8, alpha=2.5)
    centred = x - x.mean(0)
    for k in range(8):
        t = np.where(y == k, 1.0, -1.0)
        w = np.linalg.solve(centred.T @ centred + 2.5 * np.eye(6), centred.T @ (t - t.mean()))
        assert np.allclose(model.weights[:, k], w, atol=1e-6)
        assert model.intercepts[k] == pytest.approx(t.mean() - x.mean(0) @ w)


def test_odd_rows_are_errors(spark):
    x, y = made(5, n=20)
    df = frame(spark, x, y)
    for bad in (df.selectExpr("IF(idx = 3, NULL, y) AS y", "features"), df.selectExpr("IF(idx = 3, 7D, y) AS y", "features"),
                df.selectExpr("y", "IF(idx = 3, NULL, features) AS features"), df.limit(0)):
        with pytest.raises(ValueError):
            L.ridge(bad, 3)
    with pytest.raises(RuntimeError):
        L.squared_hinge_svm(df, 3, max_iter=1)


def softmax_gradient(x, y, w, b, C):
    z = x @ w + b
    z = z - z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    value = 0.5 * (w**2).sum() - C * np.log(p[np.arange(len(y)), y]).sum()
    miss = p - np.eye(w.shape[1])[y]
    return value, np.vstack([w + C * x.T @ miss, C * miss.sum(0)])


def test_softmax_fits_are_the_minima(spark):
    """Several strengths and column factors in joint passes: each is the minimum of its own objective."""
    x, y = made(6)
    factors = np.array([2.0, 2.0, 1.0, 1.0, 0.5, 1.0])
    fits = [(0.1, None), (1.0, factors), (8.0, None)]
    for (C, f), model in zip(fits, L.softmax_fits(frame(spark, x, y), 3, fits), strict=True):
        f = np.ones(6) if f is None else f
        value, gradient = softmax_gradient(x * f, y, model.weights / f[:, None], model.intercepts, C)
        first = np.linalg.norm(softmax_gradient(x * f, y, np.zeros((6, 3)), np.zeros(3), C)[1])
        assert np.linalg.norm(gradient) <= 1e-4 * first
        assert value == pytest.approx(model.history[-1]["objective"])


def test_softmax_regression_is_the_library_model(spark):
    from merchlens.operators.classifiers import fit_model, logistic_regression

    x, y = made(7)
    df = frame(spark, x, y)
    joint, library = fit_model("softmax", df), logistic_regression(df, tolerance=1e-9)
    want = library.coefficientMatrix.toArray().T
    assert np.allclose(joint.weights, want - want.mean(1, keepdims=True), atol=2e-2)
    same = joint.transform(df).select("idx", "prediction").exceptAll(library.transform(df).select("idx", "prediction")).count()
    assert same <= 2


def test_strengths_together_are_the_strengths_alone(spark, monkeypatch):
    x, y = made(8)
    df = frame(spark, x, y)
    together = L.squared_hinge_strengths(df, 3, [0.03, 0.5, 2.0])
    for C, model in zip([0.03, 0.5, 2.0], together, strict=True):
        alone = L.squared_hinge_svm(df, 3, C=C, tolerance=1e-6)
        assert np.allclose(model.weights, alone.weights, atol=1e-2)
        assert (model.history[-1]["gradient"] <= model.history[-1]["settled_at"]).all()
    monkeypatch.setattr(L, "MOST_CELLS", 50)  # two fits at a time
    assert [m.weights.shape for m in L.softmax_fits(df, 3, [(c, None) for c in (0.1, 1.0, 2.0)])] == [(6, 3)] * 3


def test_fits_scored_together_are_scored_alone(spark):
    from merchlens.operators.experiments import evaluate_fits
    from merchlens.operators.metrics import evaluate

    x, y = made(9)
    df = frame(spark, x, y)
    train, val = df.filter("idx < 160"), df.filter("idx >= 160")
    models = L.softmax_fits(train, 3, [(0.01, None), (1.0, None)])
    together = evaluate_fits(models, train, val)
    for i, model in enumerate(models):
        for part, rows in (("train", train), ("val", val)):
            alone = evaluate(model.transform(rows), "y", "prediction").first()
            assert together[i][f"f1_{part}"] == pytest.approx(alone["f1_weighted"])
        assert together[i]["accuracy"] == pytest.approx(alone["accuracy"])


def test_products_of_blocks_with_rows_without_values():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9, 5)) * (rng.random((9, 5)) < 0.5)
    x[[0, 4, 8]] = 0.0
    row, column = x.nonzero()
    w, r = rng.normal(size=(6, 3)), rng.normal(size=(9, 3))
    block = L.Block(np.zeros(9), row, column.astype(np.int32), x[row, column], 5)
    assert np.allclose(block.times(w), x @ w[:5] + w[5]) and np.allclose(block.times(w[:5]), x @ w[:5])
    assert np.allclose(block.transposed_times(r, True), np.vstack([x.T @ r, r.sum(0)]))
    empty = L.Block(np.zeros(2), row[:0], column[:0].astype(np.int32), np.empty(0), 5)
    assert not empty.times(w[:5]).any() and not empty.transposed_times(r[:2], False).any()
