"""Experiment queries run the reference's whole jobs."""

from itertools import product

import pytest

from merchlens.operators import experiments as X
from merchlens.plans import registry

SCORES = {"f1_train": 1.0, "f1_val": 1.0, "accuracy": 1.0, "train_time_s": 0.0, "pred_time_s": 0.0}


@pytest.fixture
def runs(monkeypatch):
    """(terms, n-grams, model, parameters) of every run of a query, whose fits are left out."""
    made = []

    def run(train, val, union, model, *args, **params):
        made.append((union.blocks[0][2].max_features, union.blocks[0][2].ngram_range, model, params))
        return SCORES

    monkeypatch.setattr(X, "run_union", run)
    return made


def test_cleaning_ablation_has_all_terms_and_iterations(spark, sf, runs):
    assert registry.QUERIES["cleaning_ablation"](spark, sf).count() == len(X.CLEANING_EXPERIMENTS) == len(runs)
    assert all(r == (10_000, (1, 2), "softmax", {"C": 2.0, "max_iter": 1000}) for r in runs)


def test_grid_search_has_the_whole_grid(spark, sf, runs):
    rows = registry.QUERIES["grid_search"](spark, sf).collect()
    assert {r[:2] for r in runs} == set(product((5000, 10_000, 20_000), ((1, 1), (1, 2), (1, 3)))) and len(runs) == len(rows) == 9
    assert all(r[2:] == ("softmax", {}) for r in runs) and {r["model"] for r in rows} == {"logreg"}


def test_joint_solver_predicts_as_the_library_does(spark, sf):
    train, val = (df.limit(80) for df in registry_sides(spark, sf))
    by = [X.run_vectorizer_experiment(train, val, text_columns=("designation", "description"), solver=s) for s in (None, "softmax")]
    assert by[0]["f1_score"] == pytest.approx(by[1]["f1_score"], abs=0.03) and by[1]["model"] == "logreg"


def registry_sides(spark, sf):
    from merchlens.plans.experiments import _sides, experiment_rows

    return _sides(experiment_rows(spark, sf))
