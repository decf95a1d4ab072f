"""Exact quartiles, however many rows a sketch's bracket holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.operators import summaries as U

COLUMNS = {
    "spread": "id * 7919 % 40009",
    "tied": "if(id % 3 = 0, id, 5)",
    "two": "id % 2",
    "flat": "3",
    "steep": "pow(1.0005, id)",
    "mostly_null": "if(id % 50 = 0, -id, null)",
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 20000, 1, 5).selectExpr(*[f"cast({e} as double) AS {c}" for c, e in COLUMNS.items()])


@pytest.mark.parametrize("accuracy, inside", [(10_000, 100_000), (10_000, 2), (20, 50)])
def test_quartiles_are_exact(rows, monkeypatch, accuracy, inside):
    monkeypatch.setattr(U, "ACCURACY", accuracy)
    monkeypatch.setattr(U, "INSIDE", inside)
    got = {r["feature"]: r for r in U.describe_features(rows, list(COLUMNS)).collect()}
    for c in COLUMNS:
        x = np.array([r[0] for r in rows.select(c).dropna().collect()])
        want = np.quantile(x, [0.25, 0.5, 0.75])
        assert [got[c][q] for q in ("q25", "median", "q75")] == pytest.approx(want.tolist(), rel=1e-12)
        assert got[c]["count"] == len(x)


def test_brackets_are_bounded(rows, monkeypatch):
    """What one task ranks stays below the bound, also where a first sketch leaves far more."""
    monkeypatch.setattr(U, "ACCURACY", 20)
    monkeypatch.setattr(U, "INSIDE", 50)
    brackets = [(c, "median", 0.5 * (n - 1), float(lo), float(hi)) for c, n, lo, hi in (("spread", 20000, 0, 40008), ("tied", 20000, 0, 19998))]
    found, under = U._narrowed(rows, brackets)
    for (c, _, pos, lo, hi), below in zip(found, under, strict=True):
        x = F.col(c)
        assert rows.filter((x > lo) & (x < hi)).count() <= 50
        assert below == rows.filter(x < lo).count() <= pos < rows.filter(x <= hi).count()
