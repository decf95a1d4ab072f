import math

import numpy as np
import pytest

from merchlens.llm import vectors as V


def brute(x, ids, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(near), strict=True):
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    return {i: (int(n), root[i]) for i, n in zip(ids, near.sum(1), strict=True)}


@pytest.mark.parametrize("bucket", [256, 16])
def test_links_and_components_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(V, "BUCKET", bucket)
    monkeypatch.setattr(V, "SEGMENT", 40)
    monkeypatch.setattr(V, "RECALL", 0.9999)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base + 0.25 * rng.standard_normal(base.shape) for _ in range(5)] + [base[:3], rng.standard_normal((60, 24))])
    ids = rng.permutation(len(x) * 3)[: len(x)].tolist()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, n long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_vectors(df, recall=0.9999).collect()}
    assert got == brute(x, ids)


def test_edge_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 0.0]),
        (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e-200, 0.0]), (12, [5.0]), (13, [7.0]), (14, [-1.0, 0.0]), (14, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS h1")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in V.near_vectors(df).collect())
    want = [(0, 0, 0, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)] + [(11, 3, 1, False), (12, 1, 12, True), (13, 1, 12, False), (14, 1, 14, True), (14, 1, 14, True)]
    assert got == want
    assert V.near_vectors(df.limit(0)).count() == 0


def test_plan_keeps_the_recall_at_any_size():
    for n in (10, 10**4, 10**7, 10**10):
        bits, tables = V.plan(n)
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.98 and n / 2**bits < 2 * V.BUCKET * max(1, n / V.BUCKET / 2**40)


def test_no_near_pair_is_lost_to_the_bounds():
    rng = np.random.default_rng(8)
    x = V.unit(rng.standard_normal((300, 64)))
    y = V.unit(x + 0.45 * V.unit(rng.standard_normal(x.shape)))
    a, b = V.linked(x, y, 0.9)
    want = np.nonzero(np.einsum("ij,kj->ik", x, y) >= 0.9)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*(w.tolist() for w in want), strict=True))
