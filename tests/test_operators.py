"""Operators against brute force on small fixtures, with hot keys."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from merchlens.dims import CANONICAL_CLASSES, CANONICAL_FINGERPRINT
from merchlens.functions import proba as A
from merchlens.operators import blending as B
from merchlens.operators import calibrate as K
from merchlens.operators import classifiers as C
from merchlens.operators import labels as L
from merchlens.operators import metrics as M
from merchlens.operators import pixels as P
from merchlens.operators import splits as S
from merchlens.operators.lookup import lookup_join, salted_join
from merchlens.operators.projections import fit_discriminant, fit_pca
from merchlens.operators.scaling import scale_vectors
from merchlens.operators.summaries import describe_features
from merchlens.operators.vectorize import Vectorizer, top_terms
from merchlens.operators.visual_words import fit_words


@pytest.fixture(scope="module")
def logit_rows(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 400)
    z = rng.normal(size=(400, 4)) + 2.0 * np.eye(4)[y]
    df = spark.createDataFrame([(int(i), int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(y, z))], "idx long, y int, z array<double>")
    return df, y, z


def mean_nll(z, y, t):
    s = z / t
    return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]))


def test_temperature_is_the_optimum(logit_rows):
    df, y, z = logit_rows
    t = K.fit_temperature(df, "z", "y")
    best = mean_nll(z, y, t)
    assert all(mean_nll(z, y, t * f) >= best - 1e-12 for f in (0.9, 0.99, 0.999, 1.001, 1.01, 1.1))


def test_temperature_keeps_the_argmax(logit_rows):
    df, _, _ = logit_rows
    same = df.filter(A.argmax(A.calibrated(F.col("z"), 3.0)) != A.argmax(F.col("z")))
    assert same.count() == 0


def test_temperature_bounds(spark):
    right = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "y int, z array<double>")
    assert K.fit_temperature(right, "z", "y") == K.MIN_TEMPERATURE
    wrong = spark.createDataFrame([(1, [1.0, 0.0]), (0, [0.0, 1.0])], "y int, z array<double>")
    assert K.fit_temperature(wrong, "z", "y") == K.MAX_TEMPERATURE


def test_probability_invariants(logit_rows):
    df, _, _ = logit_rows
    p = A.softmax(F.col("z"))
    row = df.select(
        F.max(F.abs(A.array_sum(p) - 1)).alias("sum"),
        F.max(F.abs(A.array_sum(A.normalize(F.col("z"))) - 1)).alias("norm"),
    ).first()
    assert max(row) < 1e-12


def test_blend_of_equal_inputs_is_the_input(logit_rows):
    df, _, _ = logit_rows
    rows = df.withColumn("a", A.softmax(F.col("z"))).withColumn("b", F.col("a"))
    rows = rows.withColumn("c", B.blend_columns(["a", "b"], {"a": 5.0, "b": 1.0}))
    gap = F.array_max(F.zip_with("a", "c", lambda x, y: F.abs(x - y)))
    assert rows.agg(F.max(gap)).first()[0] < 1e-12


def test_blend_checks(spark):
    with pytest.raises(KeyError):
        B.check_weights(["a", "b"], {"a": 1.0})
    with pytest.raises(KeyError):
        B.check_weights(["a"], {"a": 1.0, "b": 1.0})
    with pytest.raises(ValueError):
        B.check_weights(["a"], {"a": 0.0})
    scores = spark.createDataFrame([(1, "a", [0.5, 0.5]), (1, "b", [0.2, 0.8]), (2, "a", [1.0, 0.0])], "idx long, model string, probs array<double>")
    with pytest.raises(Exception, match="incomplete scores"):
        B.blend_scores(scores, {"a": 1.0, "b": 1.0}, 2).collect()
    full = B.blend_scores(scores.filter("idx = 1"), {"a": 1.0, "b": 1.0}, 2).first()["probs"]
    assert full == pytest.approx([0.35, 0.65])


def test_split_with_one_hot_class(spark):
    """A class with nearly all rows: exact counts, reproducible, same as a full ranking."""
    rows = spark.range(20_000).select(F.col("id").alias("idx"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("y"))
    got = S.stratified_flag(rows, "y", "idx", 0.7).filter("in_first")
    counts = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts == {"hot": round(19_600 * 0.7), "rare": round(400 * 0.7)}
    import hashlib

    order = sorted(range(0, 20_000, 50), key=lambda i: (hashlib.md5(f"42{i}".encode()).hexdigest(), i))
    assert {r["idx"] for r in got.filter("y = 'rare'").collect()} == set(order[:280])


def test_split_of_tiny_classes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "idx long, y string")
    flags = {r["idx"]: r["in_first"] for r in S.stratified_flag(rows, "y", "idx", 0.3).collect()}
    assert flags[1] is False and sum(flags.values()) == 1
    everything = S.assign_split(rows, "y", "idx", 0.5, 0.5)
    assert everything.count() == 3


def test_signature_is_order_free_and_sensitive(spark):
    rows = spark.range(100).select(F.col("id").alias("idx"), F.when(F.col("id") < 70, "train").otherwise("test").alias("split"))
    a = S.split_signature(rows).first()[0]
    assert a == S.split_signature(rows.orderBy(F.desc("idx")).repartition(7)).first()[0]
    moved = rows.withColumn("split", F.when(F.col("idx") == 0, "test").otherwise(F.col("split")))
    assert a != S.split_signature(moved).first()[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 30)], "k long, n string")
    want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
    assert sorted(map(tuple, salted_join(big, small, ["k"], how, 5).collect()), key=str) == want
    assert sorted(map(tuple, lookup_join(big, small, ["k"], how, max_rows=3).collect()), key=str) == want
    assert sorted(map(tuple, lookup_join(big, small, ["k"], how).collect()), key=str) == want


def test_quantiles_are_exact_under_skew(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(9000), rng.lognormal(size=21_000)])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v), int(v * 10)) for v in x], "a double, b int").repartition(4)
    rows = {r["feature"]: r for r in describe_features(df, ["a", "b"]).collect()}
    for name, values in (("a", x), ("b", (x * 10).astype(int))):
        r = rows[name]
        assert [r["q25"], r["median"], r["q75"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
        assert r["std"] == pytest.approx(np.std(values, ddof=1))


def test_describe_of_no_rows(spark):
    df = spark.createDataFrame([], "a double")
    assert describe_features(df, ["a"]).first()["count"] == 0


def test_top_terms_breaks_ties_by_term(spark):
    stats = spark.createDataFrame([(f"t{i:03d}", 5 if i < 3 else 2, 2) for i in range(100)], "term string, tf long, df long")
    got = sorted(r["term"] for r in top_terms(stats, 10).collect())
    assert got == ["t000", "t001", "t002"] + [f"t{i:03d}" for i in range(3, 10)]
    assert top_terms(stats, 1000).count() == 100


def test_vocabulary_bounds(spark):
    docs = spark.createDataFrame([("aa bb",), ("aa cc cc",), ("aa bb dd",)], "x string")
    terms = {r["term"]: (r["tf"], r["df"]) for r in Vectorizer(ngram_range=(1, 1), max_df=0.95).vocabulary(docs, "x").collect()}
    assert terms == {"bb": (2, 2)}
    with pytest.raises(ValueError):
        Vectorizer(min_df=9).fit(docs, "x")
    with pytest.raises(ValueError):
        Vectorizer.preset("nope")
    assert Vectorizer.preset("large").max_features == 20_000


def test_population_scaling(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "a array<double>").select(array_to_vector("a").alias("x"))
    scaled, _ = scale_vectors(df, "x", "s")
    assert [list(r["s"]) for r in scaled.collect()] == [pytest.approx([-1.0, 0.0]), pytest.approx([1.0, 0.0])]


def test_labels(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([10, 2280, 10, 50])], "idx int, prdtypecode int")
    encoded = L.encode_labels(rows)
    assert [r["y"] for r in encoded.orderBy("idx").collect()] == [0, 18, 0, 2]
    back = L.decode_labels(encoded.drop("prdtypecode"))
    assert [r["prdtypecode"] for r in back.orderBy("idx").collect()] == [10, 2280, 10, 50]
    with pytest.raises(Exception, match="unknown class"):
        L.encode_labels(spark.createDataFrame([(1, 7)], "idx int, prdtypecode int")).collect()
    assert L.fingerprint(CANONICAL_CLASSES) == CANONICAL_FINGERPRINT
    with pytest.raises(AssertionError):
        L.reorder_probabilities(F.col("p"), [1, 2], [1, 3])


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "y_true int, y_pred int")
    r = M.evaluate(df).first()
    assert r["accuracy"] == pytest.approx(0.5)
    assert r["f1_macro"] == pytest.approx((0.5 + 2 / 3 + 0.0) / 3)
    assert M.confusion_rate(M.confusion_counts(df), 9, 0).first()["rate"] == 0.0


def test_best_values_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 7.0), ("a", 2, 0.9, None)], "name string, epoch int, f1 double, loss double")
    assert M.best_row_per_run(df, "name", "f1", "epoch").first()["loss"] is None
    assert M.best_values_per_run(df, "name", "f1", "epoch").first()["loss"] == 7.0


def test_sigmoid_fit_is_the_optimum(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * f))).astype(int)
    rows = [(0, int(1 - t), [float(v), float(-v)]) for v, t in zip(f, y)]
    fit = K.fit_sigmoids(spark.createDataFrame(rows, "fold int, y int, margins array<double>"), 2).filter("class_idx = 0").first()
    pos, neg = y.sum(), 300 - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(a * f + b))
        return -np.mean(t * np.log(p) + (1 - t) * np.log(1 - p))

    best = loss(fit["a"], fit["b"])
    assert all(loss(fit["a"] + da, fit["b"] + db) >= best - 1e-12 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, a array<double>").withColumn("features", array_to_vector("a"))
    model = C.ridge_classifier(df, 3)
    xc = x - x.mean(0)
    for k, m in enumerate(model.models):
        t = np.where(y == k, 1.0, -1.0)
        w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (t - t.mean()))
        assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)


def test_discriminant_whitens_within_classes(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) @ np.diag([1, 5, 0.2, 1]) + 3 * np.eye(3, 4)[y]
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, a array<double>").withColumn("v", array_to_vector("a"))
    out = fit_discriminant(df, "v", "y").transform(df, "v").select("y", "lda").collect()
    p, yy = np.array([r["lda"] for r in out]), np.array([r["y"] for r in out])
    within = sum((p[yy == k] - p[yy == k].mean(0)).T @ (p[yy == k] - p[yy == k].mean(0)) for k in range(3)) / 297
    assert p.shape[1] == 2 and np.allclose(within, np.eye(2), atol=1e-6)


def test_pca_components_are_uncorrelated(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([([float(v) for v in a],) for a in x], "a array<double>").withColumn("v", array_to_vector("a"))
    out, _ = fit_pca(df, "v", 3)
    p = np.array([r[0] for r in out.select(vector_to_array("pca")).collect()])
    cov = np.cov(p.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)


def test_no_descriptor_is_an_error(spark):
    with pytest.raises(ValueError):
        fit_words(spark.createDataFrame([], "image_id long, vec array<float>"), 3)


def test_pixels_without_colour(spark):
    white = spark.createDataFrame([(1, r, c, 255, 255, 255) for r in range(2) for c in range(2)], "image_id long, row int, col int, r int, g int, b int")
    assert list(P.mean_rgb(white).first())[1:] == [127.0, 127.0, 127.0]
    box = P.foreground_box(white, 2).first()
    assert (box["cropped"], box["r_max"], box["c_max"]) == (False, 2, 2)
    hist = P.rgb_histogram(white, 225, 15, 240).first()
    assert sum(hist["hist_r"]) == 0 and len(hist["hist_r"]) == 225
    p = P.category_proportions(P.color_classes(white), "image_id", "color_class", [3, 4]).first()
    assert (p["p_3"], p["p_4"]) == (0.0, 0.0)


def test_known_hsv_values(spark):
    rows = [(255, 0, 0, 0), (0, 255, 0, 60), (0, 0, 255, 120), (255, 255, 0, 30), (200, 10, 180, None)]
    df = spark.createDataFrame([(i, 0, 0, r, g, b) for i, (r, g, b, _) in enumerate(rows)], "image_id int, row int, col int, r int, g int, b int")
    got = [r["h"] for r in P.with_hsv(df).orderBy("image_id").collect()]
    assert got[:4] == [h for *_, h in rows[:4]]
    assert math.isclose(got[4], 153, abs_tol=1)


def test_complement_bayes_agrees_with_spark_ml(spark):
    rng = np.random.default_rng(8)
    counts = rng.poisson(1.0, size=(60, 6)) + 3 * np.eye(3, 6)[rng.integers(0, 3, 60)].astype(int)
    y = counts[:, :3].argmax(1)
    wide = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(counts, y))], "doc int, y double, a array<double>").withColumn("features", array_to_vector("a"))
    model = C.complement_naive_bayes(wide)
    ml = {r["doc"]: int(r["prediction"]) for r in model.transform(wide).collect()}
    long = wide.select("doc", F.col("y").cast("int").alias("class_idx"), F.posexplode("a").alias("p", "value"))
    long = long.withColumn("term", F.concat(F.lit("t"), F.col("p")))
    totals = long.groupBy("class_idx", "term").agg(F.sum("value").alias("n"))
    weights = C.complement_log_weights(totals, [0, 1, 2])
    scores = C.linear_scores(long.select("doc", "term", "value"), weights, "doc")
    sql = {r["doc"]: r["c"] for r in scores.groupBy("doc").agg(F.max_by("class_idx", "score").alias("c")).collect()}
    assert sql == ml


def test_side_tables_too_wide_to_broadcast_are_salted(spark, monkeypatch):
    from merchlens.operators import lookup

    big = spark.range(50).selectExpr("id % 5 AS k", "id AS v")
    small = spark.range(5).selectExpr("id AS k", "repeat('x', 1000) AS w")
    plans = []
    for most in (64 << 20, 100):
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", most)
        joined = lookup.lookup_join(big, small, ["k"])
        assert joined.count() == 50
        plans.append("_salt" in joined._jdf.queryExecution().toString())
    assert plans == [False, True]


def test_unknown_codes_are_counted_but_not_listed(spark):
    from merchlens.operators.labels import group_summary

    df = spark.createDataFrame([(10,), (10,), (2280,), (-1,), (-2,), (-2,)], "prdtypecode int")
    rows = {r["group_name"]: (r["rows"], r["categories"], r["codes"]) for r in group_summary(df).collect()}
    assert rows[None] == (3, 2, "") and sum(r[0] for r in rows.values()) == 6


def test_fits_that_do_not_settle_raise(spark):
    from merchlens.operators.calibrate import fit_temperature

    df = spark.createDataFrame([([2.0, 1.0, 0.0], 0), ([0.0, 3.0, 1.0], 1), ([0.0, 1.0, 1.5], 1)], "z array<double>, y int")
    assert fit_temperature(df, "z", "y") > 0
    with pytest.raises(RuntimeError):
        fit_temperature(df, "z", "y", max_iter=1)
