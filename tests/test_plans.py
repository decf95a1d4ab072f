"""Plan checks: what must and must not appear in physical plans; row-only queries."""

import pytest

from merchlens.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    "numeric_tokens_light", "measure_extraction", "text_features", "keyword_features", "filter_tokens",
    "softmax", "blend_columns", "blend_score_table", "top_classes", "pixel_color_class", "classification_scores",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_have_no_python_step(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "EvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["category_names", "category_groups", "encode_labels", "stratified_split"])
def test_lookups_are_broadcast(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


ALL_WITHOUT_CROSS = [
    "category_distribution", "stratified_split", "blend_sweep", "temperature_grid", "classification_report",
    "rgb_histogram", "top_classes", "tfidf_vectors",
]


@pytest.mark.parametrize("name", ALL_WITHOUT_CROSS)
def test_no_cross_products(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_columns_are_pruned(spark, sf):
    text = plan(registry.QUERIES["unescape_html"](spark, sf))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_row_wise_blend_is_not_shuffled_by_key(spark, sf):
    assert "hashpartitioning" not in plan(registry.QUERIES["blend_columns"](spark, sf))


FLOORS = {
    "logistic_regression": 0.9,
    "complement_naive_bayes": 0.85,
    "ridge_classifier": 0.9,
    "sigmoid_calibration": 0.9,
}


@pytest.mark.parametrize("name", sorted(FLOORS))
def test_quality_floor_on_held_out_rows(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).filter("NOT is_train").selectExpr("avg(int(y = pred)) AS a").first()
    assert rows["a"] >= FLOORS[name]


def test_language_model_quality(spark, sf):
    rows = registry.QUERIES["language_model_flags"](spark, sf)
    assert rows.filter("NOT is_train").selectExpr("avg(int(lang = detected)) AS a").first()["a"] >= 0.9


def test_probabilities_of_calibrated_model_sum_to_one(spark, sf):
    assert registry.QUERIES["sigmoid_calibration"](spark, sf).filter("total <> 1").count() == 0


def test_stream_scores_every_request_once(spark, sf):
    out = registry.QUERIES["stream_scoring"](spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == documents.count() == out.select("idx").distinct().count()


@pytest.mark.parametrize("name", ["image_feature_classifier", "visual_words_kmeans", "model_store_roundtrip", "split_vectorizer"])
def test_row_only_queries_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
