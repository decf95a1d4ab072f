"""Wall-clock of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from merchlens.plans import registry
from merchlens.session import build_session, scratch_scope

HEADLINE = (
    "catalog_language_report", "features_labels_join", "final_clean", "clean_columns", "filter_tokens", "remove_punctuation",
    "unescape_html", "numeric_tokens_light", "numeric_tokens_full", "numeric_title_merge", "measure_extraction",
    "text_features", "feature_description", "keyword_features", "unit_features", "language_vote_flags",
    "vocabulary", "count_vectors", "tfidf_vectors", "standard_scaler",
    "category_distribution", "stratified_split", "train_val_test_split", "split_signature",
    "calibrated_probabilities", "temperature_grid", "blend_columns", "blend_score_table", "blend_sweep", "top_classes",
    "predict_with_contributions", "classification_report", "top_confusions", "best_row_per_run", "result_statistics",
    "linear_scores_by_join", "pixel_color_class", "mean_rgb", "rgb_histogram", "histogram_contrast", "color_proportions",
    "foreground_box", "visual_word_histogram", "batch_scoring",
    "logistic_regression", "ridge_classifier", "complement_naive_bayes", "random_forest", "pca_projection", "fitted_temperatures",
)
#: The fitting queries take long; they run once, the others so often, and the median counts.
FITS = HEADLINE[HEADLINE.index("batch_scoring") + 1 :]
RUNS = 3


def run(spark, name: str, sf: str) -> float:
    with scratch_scope(spark):
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    registry.load_all()
    spark = build_session("bench", cpus)
    run(spark, "final_clean", sf)  # start the JVM's workers and compile the cleaning rules before the first timing
    times = {name: round(median(run(spark, name, sf) for _ in range(1 if name in FITS else RUNS)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
