"""Validated export and verified load of prediction sets.

Layout: ``<root>/data/model=<m>/split=<s>/run=<id>/*.parquet`` and one metadata row
under ``<root>/meta/model=<m>/split=<s>``. Each export writes a new run folder and
the metadata row that points to it comes last, so a failed or repeated export never
leaves metadata that describes other data.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CANONICAL_CLASSES, CANONICAL_FINGERPRINT
from ..operators.labels import fingerprint
from ..schemas import EXPORT_META, require_columns
from ..session import remove_path


def export_predictions(
    df: DataFrame, root: str, model: str, split: str, signature: str,
    classes: list[int] | None = None, extra: dict[str, str] | None = None,
    canonical: list[int] | None = None, has_y_true: bool | None = None,
) -> dict:
    """Write (idx, probs[, y_true]) after checking class order, widths and unique ids."""
    if not isinstance(signature, str) or not signature.strip():
        raise AssertionError("a non-empty split signature is required")
    canonical = canonical or CANONICAL_CLASSES
    classes = list(classes or canonical)
    fp, want = fingerprint(classes), fingerprint(canonical)
    if fp != want:
        raise AssertionError(f"classes mismatch: expected_fp={want} got_fp={fp}")
    require_columns(df, ["idx", "probs"])
    has_y = "y_true" in df.columns if has_y_true is None else has_y_true
    k = len(classes)

    data = df.select(
        F.col("idx").cast("long"),
        F.col("probs").cast("array<float>"),
        *([F.col("y_true").cast("long")] if has_y else []),
    )
    target = f"{root}/data/model={model}/split={split}/run={uuid.uuid4().hex[:12]}"
    data.write.parquet(target)
    # The checks read what was written, so a recomputed input cannot differ from the files.
    # Ids are grouped first: a distinct count without a group would end in one task.
    written = df.sparkSession.read.parquet(target)
    per_id = written.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size("probs"), F.lit(-1)) != k).alias("bad_width"),
        (F.count_if(F.col("y_true").isNull()) if has_y else F.lit(0)).alias("no_label"),
    )
    checks = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("idx").isNull()).alias("null_ids"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        F.coalesce(F.sum("bad_width"), F.lit(0)).alias("bad_width"),
        F.coalesce(F.sum("no_label"), F.lit(0)).alias("no_label"),
    ).first()
    problems = {c: checks[c] for c in ("null_ids", "repeated_ids", "bad_width", "no_label") if checks[c]}
    if problems:
        remove_path(df.sparkSession, target)
        raise AssertionError(f"invalid predictions for model={model} split={split}: {problems}")
    n = int(checks["rows"])
    meta = (
        model, split, signature, fp, k, n, has_y, [n, k], "float32",
        datetime.now(timezone.utc).isoformat(), {a: str(b) for a, b in (extra or {}).items()}, target,
    )
    row = df.sparkSession.createDataFrame([meta], EXPORT_META).coalesce(1)
    row.write.mode("overwrite").json(f"{root}/meta/model={model}/split={split}")
    return {"path": target, "classes_fp": fp, "split_signature": signature, "num_samples": n}


def load_metadata(spark: SparkSession, root: str, model: str, split: str) -> dict:
    path = f"{root}/meta/model={model}/split={split}"
    try:
        rows = spark.read.schema(EXPORT_META).json(path).take(1)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no prediction metadata at {path}") from missing
    if not rows:
        raise FileNotFoundError(f"no prediction metadata at {path}")
    return rows[0].asDict()


def load_predictions(
    spark: SparkSession, root: str, model: str, split: str, verify_signature: str | None = None,
    verify_fingerprint: str | None = None, require_y_true: bool = False,
    canonical_fingerprint: str = CANONICAL_FINGERPRINT,
) -> DataFrame:
    """Predictions of one model and split; only that folder is read."""
    meta = load_metadata(spark, root, model, split)
    if verify_signature is not None and meta["split_signature"] != verify_signature:
        raise AssertionError(f"split signature mismatch: expected={verify_signature} got={meta['split_signature']}")
    if verify_fingerprint is not None and meta["classes_fp"] != verify_fingerprint:
        raise AssertionError(f"classes fingerprint mismatch: expected={verify_fingerprint} got={meta['classes_fp']}")
    if meta["classes_fp"] != canonical_fingerprint:
        raise AssertionError(f"classes are not canonical: fp={meta['classes_fp']}")
    if require_y_true and not meta["has_y_true"]:
        raise AssertionError("y_true required but not exported")
    schema = "idx long, probs array<float>" + (", y_true long" if meta["has_y_true"] else "")
    path = meta["data_path"]
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no predictions at {path}") from missing
