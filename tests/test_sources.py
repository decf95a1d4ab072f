"""Readers, writers, failure cases, streaming."""

import struct

import pytest
from pyspark.sql import functions as F

from merchlens.dims import CANONICAL_CLASSES, CANONICAL_FINGERPRINT
from merchlens.schemas import PRODUCT, require_columns
from merchlens.session import shared_folder
from merchlens.sources import catalog, images, predictions, results
from merchlens.streaming.scoring import accept_requests


def test_csv_keeps_quotes_newlines_and_nulls(spark, tmp_path):
    rows = [(1, 'a "b", c', "x\ny", 3, 4), (2, " lead", None, 5, 6)]
    path = str(tmp_path / "products")
    catalog.write_product_csv(spark.createDataFrame(rows, PRODUCT), path)
    assert sorted(map(tuple, catalog.read_product_csv(spark, path).collect())) == rows
    (tmp_path / "labels.csv").write_text(",prdtypecode\n1,10\n2,2280\n")
    assert [tuple(r) for r in catalog.read_label_csv(spark, str(tmp_path / "labels.csv")).collect()] == [(1, 10), (2, 2280)]


def test_columns_are_required(spark):
    with pytest.raises(KeyError):
        catalog.with_image_path(spark.range(1), "/x")
    with pytest.raises(KeyError):
        require_columns(spark.range(1), ["nope"])


def _scores(spark, n=4, width=27):
    return spark.range(n).select(
        F.col("id").alias("idx"), F.array_repeat(F.lit(1.0 / width), width).alias("probs"), F.lit(10).cast("long").alias("y_true")
    )


def test_export_round_trip_and_checks(spark, tmp_path):
    root = str(tmp_path)
    info = predictions.export_predictions(_scores(spark), root, "m", "val", "sig")
    assert info["num_samples"] == 4 and info["classes_fp"] == CANONICAL_FINGERPRINT
    loaded = predictions.load_predictions(spark, root, "m", "val", "sig", CANONICAL_FINGERPRINT, True)
    assert loaded.count() == 4 and dict(loaded.dtypes)["probs"] == "array<float>"
    with pytest.raises(AssertionError, match="signature"):
        predictions.load_predictions(spark, root, "m", "val", "other")
    with pytest.raises(AssertionError, match="fingerprint"):
        predictions.load_predictions(spark, root, "m", "val", verify_fingerprint="0" * 16)
    with pytest.raises(FileNotFoundError):
        predictions.load_predictions(spark, root, "m", "test")
    predictions.export_predictions(_scores(spark).drop("y_true"), root, "m", "test", "sig")
    with pytest.raises(AssertionError, match="y_true"):
        predictions.load_predictions(spark, root, "m", "test", require_y_true=True)


def test_bad_exports_leave_no_metadata(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(AssertionError, match="signature"):
        predictions.export_predictions(_scores(spark), root, "m", "val", "  ")
    with pytest.raises(AssertionError, match="mismatch"):
        predictions.export_predictions(_scores(spark), root, "m", "val", "s", classes=CANONICAL_CLASSES[::-1])
    with pytest.raises(AssertionError, match="bad_width"):
        predictions.export_predictions(_scores(spark, width=5), root, "m", "val", "s")
    twice = _scores(spark).unionByName(_scores(spark))
    with pytest.raises(AssertionError, match="repeated_ids"):
        predictions.export_predictions(twice, root, "m", "val", "s")
    with pytest.raises(FileNotFoundError):
        predictions.load_predictions(spark, root, "m", "val")


def test_results_and_parameters(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "experiment string, f1 double")
    path = str(tmp_path / "r")
    results.save_results(df, path, {"k": 1})
    assert results.load_results(spark, path, "experiment string, f1 double").count() == 2
    assert results.load_result_metadata(spark, path) == {"k": 1}
    params = spark.createDataFrame([("text", "a", 0.7, 1.5), ("text", "b", 0.3, None), ("image", "c", 1.0, 2.0)], "modality string, model string, weight double, temperature double")
    results.save_fusion_params(params, str(tmp_path / "p"))
    weights, temperatures = results.fusion_values(results.load_fusion_params(spark, str(tmp_path / "p")), "text")
    assert weights == {"a": 0.7, "b": 0.3} and temperatures == {"a": 1.5}


def _bmp(path, width, height, bgr):
    row = bytes(bgr) * width
    row += b"\0" * (-len(row) % 4)
    header = b"BM" + struct.pack("<IHHI", 54 + len(row) * height, 0, 0, 54)
    header += struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(row) * height, 0, 0, 0, 0)
    path.write_bytes(header + row * height)


def test_images_by_product(spark, tmp_path):
    _bmp(tmp_path / "image_7_product_1.bmp", 3, 2, (10, 20, 30))
    _bmp(tmp_path / "image_8_product_2.bmp", 2, 2, (1, 2, 3))
    found = images.scan_images(spark, str(tmp_path))
    products = spark.createDataFrame([(1, 7), (2, 8)], "productid long, imageid long")
    assert images.load_product_images(products, found).count() == 2
    pixels = images.image_pixels(images.load_product_images(products, found))
    rows = pixels.filter("image_id = 1").collect()
    assert len(rows) == 6 and {(r["r"], r["g"], r["b"]) for r in rows} == {(30, 20, 10)}
    more = products.unionByName(spark.createDataFrame([(3, 9)], "productid long, imageid long"))
    assert [r["productid"] for r in images.missing_images(more, found).collect()] == [3]
    with pytest.raises(Exception, match="no image for product 3"):
        images.load_product_images(more, found).collect()
    assert images.scan_images(spark, str(tmp_path), decode=False).count() == 2


def test_requests_are_checked(spark):
    df = spark.createDataFrame([("a", " "), (" ", "x"), (None, "x"), ("b", "y")], "designation string, description string")
    assert sorted(map(tuple, accept_requests(df).collect())) == [("a", None), ("b", "y")]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scratch_scope_deletes_what_it_named(spark):
    import os

    from merchlens.session import persist_to_table, scratch_scope

    outer = persist_to_table(spark.range(3), "kept")
    with scratch_scope(spark):
        inner = persist_to_table(spark.range(4), "dropped")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 4 and os.path.exists(path)
    assert not os.path.exists(path) and outer.count() == 3


def test_rejected_export_leaves_no_data(spark, tmp_path):
    bad = _scores(spark, width=3)
    with pytest.raises(AssertionError):
        predictions.export_predictions(bad, str(tmp_path), "m", "s", "sig", classes=CANONICAL_CLASSES)
    assert not [p for p in tmp_path.rglob("*.parquet") if p.is_file()]


def test_written_images_are_read_back(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    want = [
        (k, k + 100, row, col, *map(int, rng.integers(0, 256, 3)))
        for k, (h, w) in enumerate([(1, 1), (3, 5), (4, 2), (7, 3)])
        for row in range(h)
        for col in range(w)
    ]
    pixels = spark.createDataFrame(want, "productid long, imageid long, row int, col int, r int, g int, b int").repartition(3)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        assert images.write_images(pixels, folder) == 4
        assert images.write_images(pixels, folder) == 4  # as a task that is run again
        found = images.scan_images(spark, folder)
        got = images.image_pixels(found).join(found.select(images.F.col("productid").alias("image_id"), "imageid"), "image_id")
        assert {tuple(r) for r in got.select("image_id", "imageid", "row", "col", "r", "g", "b").collect()} == set(want)
    assert images.write_images(pixels.limit(0), str(tmp_path / "c")) == 0


def test_shades_and_missing_images_as_pixels(spark):
    schema = "productid long, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    df = spark.createDataFrame([(1, ("", 1, 2, 1, 0, bytearray([7, 9]))), (2, None), (3, ("", 1, 1, 4, 24, bytearray([1, 2, 3, 4])))], schema)
    assert sorted(map(tuple, images.image_pixels(df).collect())) == [(1, 0, 0, 7, 7, 7), (1, 0, 1, 9, 9, 9), (3, 0, 0, 3, 2, 1)]


def test_images_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    import numpy as np

    reads, read = [], images._read_images
    monkeypatch.setattr(images, "LISTED", 1)
    monkeypatch.setattr(images, "_read_images", lambda spark, paths, decode: reads.append(len(paths)) or read(spark, paths, decode))
    want = [(k, 7 * k, row, col, k % 256, row, 255 - col) for k in range(40) for row in range(2) for col in range(3)]
    schema = "productid long, imageid long, row int, col int, r int, g int, b int"
    # a place that comes twice shows the larger shades, as before; a shade that is null is black
    pixels = spark.createDataFrame([*want, (3, 21, 0, 0, 1, 9, 9), (99, 1, 0, 0, None, 2, 3)], schema).repartition(7)
    assert images.write_images(pixels, str(tmp_path / "d")) == 41
    files = sorted((tmp_path / "d").rglob("*.bmp"))
    assert len({f.parent for f in files}) > 1
    found = images.scan_images(spark, str(tmp_path / "d"))
    assert not reads and found.count() == 41
    assert {tuple(r) for r in images.image_pixels(found).collect()} == {(k, *rest) for k, _, *rest in want} | {(99, 0, 0, 0, 2, 3)}
    assert images.scan_images(spark, str(tmp_path / "d"), decode=False).count() == 41
    # the same as the library reads; one of 8 bits and a file that is no image go to the library
    plain = {r["path"].rsplit("/")[-1]: tuple(r["image"])[1:] for r in read(spark, [str(f) for f in files], True).collect()}
    assert {r["path"].rsplit("/")[-1]: tuple(r["image"])[1:] for r in found.collect()} == plain
    folder = files[0].parent
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1082, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 256, 0)
    (folder / "image_5_product_500.bmp").write_bytes(head + palette.tobytes() + bytes([77, 0, 0, 0]))
    (folder / "image_6_product_600.bmp").write_bytes(b"BM")
    more = images.image_pixels(images.scan_images(spark, str(tmp_path / "d")))
    assert [tuple(r) for r in more.filter("image_id >= 500").collect()] == [(500, 0, 0, 77, 77, 77)] and reads[-2:] == [1, 1]
