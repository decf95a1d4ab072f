"""Image files matched to products by the ids in their names."""

from __future__ import annotations

import struct
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import require_columns
from ..session import persist_to_table

_NAME = r"image_(\d+)_product_(\d+)\.[A-Za-z]+$"
FOLDERS = 256  # that written images are spread over
LISTED = 1 << 14  # files other than plain bitmaps that the driver names to the library's reader at once
BATCH_FILES, BATCH_BYTES = 1 << 10, 1 << 24  # of a batch of read files
IMAGE = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def scan_images(spark: SparkSession, root: str, decode: bool = True) -> DataFrame:
    """(imageid, productid, path, image) of every image file in a folder, or in the folders that :func:`write_images` made
    in it: then tasks list and read them, and the driver holds no names. Files that are no images are left out."""
    folders = _image_folders(spark, root)
    if not folders:
        files = _read_images(spark, [root], decode)
    else:
        tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
        listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(tasks)
        files = listed.mapInArrow(_folder_reader(root), "path string, image binary")
        if decode:
            files = persist_to_table(files.select("path", _bitmap_image("path", "image").alias("image")), "scanned-images")
            plain = F.col("image").isNotNull()
            parts, others = [files.filter(plain).select("path", "image")], files.filter(~plain).select("path").toLocalIterator()
            while some := [r["path"] for r in islice(others, LISTED)]:
                parts.append(persist_to_table(_read_images(spark, some, decode), "other-images"))
            files = reduce(DataFrame.unionByName, parts)
    return files.select(
        F.regexp_extract("path", _NAME, 1).try_cast("long").alias("imageid"),
        F.regexp_extract("path", _NAME, 2).try_cast("long").alias("productid"),
        "path",
        "image",
    )


def _read_images(spark: SparkSession, paths: list[str], decode: bool) -> DataFrame:
    if decode:
        files = spark.read.format("image").option("dropInvalid", True).load(paths)
        return files.select(F.col("image.origin").alias("path"), "image")
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("image"))


def _image_folders(spark: SparkSession, root: str) -> list[str]:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/images_[0-9][0-9][0-9]")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(f.getPath().toString() for f in found if f.isDirectory())


def _folder_reader(root: str):
    """Batches of folders of ``root`` -> batches of their files (path, content)."""

    def run(batches):
        files, top = FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                paths, contents, size = [], [], 0
                for info in files.get_file_info(FileSelector(f"{top}/{folder.rsplit('/', 1)[1]}")):
                    if not info.is_file:
                        continue
                    with files.open_input_stream(info.path) as stream:
                        contents.append(stream.read())
                    paths.append(f"{folder}/{info.base_name}")
                    size += len(contents[-1])
                    if len(paths) == BATCH_FILES or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({"path": paths, "image": pa.array(contents, pa.binary())})
                        paths, contents, size = [], [], 0
                if paths:
                    yield pa.RecordBatch.from_pydict({"path": paths, "image": pa.array(contents, pa.binary())})

    return run


def _plain_bitmap(raw: bytes) -> np.ndarray | None:
    """(height, width, 3) blue, green and red of an uncompressed bitmap of three bytes a pixel; None for any other file."""
    if len(raw) < 54 or raw[:2] != b"BM":
        return None
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    step = (3 * width + 3) // 4 * 4
    if head < 40 or bits != 24 or packed or width < 1 or not height or start < 14 + head or len(raw) < start + step * abs(height):
        return None
    rows = np.frombuffer(raw, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : 3 * width]
    return (rows[::-1] if height > 0 else rows).reshape(abs(height), width, 3)


def _bitmap_image(path: str, content: str) -> Column:
    """The image of a file's content as Spark's image source gives it; null for other files than plain bitmaps."""

    @F.arrow_udf(IMAGE)
    def images(paths: pa.Array, contents: pa.Array) -> pa.Array:
        found = [_plain_bitmap(c.as_py()) for c in contents]
        rows = [
            None if x is None else {"origin": p, "height": x.shape[0], "width": x.shape[1], "nChannels": 3, "mode": 16, "data": x.tobytes()}
            for p, x in zip(paths.to_pylist(), found, strict=True)
        ]
        of = {"origin": pa.string(), "height": pa.int32(), "width": pa.int32(), "nChannels": pa.int32(), "mode": pa.int32(), "data": pa.binary()}
        return pa.array(rows, pa.struct(list(of.items())))

    return images(F.col(path), F.col(content))


def load_product_images(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products with their image; a product without a file fails the query."""
    require_columns(products, ["imageid", "productid"])
    joined = products.join(images, ["imageid", "productid"], "left")
    message = F.concat(F.lit("no image for product "), F.col("productid").cast("string"))
    checked = F.when(F.col("path").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("path"))
    return joined.withColumn("path", checked)


def missing_images(products: DataFrame, images: DataFrame) -> DataFrame:
    return products.join(images.select("imageid", "productid"), ["imageid", "productid"], "left_anti")


PIXEL_ARRAY = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("row", "col", "r", "g", "b")]))


@F.arrow_udf(PIXEL_ARRAY)
def _decoded(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
    """Pixels of images given as rows of bytes in the order blue, green, red (and more), or one shade."""
    heights, widths, sizes = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (height, width, channels))
    parts, ends = [], [0]
    for h, w, n, raw in zip(heights, widths, sizes, data, strict=True):
        cells = np.frombuffer(raw.as_buffer(), np.uint8)[: h * w * n].reshape(h * w, n)
        at = np.arange(h * w)
        blue, green, red = (cells[:, min(k, n - 1)] for k in range(3))
        parts.append(np.stack([at // w, at % w, red, green, blue]).astype(np.int32))
        ends.append(ends[-1] + h * w)
    cells = np.concatenate(parts, axis=1) if parts else np.empty((5, 0), np.int32)
    pixels = pa.StructArray.from_arrays([pa.array(c) for c in cells], names=["row", "col", "r", "g", "b"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pixels)


def image_pixels(images: DataFrame, key: str = "productid") -> DataFrame:
    """Decoded images (BGR bytes) as a pixel table; a row without image has no pixels."""
    found = images.filter(F.col("image").isNotNull()).select(F.col(key).alias("image_id"), "image")
    return found.select("image_id", F.inline(_decoded(*[F.col(f"image.{c}") for c in ("height", "width", "nChannels", "data")])))


def bitmap(pixels: np.ndarray) -> bytes:
    """Uncompressed bitmap file of a (height, width, 3) array of red, green and blue."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)  # rows from the bottom up, of a multiple of four bytes
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _pixel_runs(batches):
    """The pixels of an image in a batch as one row: rows and columns in four bytes each, then shades in one."""
    for batch in batches:
        ids = [batch.column(c) for c in ("imageid", "productid")]
        keys = [x for c in ids for x in (c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False))]
        order = np.lexsort(keys)
        change = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        begins = np.flatnonzero(np.append(True, change)) if len(order) else np.empty(0, np.int64)
        places = [batch.column(c).to_numpy(zero_copy_only=False)[order].astype("<i4") for c in ("row", "col")]
        shades = [batch.column(c).fill_null(0).to_numpy()[order].astype(np.uint8) for c in ("r", "g", "b")]
        ends = [*begins[1:].tolist(), len(order)]
        cells = [b"".join(x[i:j].tobytes() for x in (*places, *shades)) for i, j in zip(begins.tolist(), ends, strict=False)]
        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(order[begins])) for c in ids], pa.array(cells, pa.binary())], names=["imageid", "productid", "cells"])


def _whole_image(runs: list[bytes]) -> np.ndarray:
    """(height, width, 3) of the pixels of some runs; of equal places the brightest red, then green, then blue counts."""
    parts = []
    for run in runs:
        n, raw = len(run) // 11, np.frombuffer(run, np.uint8)
        parts.append(np.concatenate([raw[: 8 * n].view("<i4").reshape(2, n), raw[8 * n :].reshape(3, n).astype(np.int32)]))
    cells = np.concatenate(parts, axis=1)
    height, width = cells[:2].max(axis=1) + 1
    place = cells[0].astype(np.int64) * width + cells[1]
    if np.bincount(place).max() > 1:
        cells = cells[:, np.lexsort(cells[4:1:-1])]
    whole = np.zeros((height, width, 3), np.uint8)
    whole[cells[0], cells[1]] = cells[2:].T
    return whole


def write_images(pixels: DataFrame, folder: str) -> int:
    """Write a bitmap ``image_<imageid>_product_<productid>.bmp`` for each image of a pixel table (imageid, productid, row,
    col, r, g, b) into a folder all executors reach; the number of files.

    Executors write the files, through the file system that the folder's address names, into ``FOLDERS`` folders by a
    hash of the ids; a task that is run again writes the same files again. An image is held whole by one task, and pixels
    it lacks are black. What is shuffled is a row per image and batch.
    """
    ids = [F.col(c).cast("long").alias(c) for c in ("imageid", "productid")]
    runs = pixels.select(*ids, "row", "col", "r", "g", "b").mapInArrow(_pixel_runs, "imageid long, productid long, cells binary")
    place = F.pmod(F.xxhash64("imageid", "productid"), F.lit(FOLDERS)).alias("place")
    images = runs.groupBy("imageid", "productid").agg(F.collect_list("cells").alias("cells")).select("*", place)

    def run(batches):
        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for r in batch.to_pylist():
                inner = f"{root}/images_{r['place']:03d}"
                if inner not in made:
                    files.create_dir(inner, recursive=True)
                    made.add(inner)
                with files.open_output_stream(f"{inner}/image_{r['imageid']}_product_{r['productid']}.bmp") as out:
                    out.write(bitmap(_whole_image(r["cells"])))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return images.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
