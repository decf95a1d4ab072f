"""Statistics of decoded images, image by image: no row per pixel, no shuffle.

An image is a struct of height, width, nChannels and data, as Spark's image source gives it: rows of bytes in the order
blue, green, red (and more), or one shade. A null image gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pixels import CHANNELS, crop_box, min_of_max_differences

EDGES = ("r_min", "r_max", "c_min", "c_max")


def _arrays(images: pa.StructArray) -> Iterator[np.ndarray | None]:
    """(height, width, 3) red, green and blue of each image."""
    for image in images:
        if not image.is_valid:
            yield None
            continue
        height, width, n = (image[c].as_py() for c in ("height", "width", "nChannels"))
        cells = np.frombuffer(image["data"].as_buffer(), np.uint8)[: height * width * n].reshape(height, width, n)
        yield cells[:, :, [min(k, n - 1) for k in (2, 1, 0)]]


def histograms(image: Column, bins: int = 256, lo: int = 0, hi: int = 256, box: Column | None = None) -> Column:
    """Counts of red, green and blue values in ``bins`` bins of [lo, hi), one channel after the other.

    ``box`` (r_min, r_max, c_min, c_max; ends excluded) crops the image before.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(images: pa.Array, boxes: pa.Array) -> pa.Array:
        out = []
        for cells, crop in zip(_arrays(images), boxes.to_pylist(), strict=True):
            if cells is None:
                out.append(None)
                continue
            if crop is not None:
                cells = cells[crop["r_min"] : crop["r_max"], crop["c_min"] : crop["c_max"]]
            cells = cells.reshape(-1, 3).astype(np.int64)
            row, channel = np.nonzero((cells >= lo) & (cells < hi))
            at = (cells[row, channel] - lo) * bins // (hi - lo)
            out.append(np.bincount(channel * bins + at, minlength=3 * bins))
        return pa.array(out, pa.list_(pa.int64()))

    whole = F.lit(None).cast("struct<r_min: int, r_max: int, c_min: int, c_max: int>")
    return counts(image, whole if box is None else box)


def contrast(image: Column, bins: int = 225, lo: int = 15, hi: int = 240) -> Column:
    """The smallest of the channels' largest steps between neighbouring bins."""
    return min_of_max_differences(histograms(image, bins, lo, hi), [(i * bins, (i + 1) * bins) for i in range(len(CHANNELS))])


def foreground_edges(image: Column, threshold: int = 240, dark_background: bool = False) -> Column:
    """First and last row and column with foreground (r_min, r_max, c_min, c_max); null values if there is none."""

    @F.arrow_udf(T.StructType([T.StructField(e, T.IntegerType()) for e in EDGES]))
    def edges(images: pa.Array) -> pa.Array:
        out = []
        for cells in _arrays(images):
            found = None
            if cells is not None:
                red, green, blue = np.moveaxis(cells.astype(np.int64), 2, 0)
                level = (red * 9798 + green * 19235 + blue * 3735 + 16384) >> 15
                rows, columns = np.nonzero(level >= threshold if dark_background else level <= threshold)
                ends = (rows.min(), rows.max(), columns.min(), columns.max()) if len(rows) else (None,) * 4
                found = dict(zip(EDGES, ends, strict=True))
            out.append(found)
        return pa.array(out, pa.struct([(e, pa.int32()) for e in EDGES]))

    return edges(image)


def with_foreground_box(
    images: DataFrame, size: int, threshold: int = 240, dark_background: bool = False, keep_proportion: bool = True, padding: int = 10
) -> DataFrame:
    """``images`` (image_id, image) with cropped and box, as :func:`pixels.foreground_box` finds them from pixels."""
    edges = images.select("image_id", "image", F.inline(F.array(foreground_edges(F.col("image"), threshold, dark_background))))
    boxed = crop_box(edges, size, keep_proportion, padding, ["image_id", "image"])
    return boxed.select("image_id", "image", "cropped", F.struct(*EDGES).alias("box"))
