"""Pixel statistics, visual words, projections, image feature union."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import gray
from ..functions.proba import argmax, array_sum
from ..operators import image_kernels as K
from ..operators import pixels as P
from ..operators import visual_words as V
from ..operators.image_features import fit_image_classifier, pixel_features, union_features, vector_features, word_features
from ..operators.projections import fit_discriminant, fit_pca
from ..session import persist_to_table, scratch_path
from ..sources.images import image_pixels, load_product_images, scan_images, write_images
from .evaluation import rounded
from .registry import ORACLES, query
from .standins import PIXELS, pixels, table

# 8-bit conversions with 12-bit fixed point, as integer SQL
_S_TABLE = "CASE WHEN v = 0 THEN 0 ELSE round_even(1044480.0::DOUBLE / v, 0)::BIGINT END"
_H_TABLE = "CASE WHEN d = 0 THEN 0 ELSE round_even(122880.0::DOUBLE / d, 0)::BIGINT END"
HSV = f"""{PIXELS},
span AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM pixels),
side AS (SELECT *, floor((d * ({_S_TABLE}) + 2048) / 4096.0::DOUBLE)::INT AS s,
  CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS e FROM span),
hue AS (SELECT *, floor((e * ({_H_TABLE}) + 2048) / 4096.0::DOUBLE)::INT AS h0 FROM side),
hsv AS (SELECT image_id, row, col, r, g, b, s, v, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM hue),
classed AS (SELECT *, CASE WHEN v < 70 THEN 0 WHEN s < 40 AND v < 200 THEN 1 WHEN s < 40 THEN 2
  WHEN h >= 170 OR h < 10 THEN 3 ELSE 3 + ((h + 10) // 20) END::INT AS color_class FROM hsv)"""


@query("pixel_color_class", f"WITH {HSV} SELECT image_id, row, col, h, s, v, color_class FROM classed")
def pixel_color_class(spark: SparkSession, sf: str) -> DataFrame:
    return P.color_classes(pixels(spark, sf)).select("image_id", "row", "col", "h", "s", "v", "color_class")


_MASK = "v > 70 AND (s > 40 OR v < 200)"


@query(
    "mean_rgb",
    f"WITH {HSV} SELECT image_id, " + ", ".join(
        f"round(coalesce(avg({c}) FILTER ({_MASK}), 127), 6) AS mean_{c}" for c in "rgb"
    ) + " FROM hsv GROUP BY ALL",
)
def mean_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.mean_rgb(pixels(spark, sf)), "mean_r", "mean_g", "mean_b")


_LONG = """long AS (SELECT image_id, 'r' AS channel, r AS x FROM pixels UNION ALL SELECT image_id, 'g', g FROM pixels
UNION ALL SELECT image_id, 'b', b FROM pixels)"""


@query(
    "rgb_histogram",
    f"""WITH {PIXELS}, {_LONG}, c AS (SELECT image_id, channel, x // 16 AS bin, count(*) AS n FROM long GROUP BY ALL),
    slots AS (SELECT image_id, channel, bin FROM (SELECT DISTINCT image_id FROM pixels), (VALUES ('r'), ('g'), ('b')) t(channel),
      (SELECT unnest(range(0, 16)) AS bin))
    SELECT image_id, channel, bin, coalesce(n, 0) AS n FROM slots LEFT JOIN c USING (image_id, channel, bin)""",
    ints=["bin"],
)
def rgb_histogram(spark: SparkSession, sf: str) -> DataFrame:
    hist = P.rgb_histogram(pixels(spark, sf), 16)
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"hist_{c}").alias("h")) for c in "rgb"])
    rows = hist.select("image_id", F.inline(cells))
    return rows.select("image_id", "channel", F.posexplode("h").alias("bin", "n"))


@query(
    "histogram_contrast",
    f"""WITH {PIXELS}, {_LONG}, c AS (SELECT image_id, channel, x - 15 AS bin, count(*) AS n FROM long WHERE x >= 15 AND x < 240 GROUP BY ALL),
    slots AS (SELECT image_id, channel, bin FROM (SELECT DISTINCT image_id FROM pixels), (VALUES ('r'), ('g'), ('b')) t(channel),
      (SELECT unnest(range(0, 225)) AS bin)),
    h AS (SELECT image_id, channel, bin, coalesce(n, 0) AS n FROM slots LEFT JOIN c USING (image_id, channel, bin)),
    d AS (SELECT image_id, channel, lead(n) OVER (PARTITION BY image_id, channel ORDER BY bin) - n AS diff FROM h),
    m AS (SELECT image_id, channel, max(diff) AS peak FROM d GROUP BY ALL)
    SELECT image_id, min(peak) AS min_max_diff FROM m GROUP BY ALL""",
)
def histogram_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram_contrast(pixels(spark, sf))


@query("image_scan", f"WITH {PIXELS} SELECT image_id, row, col, r, g, b FROM pixels")
def image_scan(spark: SparkSession, sf: str) -> DataFrame:
    """An image file for each part, written, found again by the ids in its name, and decoded."""
    return image_pixels(part_images(spark, sf))


def part_images(spark: SparkSession, sf: str) -> DataFrame:
    """(productid, imageid, path, image) of the files that are written for all parts."""
    ids = (F.col("image_id").alias("productid"), (F.col("image_id") * 31 + 7).alias("imageid"))
    folder = scratch_path(spark, "images")
    write_images(pixels(spark, sf).select(*ids, "row", "col", "r", "g", "b"), folder)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id")).select(*ids)
    return load_product_images(parts, scan_images(spark, folder))


def part_image_rows(spark: SparkSession, sf: str) -> DataFrame:
    return part_images(spark, sf).select(F.col("productid").alias("image_id"), "image")


def histogram_rows(images: DataFrame, counts: Column, bins: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.slice("counts", k * bins + 1, bins).alias("h")) for k, c in enumerate("rgb")])
    rows = images.select("image_id", counts.alias("counts")).select("image_id", F.inline(cells))
    return rows.select("image_id", "channel", F.posexplode("h").alias("bin", "n"))


@query("image_histograms", ORACLES["rgb_histogram"])
def image_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return histogram_rows(part_image_rows(spark, sf), K.histograms(F.col("image"), 16), 16)


@query("image_contrast", ORACLES["histogram_contrast"])
def image_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return part_image_rows(spark, sf).select("image_id", K.contrast(F.col("image")).alias("min_max_diff"))


@query(
    "color_proportions",
    f"WITH {HSV} SELECT image_id, " + ", ".join(
        f"round(coalesce(count(*) FILTER (color_class = {c}) * 1.0::DOUBLE / nullif(count(*) FILTER (color_class >= 3), 0), 0), 6) AS p_{c}"
        for c in range(3, 12)
    ) + " FROM classed GROUP BY ALL",
)
def color_proportions(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.category_proportions(P.color_classes(pixels(spark, sf)), "image_id", "color_class", list(range(3, 12)))
    return rounded(rows, *[f"p_{c}" for c in range(3, 12)])


def _box_sql(condition: str) -> str:
    return f"""{PIXELS}, lit AS (SELECT *, (r * 9798 + g * 19235 + b * 3735 + 16384) >> 15 AS y FROM pixels),
    box AS (SELECT image_id, min(row) FILTER ({condition}) AS r0, max(row) FILTER ({condition}) AS r1,
      min(col) FILTER ({condition}) AS c0, max(col) FILTER ({condition}) AS c1 FROM lit GROUP BY ALL),
    ok AS (SELECT *, coalesce(r0 < r1 AND c0 < c1, false) AS cropped, r1 - r0 AS h, c1 - c0 AS w FROM box),
    pad AS (SELECT *, least((8 - greatest(h, w)) // 2, 10) AS p FROM ok),
    crop AS (SELECT *, greatest(h, w) + 2 * p AS side FROM pad),
    sq AS (SELECT image_id, cropped,
      CASE WHEN h < w THEN r1 + (side - h) // 2 - side WHEN w < h THEN r0 - p ELSE r0 END AS a,
      CASE WHEN h < w THEN r1 + (side - h) // 2 WHEN w < h THEN r1 + p ELSE r1 END AS b,
      CASE WHEN w < h THEN c1 + (side - w) // 2 - side WHEN h < w THEN c0 - p ELSE c0 END AS c,
      CASE WHEN w < h THEN c1 + (side - w) // 2 WHEN h < w THEN c1 + p ELSE c1 END AS d FROM crop)
    SELECT image_id, cropped, CASE WHEN cropped THEN greatest(0, a) ELSE 0 END AS r_min, CASE WHEN cropped THEN least(8, b) ELSE 8 END AS r_max,
      CASE WHEN cropped THEN greatest(0, c) ELSE 0 END AS c_min, CASE WHEN cropped THEN least(8, d) ELSE 8 END AS c_max FROM sq"""


@query("foreground_box", f"WITH {_box_sql('y <= 240')}")
def foreground_box(spark: SparkSession, sf: str) -> DataFrame:
    return P.foreground_box(pixels(spark, sf), 8)


@query("foreground_box_dark", f"WITH {_box_sql('y >= 230')}")
def foreground_box_dark(spark: SparkSession, sf: str) -> DataFrame:
    return P.foreground_box(pixels(spark, sf), 8, threshold=230, dark_background=True)


@query("image_boxes", f"WITH {_box_sql('y <= 240')}")
def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_foreground_box(part_image_rows(spark, sf), 8).select("image_id", "cropped", "box.*")


@query(
    "cropped_histograms",
    f"""WITH {PIXELS}, {_LONG.replace(" AS x", " AS x, row, col").replace("'g', g FROM", "'g', g, row, col FROM").replace("'b', b FROM", "'b', b, row, col FROM")},
    boxes AS (WITH {_box_sql('y <= 240')}),
    c AS (SELECT image_id, channel, x // 16 AS bin, count(*) AS n FROM long JOIN boxes USING (image_id)
      WHERE row >= r_min AND row < r_max AND col >= c_min AND col < c_max GROUP BY ALL),
    slots AS (SELECT image_id, channel, bin FROM (SELECT DISTINCT image_id FROM pixels), (VALUES ('r'), ('g'), ('b')) t(channel),
      (SELECT unnest(range(0, 16)) AS bin))
    SELECT image_id, channel, bin, coalesce(n, 0) AS n FROM slots LEFT JOIN c USING (image_id, channel, bin)""",
    ints=["bin"],
)
def cropped_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of the foreground only: the box is found and applied before the values are counted."""
    images = K.with_foreground_box(part_image_rows(spark, sf), 8)
    return histogram_rows(images, K.histograms(F.col("image"), 16, box=F.col("box")), 16)


@query(
    "image_brightness",
    f"""WITH {PIXELS} SELECT image_id, round(avg((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15), 6) AS mean_gray FROM pixels GROUP BY ALL""",
)
def image_brightness(spark: SparkSession, sf: str) -> DataFrame:
    level = gray(F.col("r"), F.col("g"), F.col("b"))
    return rounded(pixels(spark, sf).groupBy("image_id").agg(F.avg(level).alias("mean_gray")), "mean_gray")


# --- descriptors: embedding vectors, about 25 to an image; most parts are images without any ----------
def descriptors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("image_id"), F.col("embedding").alias("vec"), F.col("label")
    )
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id")).union(rows.select("image_id")).distinct()
    return rows, images


def label_centroids(spark: SparkSession, sf: str):
    """Mean vector of every label, a 10 x 64 matrix."""
    dims = [F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 9) for i in range(64)]
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.array(*dims).alias("c")).orderBy("label").collect()
    return [r["c"] for r in rows]


@query(
    "visual_word_histogram",
    """WITH cent AS (SELECT label AS word, list(x ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(embedding[pos + 1]::DOUBLE), 9) AS x
        FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) GROUP BY ALL) GROUP BY label),
    d AS (SELECT vec_id, vec_id // 25 AS image_id, embedding FROM embeddings),
    dist AS (SELECT vec_id, image_id, word, list_sum(list_transform(c, lambda x, i: (x - embedding[i]::DOUBLE) * (x - embedding[i]::DOUBLE))) AS q FROM d, cent),
    near AS (SELECT vec_id, image_id, arg_min(word, q) AS word FROM dist GROUP BY ALL),
    counts AS (SELECT image_id, word, count(*) AS n FROM near GROUP BY ALL),
    slots AS (SELECT image_id, word FROM (SELECT p_partkey AS image_id FROM part UNION SELECT vec_id // 25 FROM embeddings), (SELECT unnest(range(0, 10)) AS word))
    SELECT image_id, s.word AS word, round(coalesce(n / (SELECT sum(n) FROM counts k WHERE k.image_id = s.image_id), 0), 6) AS share
    FROM slots s LEFT JOIN counts USING (image_id, word)""",
    ints=["word"],
)
def visual_word_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows, images = descriptors(spark, sf)
    assigned = V.nearest_centroid(rows, label_centroids(spark, sf))
    hist = V.word_histogram(assigned, images, 10)
    return rounded(hist.select("image_id", F.posexplode("histogram").alias("word", "share")), "share")


# Words of the bag, and the most components the vectors allow
WORDS, COMPONENTS = 100, 64


@query("visual_words_kmeans")
def visual_words_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    rows, images = descriptors(spark, sf)
    hist = V.word_histogram(V.assign_words(rows, V.fit_words(rows, WORDS)), images, WORDS)
    return hist.select("image_id", F.size("histogram").alias("words"), F.round(array_sum(F.col("histogram")), 6).alias("total"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("label").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("x"),
    )


@query("pca_projection")
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    projected, _ = fit_pca(_vectors(spark, sf), "x", COMPONENTS)
    values = vector_to_array(F.col("pca"))
    return projected.select("image_id", F.size(values).alias("components"), F.round(F.abs(F.get(values, F.lit(0))), 4).alias("first_abs"))


@query("discriminant_projection")
def discriminant_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    lda = fit_discriminant(rows, "x", "y", 26)
    out = lda.transform(rows, "x")
    return out.select("image_id", "y", F.size("lda").alias("directions"), F.round(F.abs(F.get("lda", F.lit(0))), 4).alias("first_abs"))


@query(
    "pca_norms",
    """WITH cells AS (SELECT vec_id, pos, embedding[pos + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS pos)),
    stats AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY pos)
    SELECT vec_id AS image_id, round(sum(CASE WHEN s > 0 THEN ((v - m) / s) ** 2 ELSE 0 END), 4) AS squared_norm, true AS in_order
    FROM cells JOIN stats USING (pos) GROUP BY vec_id""",
)
def pca_norms(spark: SparkSession, sf: str) -> DataFrame:
    """All components turn the scaled vectors without changing their lengths; the variance falls from one to the next."""
    projected, model = fit_pca(_vectors(spark, sf), "x", COMPONENTS)
    shares = model.explainedVariance.toArray()
    in_order = bool((shares[:-1] >= shares[1:]).all())
    squares = F.transform(vector_to_array(F.col("pca")), lambda v: v * v)
    return projected.select("image_id", F.round(array_sum(squares), 4).alias("squared_norm"), F.lit(in_order).alias("in_order"))


@query(
    "discriminant_scatter",
    """WITH n AS (SELECT count(*) AS n_rows, count(DISTINCT label) AS k FROM embeddings)
    SELECT i::INT AS direction, n_rows, 1.0::DOUBLE AS within_variance FROM n, range(0, 64) r(i) WHERE i < k - 1""",
)
def discriminant_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Variance within the classes along each direction, which the projection makes one."""
    rows = _vectors(spark, sf)
    projected = fit_discriminant(rows, "x", "y", 26).transform(rows, "x")
    cells = projected.select("y", F.posexplode("lda").alias("direction", "v"))
    classes = cells.groupBy("direction", "y").agg(F.count("v").alias("n"), F.var_pop("v").alias("spread"))
    within = F.sum(F.col("n") * F.col("spread")) / (F.sum("n") - F.count("y"))
    return classes.groupBy("direction").agg(F.sum("n").alias("n_rows"), F.round(within, 6).alias("within_variance"))


@query("image_feature_classifier")
def image_feature_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """All image feature families of every part, with a balanced classifier.

    A part's vector is that of its key modulo the number of vectors, its descriptors are that vector and the next four.
    """
    stored = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    n = stored.count()
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"))
    near = ids.select("image_id", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("k", "_")).withColumn(
        "vec_id", F.pmod(F.col("image_id") + F.col("k"), F.lit(n))
    )
    desc = near.join(stored, "vec_id").select("image_id", "k", "vec", "label")
    vectors = desc.filter("k = 0").select("image_id", F.col("label").alias("y"), array_to_vector(F.col("vec").cast("array<double>")).alias("x"))
    parts = [
        pixel_features(pixels(spark, sf)),
        vector_features(vectors, "x", "y", COMPONENTS, 9),
        word_features(desc.select("image_id", "vec"), ids, WORDS),
    ]
    features = union_features(parts).join(vectors.select("image_id", F.col("y").cast("double").alias("y")), "image_id")
    rows = persist_to_table(features, "image-features")
    model = fit_image_classifier(rows, C=0.001)
    scored = model.transform(rows)
    return scored.select("image_id", F.col("y").cast("int").alias("y"), argmax(vector_to_array("probability")).alias("pred"))
