"""Linear classifiers of all classes at once, fitted by passes over packed rows.

The rows are packed once into blocks of compressed vectors in the shared folder. A pass broadcasts the weights, which
``features`` x ``classes`` bound, and returns sums of that size: partial sums of the tasks are added up in slices, through
an intermediate level where there are many tasks. One pass serves all classes, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proba import argmax
from ..session import persist_to_table

BLOCK_VALUES = 1 << 18
SLICE = 1 << 14
FEW = 8
FAN_IN = 64
MOST_CELLS = 1 << 27  # 1 GB of weights


def vector_parts(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each row ends, columns, values) of unwrapped sparse or dense vectors."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    _, _, index, value = rows.flatten()
    size = pc.fill_null(pc.list_value_length(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)  # a dense vector's columns are its places
    if index.null_count < len(index):
        sparse = np.repeat(pc.is_valid(index).to_numpy(zero_copy_only=False), size)
        at[sparse] = index.flatten().to_numpy(zero_copy_only=False)
    return ends, at, value.flatten().to_numpy(zero_copy_only=False)


@dataclass
class Block:
    """Rows of a matrix: labels, and row and column of every value, in the order of the rows."""

    label: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        """X w, where a last row of w beyond the columns is a constant term."""
        out = np.zeros((len(self.label), w.shape[1]))
        if len(self.row):
            begins = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
            full = self.row[begins]
            for k, mine in enumerate(np.ascontiguousarray(w.T)):
                out[full, k] = np.add.reduceat(self.value * mine.take(self.column), begins)
        return out + w[self.width] if len(w) > self.width else out

    def transposed_times(self, r: np.ndarray, constant: bool) -> np.ndarray:
        """X' r, with the sums of r below if ``constant``."""
        out = np.empty((self.width + constant, r.shape[1]))
        column = self.column.astype(np.intp)
        for k, mine in enumerate(np.ascontiguousarray(r.T)):
            out[: self.width, k] = np.bincount(column, self.value * mine.take(self.row), self.width)
        if constant:
            out[self.width] = r.sum(0)
        return out


def _pack(batches):
    for batch in batches:
        ends, column, value = vector_parts(batch.column("features"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        low = 0
        while low < len(label):
            begin = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK_VALUES, "right")))
            stop = ends[high - 1]
            yield pa.RecordBatch.from_pydict(
                {
                    "label": [label[low:high].astype(np.float64).tobytes()],
                    "ends": [(ends[low:high] - begin).tobytes()],
                    "columns": [column[begin:stop].astype(np.int32).tobytes()],
                    "data": [value[begin:stop].astype(np.float64).tobytes()],
                }
            )
            low = high


def total(table: DataFrame, part: Callable[..., np.ndarray], shape: tuple[int, ...], *arrays, tasks: int) -> np.ndarray:
    """Sum of ``part(row, *arrays)``, an array of ``shape``, over the rows (as dicts) of a table of blocks.

    The ``tasks`` that read the table send their sums in slices. Those of up to ``FEW`` tasks are added up on the driver,
    else each slice by a task, with a level of ``FAN_IN`` in between where there are more tasks.
    """
    shared = table.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                mine = part(row, *shared.value)
                total = mine if total is None else np.add(total, mine, out=total)
        if total is not None:
            flat = total.ravel()
            at = range(0, len(flat), SLICE)
            yield pa.RecordBatch.from_pydict({"at": list(at), "total": [flat[i : i + SLICE].tobytes() for i in at]})

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros(len(group["total"][0].as_py()) // 8)
        for chunk in group["total"].to_pylist():
            sums += np.frombuffer(chunk)
        return pa.table({"at": group["at"][:1], "total": [sums.tobytes()]})

    schema = "at long, total binary"
    parts = table.mapInArrow(run, schema)
    if tasks > FAN_IN:
        salted = parts.withColumn("salt", F.spark_partition_id() % FAN_IN)
        parts = salted.groupBy("at", "salt").applyInArrow(lambda g: add(g.select(["at", "total"])), schema)
    if tasks > FEW:
        parts = parts.groupBy("at").applyInArrow(add, schema)
    out = np.zeros(shape)
    for r in parts.collect():
        out.ravel()[r["at"] : r["at"] + SLICE] += np.frombuffer(bytes(r["total"]))
    shared.destroy()
    return out


@dataclass
class PackedRows:
    """A training table in blocks, with its number of columns, classes, and rows of each class."""

    table: DataFrame
    width: int
    counts: np.ndarray
    tasks: int

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    @classmethod
    def pack(cls, df: DataFrame, features: str, label: str, n_classes: int) -> "PackedRows":
        """Rows with a null vector or label, or a label that is no class, are an error."""
        rows = df.select(F.unwrap_udt(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
        sized = F.coalesce("features.size", F.size("features.values"))
        stored = F.sum(F.size("features.values")).alias("stored")
        facts = rows.groupBy("label").agg(F.max(sized).alias("width"), F.min(sized).alias("least"), F.count("*").alias("n"), F.count("features").alias("full"), stored).collect()
        if any(r["label"] not in range(n_classes) or r["full"] < r["n"] or r["width"] != r["least"] for r in facts):
            raise ValueError("labels are 0 to the number of classes - 1, and vectors have one size")
        if len({r["width"] for r in facts}) != 1:
            raise ValueError("no rows" if not facts else "vectors have one size")
        width = facts[0]["width"]
        if width * n_classes > MOST_CELLS:
            raise ValueError(f"{width} columns x {n_classes} classes exceed {MOST_CELLS} weights")
        counts = np.zeros(n_classes, np.int64)
        for r in facts:
            counts[int(r["label"])] = r["n"]
        # a task for each full block, and no more than the rows come in
        rows = rows.coalesce(max(1, -(-sum(r["stored"] for r in facts) // BLOCK_VALUES)))
        table = persist_to_table(rows.mapInArrow(_pack, "label binary, ends binary, columns binary, data binary"), "packed-rows")
        return cls(table, width, counts, table.rdd.getNumPartitions())

    def total(self, part: Callable[..., np.ndarray], shape: tuple[int, int], *arrays: np.ndarray) -> np.ndarray:
        """Sum over all blocks of ``part(block, *arrays)``, an array of ``shape``."""
        width = self.width

        def block(row: dict) -> Block:
            ends = np.frombuffer(row["ends"], np.int64)
            at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            return Block(np.frombuffer(row["label"]), at, np.frombuffer(row["columns"], np.int32), np.frombuffer(row["data"]), width)

        return total(self.table, lambda row, *shared: part(block(row), *shared), shape, *arrays, tasks=self.tasks)


class ClassWeights(NamedTuple):
    coefficients: DenseVector
    intercept: float


@dataclass
class LinearModel:
    """One weight vector and intercept per class; ``history`` has what each step of the fit reached."""

    weights: np.ndarray
    intercepts: np.ndarray
    features: str = "features"
    history: list[dict] = field(default_factory=list)

    @property
    def models(self) -> list[ClassWeights]:
        """The weights class by class."""
        return [ClassWeights(DenseVector(w), float(b)) for w, b in zip(self.weights.T, self.intercepts, strict=True)]

    def margin(self, features: Column) -> Column:
        """Decision values of all classes: a dot product per row, without a shuffle."""
        context = SparkContext.getOrCreate()  # experiments run in threads, which have no active session
        shared = context.broadcast((self.weights, self.intercepts))

        @F.arrow_udf("array<double>")
        def margins(rows: pa.Array) -> pa.Array:
            w, b = shared.value
            ends, column, value = vector_parts(rows)
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            z = Block(ends, row, column, value, len(w)).times(w) + b
            offsets = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))

        return margins(F.unwrap_udt(features))

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        return df.withColumn(out, self.margin(F.col(self.features)))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.margins(df).withColumn("prediction", argmax(F.col("margins")).cast("double"))


# Fits of several strengths go together: the columns of their weights are ordered by class, then by fit.


def _targets(block: Block, columns: int, fits: int) -> np.ndarray:
    """-1 and +1 for each row and column of the weights."""
    return np.where(block.label[:, None] == np.arange(columns) // fits, 1.0, -1.0)


def _hinge_part(block: Block, w: np.ndarray, fits: int) -> np.ndarray:
    """Sums below the gradient: half gradient of the squared hinge losses, and the losses as last row."""
    y, z = _targets(block, w.shape[1], fits), block.times(w)
    short = np.maximum(1.0 - y * z, 0.0)
    return np.vstack([block.transposed_times(-y * short, True), (short**2).sum(0)])


def _curvature_part(block: Block, both: np.ndarray, fits: int) -> np.ndarray:
    """X' D X v for v in the right half; D marks the rows within the margin of the weights in the left half."""
    columns = both.shape[1] // 2
    z = block.times(both)
    inside = _targets(block, columns, fits) * z[:, :columns] < 1.0
    return block.transposed_times(np.where(inside, z[:, columns:], 0.0), True)


def _log_shares(z: np.ndarray, fits: int) -> np.ndarray:
    """Log probabilities by row, class and fit."""
    z = z.reshape(len(z), -1, fits)
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax_part(block: Block, w: np.ndarray, fits: int) -> np.ndarray:
    """Gradient of the log losses, and the losses of each fit (in the columns of every class) as last row."""
    shares, own = _log_shares(block.times(w), fits), block.label.astype(np.int64)
    rows = np.arange(len(own))
    loss = -shares[rows, own].sum(0)
    miss = np.exp(shares)
    miss[rows, own] -= 1.0
    return np.vstack([block.transposed_times(miss.reshape(len(own), -1), True), np.tile(loss, shares.shape[1])])


def _softmax_curvature_part(block: Block, both: np.ndarray, fits: int) -> np.ndarray:
    """Second derivative of the log losses at the weights in the left half, times v in the right half."""
    columns = both.shape[1] // 2
    z = block.times(both)
    p, u = np.exp(_log_shares(z[:, :columns], fits)), z[:, columns:].reshape(len(z), -1, fits)
    return block.transposed_times((p * (u - (p * u).sum(1, keepdims=True))).reshape(len(z), -1), True)


def _conjugate_gradients(product, target: np.ndarray, tolerance: np.ndarray, scale: np.ndarray | float = 1.0, max_iter: int = 1000):
    """Solution of ``product(x) = target`` for each column, preconditioned by ``scale``, down to a residual norm of
    ``tolerance``: (solution, passes). All columns go together; those that are done stand still."""
    x, r = np.zeros_like(target), target.copy()
    p = r / scale
    before = (r * p).sum(0)
    for passes in range(max_iter):
        going = np.linalg.norm(r, axis=0) > tolerance
        if not going.any():
            return x, passes
        hp = product(p)
        curve = (p * hp).sum(0)
        step = np.where(going & (curve > 0), before / np.where(curve > 0, curve, 1.0), 0.0)
        x += step * p
        r -= step * hp
        scaled = r / scale
        after = (r * scaled).sum(0)
        p = scaled + np.where(before > 0, after / np.where(before > 0, before, 1.0), 0.0) * p
        before = after
    raise RuntimeError(f"conjugate gradients not settled after {max_iter} passes")


def _newton(start: np.ndarray, objective, curvature, settled, scale: np.ndarray | float, max_iter: int) -> tuple[np.ndarray, list[dict]]:
    """Minimum of each column of ``objective`` (values, gradient) by Newton steps for all columns at once, and their history.

    Conjugate gradients on ``curvature(x)`` find the step, of which the longest of 1, 1/2, 1/4, … that lowers the objective
    enough is taken. A column is settled when its gradient's norm is ``settled(first norms)``. Raises if one does not settle.
    """
    x = start
    value, gradient = objective(x)
    settled_at = settled(np.linalg.norm(gradient, axis=0))
    history = []
    for _ in range(max_iter):
        norm = np.linalg.norm(gradient, axis=0)
        history.append({"objective": value.copy(), "gradient": norm, "settled_at": settled_at})
        going = norm > settled_at
        if not going.any():
            return x, history
        step, _ = _conjugate_gradients(curvature(x), np.where(going, -gradient, 0.0), np.where(going, 0.05 * norm, 0.0), scale)
        slope = (gradient * step).sum(0)
        length, open_ = np.where(going, 1.0, 0.0), going
        for _ in range(40):
            new_value, new_gradient = objective(x + length * step)
            open_ = going & (new_value > value + 1e-4 * length * slope + 1e-12 * np.abs(value))
            if not open_.any():
                break
            length = np.where(open_, length / 2, length)
        else:
            raise RuntimeError("no step lowers the objective")
        x, value, gradient = x + length * step, new_value, new_gradient
    raise RuntimeError(f"not settled after {max_iter} steps")


def _groups(rows: PackedRows, n_classes: int, fits: list) -> list[list]:
    """Fits that go together: as many as ``MOST_CELLS`` weights hold."""
    most = max(1, MOST_CELLS // ((rows.width + 1) * n_classes))
    return [fits[i : i + most] for i in range(0, len(fits), most)]


def squared_hinge_svm(
    df: DataFrame, n_classes: int, features: str = "features", label: str = "y", C: float = 1.0, tolerance: float = 1e-4, max_iter: int = 1000
) -> LinearModel:
    """One-vs-rest support vector classifier: half the squared weights, the constant's included, plus C times the sum of
    squared hinge losses.

    Newton steps for all classes at once. A class is settled when its gradient is ``tolerance`` times the first one, by the
    share of its rarer side. Raises if a class does not settle.
    """
    return squared_hinge_strengths(df, n_classes, [C], features, label, tolerance, max_iter)[0]


def squared_hinge_strengths(
    df: DataFrame, n_classes: int, strengths: list[float], features: str = "features", label: str = "y", tolerance: float = 1e-4, max_iter: int = 1000
) -> list[LinearModel]:
    """The model of :func:`squared_hinge_svm` for each strength C; a pass over the rows serves all of them."""
    rows = PackedRows.pack(df, features, label, n_classes)
    rarer = np.maximum(np.minimum(rows.counts, rows.n - rows.counts), 1) / rows.n
    models = []
    for group in _groups(rows, n_classes, list(strengths)):
        fits = len(group)
        c = np.tile(np.array(group, float), n_classes)
        shape = (rows.width + 1, n_classes * fits)

        def objective(w, c=c, shape=shape, fits=fits):
            sums = rows.total(partial(_hinge_part, fits=fits), (shape[0] + 1, shape[1]), w)
            return 0.5 * (w**2).sum(0) + c * sums[-1], w + 2 * c * sums[:-1]

        def curvature(w, c=c, shape=shape, fits=fits):
            return lambda v: v + 2 * c * rows.total(partial(_curvature_part, fits=fits), shape, np.hstack([w, v]))

        settled = lambda first, fits=fits: tolerance * np.repeat(rarer, fits) * first
        w, history = _newton(np.zeros(shape), objective, curvature, settled, 1.0, max_iter)
        for i in range(fits):
            mine = [{name: v[i::fits] for name, v in step.items()} for step in history]
            models.append(LinearModel(w[:-1, i::fits], w[-1, i::fits], features, mine))
    return models


def softmax_regression(
    df: DataFrame, n_classes: int, features: str = "features", label: str = "y", C: float = 1.0, tolerance: float = 1e-4, max_iter: int = 1000
) -> LinearModel:
    """Multinomial logistic regression: half the squared weights, the intercepts free, plus C times the sum of log losses.

    Newton steps; settled when the gradient is ``tolerance`` times the first one. Raises if it does not settle.
    """
    return softmax_fits(df, n_classes, [(C, None)], features, label, tolerance, max_iter)[0]


def softmax_fits(
    df: DataFrame, n_classes: int, fits: list[tuple[float, np.ndarray | None]], features: str = "features", label: str = "y",
    tolerance: float = 1e-4, max_iter: int = 1000,
) -> list[LinearModel]:
    """The model of :func:`softmax_regression` for each (strength C, factors of the columns or None).

    A pass over the rows serves all fits. Their weights are for the columns as they are: the factors are part of them.
    """
    rows = PackedRows.pack(df, features, label, n_classes)
    squares = rows.total(_moments_part, (rows.width, n_classes + 2), np.int64(n_classes))[:, -1]
    models = []
    for group in _groups(rows, n_classes, list(fits)):
        many = len(group)
        c = np.array([strength for strength, _ in group], float)
        factor = np.ones((rows.width + 1, 1, many))
        for i, (_, columns) in enumerate(group):
            if columns is not None:
                factor[:-1, 0, i] = columns
        shape, flat = (rows.width + 1, n_classes, many), ((rows.width + 1) * n_classes, many)
        wide = (shape[0], n_classes * many)
        penalised = np.ones(shape)
        penalised[-1] = 0.0
        penalised = penalised.reshape(flat)
        # the second derivative's diagonal where all classes are as likely
        even = np.append(squares, rows.n)[:, None, None] * factor**2 * c * (n_classes - 1) / n_classes**2
        scale = np.maximum(penalised + np.broadcast_to(even, shape).reshape(flat), 1e-12)

        def spread(x, factor=factor, shape=shape, wide=wide):
            return (x.reshape(shape) * factor).reshape(wide)

        def gathered(x, factor=factor, shape=shape, flat=flat):
            return (x.reshape(shape) * factor).reshape(flat)

        def objective(x, c=c, many=many, wide=wide, penalised=penalised, spread=spread, gathered=gathered):
            sums = rows.total(partial(_softmax_part, fits=many), (wide[0] + 1, wide[1]), spread(x))
            return 0.5 * (penalised * x**2).sum(0) + c * sums[-1, :many], penalised * x + c * gathered(sums[:-1])

        def curvature(x, c=c, many=many, wide=wide, penalised=penalised, spread=spread, gathered=gathered):
            at = spread(x)

            def product(v):
                return penalised * v + c * gathered(rows.total(partial(_softmax_curvature_part, fits=many), wide, np.hstack([at, spread(v)])))

            return product

        x, history = _newton(np.zeros(flat), objective, curvature, lambda first: tolerance * first, scale, max_iter)
        w = spread(x).reshape(shape)
        for i in range(many):
            mine = [{name: v[i] for name, v in step.items()} for step in history]
            models.append(LinearModel(w[:-1, :, i], w[-1, :, i], features, mine))
    return models


def _moments_part(block: Block, classes: int) -> np.ndarray:
    """X' y for the +1 sides of all classes, and column sums and sums of squares."""
    positive = (block.label[:, None] == np.arange(classes)).astype(float)
    ones = block.transposed_times(np.ones((len(block.label), 1)), False)
    squares = np.bincount(block.column, block.value**2, block.width)[:, None]
    return np.hstack([block.transposed_times(positive, False), ones, squares])


def _normal_part(block: Block, v: np.ndarray) -> np.ndarray:
    return block.transposed_times(block.times(v), False)


def ridge(
    df: DataFrame, n_classes: int, features: str = "features", label: str = "y", alpha: float = 1.0, tolerance: float = 1e-8, max_iter: int = 1000
) -> LinearModel:
    """Least squares on -1/+1 targets with penalty ``alpha`` on the weights, the intercepts free.

    The normal equations of the centred columns are solved for all classes by conjugate gradients, scaled by their
    diagonal, to a residual of ``tolerance`` times the right side; a step is one pass for any number of classes.
    """
    rows = PackedRows.pack(df, features, label, n_classes)
    n, width = rows.n, rows.width
    sums = rows.total(_moments_part, (width, n_classes + 2), np.int64(n_classes))
    mean, share = sums[:, [n_classes]] / n, 2.0 * rows.counts / n - 1.0
    target = 2.0 * sums[:, :n_classes] - sums[:, [n_classes]] - n * mean * share
    diagonal = sums[:, [n_classes + 1]] - n * mean**2 + alpha

    def product(v):
        return rows.total(_normal_part, v.shape, v) - n * mean * (mean.T @ v) + alpha * v

    w, passes = _conjugate_gradients(product, target, tolerance * np.linalg.norm(target, axis=0), diagonal, max_iter)
    return LinearModel(w, share - (mean.T @ w)[0], features, [{"passes": passes}])


def save_linear(model: LinearModel, path: str) -> None:
    """Weights as rows (class_idx, intercept, weights) of a Parquet table; one file a class."""
    rows = [(k, float(b), w.tolist(), model.features) for k, (w, b) in enumerate(zip(model.weights.T, model.intercepts, strict=True))]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "class_idx int, intercept double, weights array<double>, features string")
    table.write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.parquet(path).orderBy("class_idx").collect()
    if [r["class_idx"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"{path} has no weights of classes 0, 1, …")
    return LinearModel(np.array([r["weights"] for r in rows]).T, np.array([r["intercept"] for r in rows]), rows[0]["features"])
