"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are rotated by seeded random rotations; the signs are their codes. Bands of sign bits bring similar vectors
together in several tables; how many bits and tables follows from the number of vectors and the wanted recall at the
threshold. Inside a bucket the code of one vector and the rotated other one give an unbiased estimate of their inner
product, by the stored correction factor; only pairs whose upper confidence bound reaches the threshold are recomputed
exactly, in double precision. Equal vectors are handled once, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

THRESHOLD = 0.9
RECALL = 0.98
BUCKET = 256
SEGMENT = 1024
ROTATIONS = 2
#: Standard deviations of the estimate that a pair may lie below the threshold and still be recomputed.
CONFIDENCE = 4.5


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits per table, tables) for ``n`` vectors: about ``BUCKET`` to twice as many a bucket, a pair at the threshold
    shares a bucket with probability ``recall`` at least."""
    bits = max(0, int(math.log2(max(1, n) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def rotations(dims: int, n: int, seed: int = 11) -> np.ndarray:
    """``n`` random rotations of ``dims`` dimensions, stacked."""
    rng = np.random.default_rng([seed, dims])
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) if out else np.empty((0, dims))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and safe for very large or small components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each row in each table."""
    if bits == 0:
        return np.zeros((len(x), tables), np.int32)
    need = bits * tables
    signs = x @ rotations(x.shape[1], -(-need // x.shape[1]), seed=12)[:need].T >= 0
    return (signs.reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.int32)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of unit vectors with inner product of at least ``threshold``, found through codes and bounds."""
    dims = x.shape[1]
    if dims < 2:
        estimate, margin = x @ y.T, np.zeros((len(x), 1))
    else:
        r = rotations(dims, ROTATIONS).astype(np.float32)
        turned = x.astype(np.float32) @ r.T
        code = np.where(turned >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dims))
        factor = (code * turned).reshape(len(x), ROTATIONS, dims).sum(2)
        estimate = ((code.reshape(len(x), ROTATIONS, dims) / factor[:, :, None]).reshape(len(x), -1) @ (y.astype(np.float32) @ r.T).T) / ROTATIONS
        spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(dims - 1)
        margin = CONFIDENCE * np.sqrt((spread**2).sum(1, keepdims=True)) / ROTATIONS + 1e-4
    a, b = np.nonzero(estimate + margin >= threshold)
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], y[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.empty(0)])
    keep = exact >= threshold
    return a[keep], b[keep]


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of ``n`` rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cell(threshold: float):
    """Links within one cell: each vector's linked weight and the smallest vector it is connected to here."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids = table.column("rep").to_numpy()
        low, high, seg = (table.column(c).to_numpy() for c in ("low", "high", "seg"))
        weight = table.column("n").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, seg, weight = ids[order], seg[order], weight[order]
        x = unit(np.stack(table.column("embedding").to_numpy())[order].astype(np.float64))
        keys = np.stack(table.column("keys").to_numpy())[order]
        t = int(table.column("t")[0].as_py())
        left = np.flatnonzero(seg == low[0])
        right = np.flatnonzero(seg == high[0])
        a, b = linked(x[left], x[right], threshold)
        a, b = left[a], right[b]
        # each pair once, and only in the first table that brings it together
        once = a < b if low[0] == high[0] else a != b
        once &= ~(keys[a, :t] == keys[b, :t]).any(1) if t else True
        a, b = a[once], b[once]
        total = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        root = _local_roots(n, a, b)
        hit = np.flatnonzero(total)
        return pa.table({"rep": ids[hit], "w": total[hit].astype(np.int64), "root": ids[root[hit]]})

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components, and vectors without id, link with nothing, nor
    do vectors of different length. Repeated rows count as vectors of their own. Buckets over ``SEGMENT`` rows are
    compared in blocks of segments, so none is cut. Empty input gives an empty result.
    """
    vec = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(vec) > 0)
    good &= F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding"))
    groups = rows.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    groups = written(groups, "vector-groups")
    bits, tables = plan(groups.count(), threshold, recall)

    def keyed(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(at))
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                keys = band_keys(unit(flat), bits, tables)
                lists_of_keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), dims), pa.int32()), lists_of_keys], names=[*part.schema.names, "dims", "keys"])

    coded = groups.select("rep", "n", "embedding").mapInArrow(keyed, "rep long, n long, embedding array<double>, dims int, keys array<int>")
    coded = written(coded, "vector-codes")
    placed = coded.select("rep", "dims", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("dims", "t", "key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = placed.join(sizes, ["dims", "t", "key"])
    parts = F.ceil(F.col("m") / SEGMENT).cast("int")
    placed = placed.withColumn("parts", parts).withColumn("seg", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("rep", "dims", "t", "key", "seg", F.least("seg", "other").alias("low"), F.greatest("seg", "other").alias("high"))
    cells = placed.join(coded.select("rep", "n", "embedding", "keys"), "rep")
    found = cells.groupBy("dims", "t", "key", "low", "high").applyInArrow(_cell(threshold), "rep long, w long, root long")
    found = written(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("w").alias("w"))
    comp = components(found.selectExpr("rep AS a", "root AS b"), "vector-components")
    by_rep = groups.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    out = rows.select("vec_id", "good", "h1", "h2").join(by_rep, ["h1", "h2"], "left")
    component = F.when(F.col("good"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("good"), F.col("n") - 1 + F.coalesce("w", F.lit(0))).otherwise(F.lit(0))
    return out.select(
        "vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
