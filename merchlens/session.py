"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

_scopes: list[list[str]] = []
_ARROW_TYPES = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
    T.BooleanType: pa.bool_(),
}


def build_session(app: str = "merchlens", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    if "spark__checkpoint__dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="merchlens-"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a bare local session) a fresh local
    folder is made and recorded in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="merchlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, not yet existing path below the shared folder."""
    path = os.path.join(shared_folder(spark), "merchlens", f"{name}-{uuid.uuid4().hex[:12]}")
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system holds it; a missing one is no error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch files named within the scope are deleted at its end; use their rows before."""
    outer, _scopes[:] = _scopes[:], [*_scopes, []]
    try:
        yield
    finally:
        for path in _scopes[-1]:
            remove_path(spark, path)
        _scopes[:] = outer


def local_rows(spark: SparkSession, rows, schema):
    """A small table from driver-side rows, planned as local data (no Python workers, no job)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = {
        f.name: pa.array([row[i] for row in rows], _ARROW_TYPES[type(f.dataType)]) for i, f in enumerate(schema.fields)
    }
    return spark.createDataFrame(pa.table(columns), schema=schema)


def use_all_cores(df):
    """Spread a scan that has fewer partitions than a local session has cores.

    On a cluster the scan's own splits stand: a round-robin shuffle of all texts costs more than idle cores.
    """
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local["):
        return df
    cores = context.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df, rows: int):
    """At least one partition for each core and for ``rows`` rows, whatever splits the scan has.

    For tables of few bytes a row that much is made from: their scans give all rows to a few tasks.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def run_all(jobs: list, parallelism: int = 1) -> list:
    """Run independent jobs in order, or a few at a time on the same cluster."""
    if parallelism <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda job: job(), jobs))


def persist_to_table(df, name: str, **options: str):
    """Cut the lineage by writing to the shared folder (with options of the writer) and reading back.

    Used where several jobs read the same derived rows. The files outlive any
    lost executor, which cached blocks do not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
