"""Longest-processing-time scheduling of groups of rows onto shards.

Groups that must stay together are sorted by size and each goes to the least loaded shard, found through a heap. The
heap sees a bounded number of jobs at every input size: each group that holds at least ``1 / HEAVY`` of all bytes is a
job of its own (there are at most ``HEAVY``), the many small groups are first gathered by hash into ``BUNDLES`` jobs.
Only (job, size) pairs reach the driver; rows learn their shard from a table of at most ``HEAVY + BUNDLES`` rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import local_rows
from .common import written

HEAVY = 32_768
BUNDLES = 16_384
OVERHEAD = 16


def schedule(jobs: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Job -> shard for (job, size) pairs: largest first, each to the least loaded shard; ties go to smaller numbers."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, job in sorted(((size, job) for job, size in jobs), key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[job] = shard
    return placed


def lpt_shards(df: DataFrame, key: Column, size: Column, shards: int) -> DataFrame:
    """``df`` with ``_shard`` and ``_slot``: rows of one key in one shard, shard sizes near equal, slots gapless from 0.

    ``key`` is any value (null is a key like others), ``size`` a non-negative long (null counts as 0). Slots number the
    rows of a shard by part and then by all columns; a part is a job, or a share of one where a job has many rows, so no
    task numbers more than about ``1 / BUNDLES`` of all rows. Equal rows get different slots in any order. Empty input
    gives an empty result. Columns must be orderable (no maps).
    """
    name = F.coalesce(F.sha2(key.cast("binary"), 256), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), name.alias("_key"), F.coalesce(size, F.lit(0)).alias("_size"))
    rows = written(rows, "lpt-rows")
    groups = written(rows.groupBy("_key").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")), "lpt-groups")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    total, n_rows = int(total or 0), int(n_rows or 0)
    heavy = F.col("bytes") * HEAVY >= F.lit(max(1, total))
    bundle = F.pmod(F.xxhash64("_key"), F.lit(BUNDLES)).cast("int")
    # jobs: 0..BUNDLES-1 are bundles, heavy groups follow in the order of their keys
    large = groups.filter(heavy).orderBy("_key").collect()
    bundles = groups.filter(~heavy).groupBy(bundle.alias("job")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    jobs = {BUNDLES + i: (int(g["bytes"]), int(g["rows"])) for i, g in enumerate(large)}
    jobs |= {int(b["job"]): (int(b["bytes"]), int(b["rows"])) for b in bundles}
    placed = schedule([(job, size) for job, (size, _) in jobs.items()], shards)
    spark = df.sparkSession
    most = max(1, n_rows // BUNDLES)
    plan = local_rows(spark, [(j, s, max(1, jobs[j][1] // most)) for j, s in sorted(placed.items())], "job int, _shard int, _parts int")
    names = local_rows(spark, [(g["_key"], BUNDLES + i) for i, g in enumerate(large)], "_key string, _own int")
    placed_rows = (
        rows.join(F.broadcast(names), "_key", "left")
        .withColumn("job", F.coalesce("_own", bundle))
        .join(F.broadcast(plan), "job")
        .withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(7)), F.col("_parts")))
    )
    counts = placed_rows.groupBy("_shard", "job", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_shard").orderBy("job", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("job", "_part").orderBy("_row"))
    numbered = placed_rows.withColumn("_at", at).join(F.broadcast(counts), ["_shard", "job", "_part"])
    return numbered.select("_row.*", "_shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("_slot"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: shard by bytes, copies of a text together.

    A document's size is its UTF-8 bytes plus 16; null texts count 16, have checksum 0 and form one group of their own.
    """
    text = F.col("text")
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("_text"),
    )
    placed = lpt_shards(narrow, F.col("_text"), F.col("size"), shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
