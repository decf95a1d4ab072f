"""Removal of byte strings that occur more than once, by a column-wise multi-document suffix order.

A window is ``WINDOW`` bytes. Anchors chosen by the windows' content bring the places together where equal windows can
be; places whose whole surroundings are equal are one context with a count. The contexts of an anchor are documents of
a collection aligned at the anchor. The collection is read column by column from the right: each round inserts one
symbol per document, and updates the order of the suffixes that begin there (the collection's transform is the symbols
before them, in that order) and the common prefixes of neighbours. A window is repeated where a common prefix reaches
``WINDOW``. Columns lie in a sequential scratch file of the task, so a round holds a few values per document.

Anchors with more than ``CONTEXTS`` contexts are not gathered in one task. Their windows are counted by key instead, in
bins of neighbouring windows: a bin whose whole span occurs twice is repeated, one whose core (what all its windows
cover) occurs once is not, and only the others are divided further, down to single windows.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, blocks, byte_rows, mix, ragged, range_keys, signed, window_runs
from .common import written

WINDOW = 400
GRAM = 32
LEFT = WINDOW - GRAM
WIDTH = LEFT + WINDOW
CONTEXTS = 256
#: Windows a bin holds, from level to level.
BINS = (48, 6, 1)
COLLECTION = 2000

_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def byte_runs(data: np.ndarray, offsets: np.ndarray):
    keys = _SYMBOL[data]
    return keys, window_runs(keys, offsets, WINDOW, GRAM)


def repeated_windows(group: np.ndarray, texts: list[bytes], lead: np.ndarray) -> np.ndarray:
    """(documents x LEFT + 1) marks: whether the window that begins so many bytes left of the anchor (column LEFT is the
    anchor itself) also begins in another document of its group.

    ``lead`` is the anchor's place in each text. The documents of a group must be neighbours.
    """
    n = len(texts)
    marks = np.zeros((n, LEFT + 1), bool)
    with tempfile.TemporaryFile() as columns:
        # symbols are the bytes plus one, 0 stands outside a text; written column after column
        for low in range(0, WIDTH, 64):
            high = min(low + 64, WIDTH)
            part = np.zeros((n, high - low), np.uint16)
            for i, (text, at) in enumerate(zip(texts, lead.tolist(), strict=True)):
                a, b = max(0, low - LEFT + at), min(len(text), high - LEFT + at)
                if a < b:
                    part[i, a - at + LEFT - low : b - at + LEFT - low] = np.frombuffer(text, np.uint8, b - a, a).astype(np.uint16) + 1
            np.ascontiguousarray(part.T).tofile(columns)
        order = np.arange(n)
        fresh = np.append(True, group[1:] != group[:-1])
        common = np.zeros(n, np.int32)
        for column in range(WIDTH - 1, -1, -1):
            columns.seek(column * n * 2)
            symbol = np.fromfile(columns, np.uint16, n)[order].astype(np.int64)
            rank = np.argsort(group[order] * 257 + symbol, kind="stable")
            gap = np.append(0, _least_between(common, rank[:-1], rank[1:]))
            order, symbol = order[rank], symbol[rank]
            fresh = np.append(True, (group[order[1:]] != group[order[:-1]]) | (symbol[1:] != symbol[:-1]))
            common = np.where(fresh | (symbol == 0), 0, gap + 1).astype(np.int32)
            if column <= LEFT:
                long = common >= WINDOW
                marks[order, column] = long | np.append(long[1:], False)
    return marks


def _least_between(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of value[low + 1 .. high] where low < high, else 0."""
    out = np.zeros(len(low), value.dtype)
    near = high == low + 1
    out[near] = value[high[near]]
    far = np.flatnonzero(high > low + 1)
    if len(far):
        width = high[far] - low[far]
        level = np.frexp(width)[1] - 1
        table, span = value, 1
        for k in range(int(level.max()) + 1):
            at = far[level == k]
            if len(at):
                out[at] = np.minimum(table[low[at] + 1], table[high[at] - span + 1])
            if len(table) > span:
                table = np.minimum(table[:-span], table[span:])
            span *= 2
    return out


def _places(documents: DataFrame) -> DataFrame:
    """(rid, fp, ctx): the runs of windows of every text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("rid")
            for low, _, data, offsets in blocks(batch.column("text")):
                _, runs = byte_runs(data, offsets)
                rows = np.searchsorted(offsets, runs.begin, "right") - 1 + low
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(signed(runs.fingerprint)), pa.array(signed(runs.context))], names=["rid", "fp", "ctx"]
                )

    return documents.mapInArrow(run, "rid long, fp long, ctx long")


_LEVELS = "array<struct<bin:int,low:int,high:int,core:long,span:long>>"
CUT = f"fp long, ctx long, lead int, n_windows int, content binary, {', '.join(f'bins{w} {_LEVELS}' for w in BINS)}"


def _bins(keys: np.ndarray, runs, width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Bins of the windows of each run, by how far left of the anchor they begin: (bins per run, their columns)."""
    high = runs.anchor - runs.begin
    low = high - runs.count + 1
    n = high // width - low // width + 1
    bin_, anchor = ragged(low // width, n), np.repeat(runs.anchor, n)
    first = np.maximum(bin_ * width, np.repeat(low, n))
    last = np.minimum(bin_ * width + width - 1, np.repeat(high, n))
    core = range_keys(keys, anchor - bin_ * width, anchor + WINDOW - bin_ * width - width + 1)
    span = range_keys(keys, anchor - last, anchor + WINDOW - first)
    place = bin_.astype(U64) * U64(0xD6E8FEB86659FD93)
    extent = first.astype(U64) * U64(0xA0761D6478BD642F) + last.astype(U64)
    return n, {"bin": bin_, "low": first, "high": last, "core": signed(mix(core + place)), "span": signed(mix(span + extent))}


def _cut(batches):
    """Bytes (or, of anchors with many contexts, bins of windows) of the wanted contexts of each document."""
    for batch in batches:
        for low, high, data, offsets in blocks(batch.column("text")):
            keys, runs = byte_runs(data, offsets)
            row = np.searchsorted(offsets, runs.begin, "right") - 1
            ours = signed(runs.context)
            bounds = np.searchsorted(row, np.arange(high - low + 1))
            pick, many = np.zeros(len(row), bool), np.zeros(len(row), bool)
            for name, mask in (("few", pick), ("many", many)):
                lists = batch.column(name)
                for i in range(high - low):
                    wanted = lists[low + i].values
                    if wanted is not None and len(wanted):
                        a, b = bounds[i], bounds[i + 1]
                        mask[a:b] = np.isin(ours[a:b], wanted.to_numpy())
            pick |= many
            if not pick.any():
                continue
            at = np.flatnonzero(pick)
            runs, many = runs.pick(at), many[at]
            size = np.where(many, 0, runs.count + WINDOW - 1)
            columns = [
                pa.array(signed(runs.fingerprint)),
                pa.array(signed(runs.context)),
                pa.array(runs.anchor - runs.begin, pa.int32()),
                pa.array(runs.count, pa.int32()),
                byte_rows(data, runs.begin, size),
            ]
            for width in BINS:
                n, found = _bins(keys, runs.pick(np.flatnonzero(many)), width)
                count = np.zeros(len(many), np.int64)
                count[many] = n
                structs = pa.StructArray.from_arrays([pa.array(v, pa.int64() if k in ("core", "span") else pa.int32()) for k, v in found.items()], names=list(found))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), structs))
            yield pa.RecordBatch.from_arrays(columns, names=["fp", "ctx", "lead", "n_windows", "content", *(f"bins{w}" for w in BINS)])


def _repeated_bins(many: DataFrame) -> DataFrame:
    """(fp, ctx, ks): ranges of repeated windows (bytes left of the anchor) of the contexts of anchors with many."""
    marks, rows = None, many.select("fp", "ctx", "n", F.inline(f"bins{BINS[0]}"))
    for level, width in enumerate(BINS):
        rows = written(rows, f"suffix-bins{width}")
        spans = rows.groupBy("fp", "span").agg(F.sum("n").alias("total"), F.min("ctx").alias("first"))
        spans = written(spans, f"suffix-spans{width}")
        whole = rows.join(spans.filter("total > 1"), ["fp", "span"]).select("fp", "ctx", "low", "high")
        marks = whole if marks is None else marks.union(whole)
        if width == 1:
            break
        # equal spans go on once, with their number; what no other bin shares the core of is not repeated
        single = rows.join(spans.select("fp", "span", "total", F.col("first").alias("ctx")), ["fp", "span", "ctx"])
        cores = single.groupBy("fp", "core").agg(F.sum("total").alias("times")).filter("times > 1").select("fp", "core")
        down = single.join(cores, ["fp", "core"]).select("fp", "ctx", F.col("total").alias("n"), F.col("bin").alias("above"))
        ratio = width // BINS[level + 1]
        finer = F.filter(f"bins{BINS[level + 1]}", lambda x: F.floor(x["bin"] / ratio) == F.col("above"))
        rows = down.join(many.select("fp", "ctx", f"bins{BINS[level + 1]}"), ["fp", "ctx"]).select("fp", "ctx", "n", F.inline(finer))
    return marks.groupBy("fp", "ctx").agg(F.collect_list(F.struct("low", "high")).alias("ks"))


def _collection(table: pa.Table) -> pa.Table:
    """Repeated windows of the contexts of some anchors, as packed marks."""
    table = table.combine_chunks().sort_by([("fp", "ascending"), ("ctx", "ascending")])
    fp = table.column("fp").to_numpy()
    group = np.cumsum(np.append(True, fp[1:] != fp[:-1])) - 1
    lead = table.column("lead").to_numpy().astype(np.int64)
    marks = repeated_windows(group, table.column("content").to_pylist(), lead)
    out = []
    for i, (at, n) in enumerate(zip(lead.tolist(), table.column("n_windows").to_pylist(), strict=True)):
        out.append(np.packbits(marks[i, LEFT - at : LEFT - at + n]).tobytes())
    return pa.table({"fp": fp, "ctx": table.column("ctx"), "marks": pa.array(out, pa.binary())})


def repeated_contexts(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(fp, ctx, marks): contexts with repeated windows; null marks mean all their windows."""
    contexts = written(places.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min("rid").alias("rid")), "suffix-contexts")
    anchors = contexts.groupBy("fp").agg(F.sum("n").alias("total"), F.count("*").alias("m")).filter("total > 1")
    contexts = written(contexts.join(anchors.select("fp", "m"), "fp"), "suffix-shared")
    # copies of a context repeat each other; only single ones are in question, against all contexts of their anchor
    whole = contexts.filter("n > 1").select("fp", "ctx", F.lit(None).cast("binary").alias("marks"))
    open_ = contexts.filter("m > 1")
    lists = [F.collect_list(F.when(c, F.col("ctx"))).alias(a) for c, a in ((F.col("m") <= CONTEXTS, "few"), (F.col("m") > CONTEXTS, "many"))]
    wanted = open_.groupBy("rid").agg(*lists)
    cut = documents.join(wanted, "rid").select("text", "few", "many").mapInArrow(_cut, CUT)
    cut = written(cut.join(open_.select("fp", "ctx", "n", "m"), ["fp", "ctx"]), "suffix-cut").dropDuplicates(["fp", "ctx"])
    few, many = cut.filter(F.col("m") <= CONTEXTS), cut.filter(F.col("m") > CONTEXTS)
    parts = max(1, open_.filter(F.col("m") <= CONTEXTS).count() // COLLECTION)
    few = few.select("fp", "ctx", "lead", "n_windows", "content", F.pmod(F.xxhash64("fp"), F.lit(parts)).alias("part"))
    few = few.groupBy("part").applyInArrow(_collection, "fp long, ctx long, marks binary")
    many = _repeated_bins(many)
    none, ranges = F.lit(None), "array<struct<low:int,high:int>>"
    single = contexts.filter("n = 1").select("fp", "ctx")
    out = whole.withColumn("ks", none.cast(ranges))
    out = out.union(few.join(single, ["fp", "ctx"]).select("fp", "ctx", "marks", none.cast(ranges).alias("ks")))
    return out.union(many.join(single, ["fp", "ctx"]).select("fp", "ctx", none.cast("binary").alias("marks"), "ks"))


SPANS = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _applied(batches):
    for batch in batches:
        known = batch.column("known")
        for low, high, data, offsets in blocks(batch.column("text")):
            lists = known[low:high]
            if lists.null_count < len(lists):
                _, runs = byte_runs(data, offsets)
                row = np.searchsorted(offsets, runs.begin, "right") - 1
                ours = signed(runs.context)
                bounds = np.searchsorted(row, np.arange(high - low + 1))
            spans, kept, removed = [], [], []
            for i in range(high - low):
                text = data[offsets[i] : offsets[i + 1]]
                cover = np.zeros(len(text) + 1, np.int64)
                if lists[i].is_valid:
                    rows = {r["ctx"]: r for r in lists[i].as_py()}
                    a, b = bounds[i], bounds[i + 1]
                    for j in (a + np.flatnonzero(np.isin(ours[a:b], np.array(list(rows), np.int64)))).tolist():
                        r, n = rows[int(ours[j])], int(runs.count[j])
                        if r["marks"] is not None:
                            k = np.flatnonzero(np.unpackbits(np.frombuffer(r["marks"], np.uint8))[:n])
                        elif r["ks"] is None:
                            k = np.arange(n)
                        else:
                            lead = int(runs.anchor[j] - runs.begin[j])
                            k = np.unique(np.concatenate([np.arange(lead - x["high"], lead - x["low"] + 1) for x in r["ks"]]))
                        at = int(runs.begin[j] - offsets[i]) + k
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + WINDOW, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[low:high], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )


def remove_repeated_bytes(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start, length of the maximal removed runs), kept.

    A byte goes if a string of 400 bytes over it also begins anywhere else, in the same text included; texts are judged
    as they came and matches do not cross them. A null text has no bytes. Rows without id, repeated ids and repeated rows
    count like others. Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("rid", F.coalesce("doc_id", F.xxhash64("text")))
    places = written(_places(rows), "suffix-places")
    repeated = written(repeated_contexts(rows, places), "suffix-repeated")
    known = places.join(repeated, ["fp", "ctx"]).groupBy("rid").agg(F.collect_list(F.struct("ctx", "marks", "ks")).alias("known"))
    return rows.join(known, "rid", "left").select("doc_id", "text", "known").mapInArrow(_applied, SPANS)
