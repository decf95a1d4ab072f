"""Removal of recurring passages by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. Anchors (a phrase of ``PHRASE`` words chosen by the window's content) bring
equal windows together; windows that occur in several documents are confirmed and get the smallest document that has
them. Every document then receives the phrases of its confirmed windows. Aho-Corasick automata, one for each batch of
documents, are compiled from them, and all documents are streamed through to locate every occurrence.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PLAIN_WORDS, blocks, byte_rows, ragged, signed, split_words, window_keys, window_runs
from .common import written

WINDOW = 50
PHRASE = 8
REACH = WINDOW - PHRASE + 1


def plain_bytes(data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block, each followed by one space, and where each begins (with the end as last value)."""
    size = words.end - words.start + 1
    at = ragged(words.start, size)
    out = np.append(data, np.uint8(0x20))[at]
    begins = np.concatenate([[0], np.cumsum(size)])
    out[begins[1:] - 1] = 0x20
    return out, begins


def anchor_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, ctx): the window runs of every document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for low, _, data, offsets in blocks(batch.column("text")):
                words = split_words(data, offsets, PLAIN_WORDS)
                runs = window_runs(words.key, words.first, WINDOW, PHRASE)
                rows = words.row[runs.begin] + low
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(signed(runs.fingerprint)), pa.array(signed(runs.context))], names=["doc_id", "fp", "ctx"]
                )

    return documents.mapInArrow(run, "doc_id long, fp long, ctx long")


def _cut(batches):
    """Phrase and window keys of the wanted contexts of each document."""
    for batch in batches:
        wanted = batch.column("contexts")
        for low, _, data, offsets in blocks(batch.column("text")):
            words = split_words(data, offsets, PLAIN_WORDS)
            runs = window_runs(words.key, words.first, WINDOW, PHRASE)
            if not len(runs.begin):
                continue
            row = words.row[runs.begin]
            lists = wanted[low : low + len(offsets) - 1]
            ends = lists.offsets.to_numpy()
            ours = signed(runs.context)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            values = lists.values.to_numpy()
            keep = np.zeros(len(row), bool)
            for i in range(len(offsets) - 1):
                a, b = bounds[i], bounds[i + 1]
                keep[a:b] = np.isin(ours[a:b], values[ends[i] : ends[i + 1]])
            runs = runs.pick(np.flatnonzero(keep))
            if not len(runs.begin):
                continue
            plain, begins = plain_bytes(data, words)
            start, end = begins[runs.anchor], begins[runs.anchor + PHRASE] - 1
            keys = signed(window_keys(words.key, WINDOW))[ragged(runs.begin, runs.count)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs.count)]), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(runs.fingerprint)), pa.array(signed(runs.context)), byte_rows(plain, start, end - start), lists],
                names=["fp", "ctx", "phrase", "windows"],
            )


def confirmed(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """(fp, ctx, phrase, windows, owners) of the contexts with windows that occur in several documents; the owner of a
    window is the smallest document that has it, null where that is the only one."""
    contexts = runs.groupBy("fp", "ctx").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    contexts = written(contexts, "repeat-contexts")
    shared = contexts.groupBy("fp").agg(F.min("owner").alias("low"), F.max("last").alias("high")).filter("low < high").select("fp")
    contexts = written(contexts.join(shared, "fp", "left_semi"), "repeat-shared")
    wanted = contexts.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("ctx").alias("contexts"))
    cut = documents.join(wanted, "doc_id").select("text", "contexts").mapInArrow(_cut, "fp long, ctx long, phrase binary, windows array<long>")
    cut = cut.groupBy("fp", "ctx").agg(F.first("phrase").alias("phrase"), F.first("windows").alias("windows"))
    cut = written(cut.join(contexts, ["fp", "ctx"]), "repeat-cut")
    each = cut.select("fp", "ctx", "owner", "last", F.posexplode("windows").alias("k", "w"))
    owners = each.groupBy("fp", "w").agg(F.min("owner").alias("first"), F.max("last").alias("final")).filter("first < final").select("fp", "w", "first")
    per = each.join(owners, ["fp", "w"]).groupBy("fp", "ctx").agg(F.collect_list(F.struct("w", "first")).alias("owned"))
    return written(cut.select("fp", "ctx", "phrase").join(per, ["fp", "ctx"]), "repeat-confirmed")


def _located(batches):
    """Words of each document that confirmed windows of smaller documents cover, found by an automaton per batch."""
    for batch in batches:
        phrase_column, window_column = batch.column("phrases"), batch.column("windows")
        for low, high, data, offsets in blocks(batch.column("text")):
            words = split_words(data, offsets, PLAIN_WORDS)
            plain, begins = plain_bytes(data, words)
            removed = np.zeros(len(words.key), bool)
            phrases = {p for row in phrase_column[low:high].to_pylist() if row for p in row}
            if phrases:
                automaton = ahocorasick.Automaton()
                for p in phrases:
                    automaton.add_word(" " + p.decode("latin-1") + " ", len(p))
                automaton.make_automaton()
                keys = signed(window_keys(words.key, WINDOW))
                for i in range(high - low):
                    known = window_column[low + i].values
                    a, b = words.first[i], words.first[i + 1]
                    if known is None or not len(known) or b - a < WINDOW:
                        continue
                    text = " " + plain[begins[a] : begins[b]].tobytes().decode("latin-1")
                    hits = np.array([end - size for end, size in automaton.iter(text)], np.int64)
                    # a hit begins at a word of this document; windows around it are compared with the confirmed ones
                    anchor = np.searchsorted(begins[a : b + 1], hits - 1 + begins[a])
                    start = np.maximum(anchor - REACH + 1, 0)
                    stop = np.minimum(anchor, b - a - WINDOW)
                    at = np.unique(ragged(start, np.maximum(stop - start + 1, 0)))
                    at = at[np.isin(keys[a + at], known.to_numpy())] + a
                    cover = np.zeros(b - a + 1, np.int64)
                    np.add.at(cover, at - a, 1)
                    np.add.at(cover, at - a + WINDOW, -1)
                    removed[a:b] = np.cumsum(cover)[:-1] > 0
            kept = np.flatnonzero(~removed)
            size = (begins[1:] - begins[:-1])[kept]
            rest = plain[ragged(begins[:-1][kept], size)]
            n_kept = np.searchsorted(kept, words.first)
            ends = np.concatenate([[0], np.cumsum(size)])[n_kept]
            # the space after the last kept word of a row goes
            last = ends[1:][np.diff(ends) > 0] - 1
            mask = np.ones(len(rest), bool)
            mask[last] = False
            ends = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
            texts = pa.Array.from_buffers(pa.string(), high - low, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rest[mask]))])
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[low:high], pa.array(n), pa.array(n - np.diff(n_kept)), texts], names=["doc_id", "n_words", "n_removed", "kept"]
            )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of other than space and the bytes 9 to 13. A word goes if a window over it also starts in a document
    with a smaller doc_id; windows are judged on the input. A null text has no words. Rows without id are kept whole and
    make others lose nothing; rows that repeat an id do not count as smaller than each other. Other columns are not read.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = written(anchor_runs(documents.filter("doc_id IS NOT NULL")), "repeat-runs")
    known = confirmed(documents, runs)
    later = runs.join(known, ["fp", "ctx"])
    smaller = F.transform(F.filter("owned", lambda o: o["first"] < F.col("doc_id")), lambda o: o["w"])
    later = later.select("doc_id", "phrase", smaller.alias("windows")).filter(F.size("windows") > 0)
    later = later.groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases"), F.flatten(F.collect_list("windows")).alias("windows"))
    rows = documents.join(later, "doc_id", "left")
    return rows.mapInArrow(_located, "doc_id long, n_words long, n_removed long, kept string")
