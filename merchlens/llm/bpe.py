"""Byte-level BPE encoding and decoding with padded numpy matrices.

The ranks come from a file, read once on the driver and broadcast (a vocabulary is some megabytes). Texts are cut by a
pattern; the distinct words of a block, as bytes, become the rows of matrices, one for each class of lengths. In a round
every row merges its leftmost pair of least rank; the pair is looked up by hash, the row closes the gap, and rows without
a pair leave. Words of more than ``LONG`` bytes, whose rows would need as many rounds, are merged through a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, blocks, ragged

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 1024
WIDTHS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, LONG])
CELLS = 1 << 19
CACHE_WORDS = 1 << 18
CUT = 1 << 20
BLOCK = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)


class Ranks:
    """Byte strings of a rank file with their ids, which are also the order of merging, and all pairs that merge."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.pattern = pattern
        with open(path or public_tokenizers.path(RANKS), "rb") as lines:
            self.ids = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        size = max(self.ids.values()) + 1
        spelled = [b""] * size
        for word, i in self.ids.items():
            spelled[i] = word
        self.spell_len = np.array([len(s) for s in spelled], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (left << 32 | right, i)
            for word, i in self.ids.items()
            for k in range(1, len(word))
            if (left := self.ids.get(word[:k])) is not None and (right := self.ids.get(word[k:])) is not None
        ]
        self._hash(np.array(pairs, np.int64).reshape(-1, 2))

    def _hash(self, pairs: np.ndarray) -> None:
        """Open addressing, at most a quarter full; a taken slot sends a pair to the next."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(pairs[:, 0])
        while len(pairs):
            free = self.key[slot] == -1
            self.key[slot[free]] = pairs[free, 0]
            placed = self.key[slot] == pairs[:, 0]
            self.merged[slot[placed]] = pairs[placed, 1]
            pairs, slot = pairs[~placed], (slot[~placed] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, NONE if it doesn't; -1 stands for padding."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(np.ascontiguousarray(key))
        found = self.key[slot]
        out = np.where(found == key, self.merged[slot], NONE)
        missed = np.flatnonzero((found != key) & (found != -1))
        while len(missed):
            slot[missed] = (slot[missed] + 1) & (len(self.key) - 1)
            found = self.key[slot[missed]]
            hit = found == key[missed]
            out[missed[hit]] = self.merged[slot[missed[hit]]]
            missed = missed[~hit & (found != -1)]
        return out


def merge_matrix(ranks: Ranks, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids left of each row of ``ids`` (rows padded with -1) by merging: (all ids, number of each row)."""
    n, width = ids.shape
    row = np.arange(n)
    pair = ranks.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    out = []
    while len(row):
        if ids.shape[1] == 1:
            out.append((row, ids))
            break
        at = pair.argmin(axis=1)
        best = pair[np.arange(len(row)), at]
        ended = best == NONE
        if ended.any():
            out.append((row[ended], ids[ended]))
            go = ~ended
            row, ids, pair, at, best = row[go], ids[go], pair[go], at[go], best[go]
        k, width = len(row), ids.shape[1]
        each = np.arange(k)
        ids[each, at] = best
        keep = np.ones((k, width), bool)
        keep[each, at + 1] = False
        ids = ids[keep].reshape(k, width - 1)
        keep = np.ones((k, width - 1), bool)
        keep[each, at] = False
        pair = pair[keep].reshape(k, width - 2)
        left = np.flatnonzero(at > 0)
        pair[left, at[left] - 1] = ranks.rank(ids[left, at[left] - 1], best[left])
        right = np.flatnonzero(at < width - 2)
        pair[right, at[right]] = ranks.rank(best[right], ids[right, at[right] + 1])
    counts = np.zeros(n, np.int64)
    parts = []
    for rows, left_ids in out:
        used = left_ids >= 0
        counts[rows] = used.sum(axis=1)
        parts.append(left_ids[used])
    order = np.concatenate([rows for rows, _ in out]) if out else row
    begins = np.empty(n, np.int64)
    begins[order] = np.cumsum(counts[order]) - counts[order]
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return flat[ragged(begins, counts)], counts


def merge_long(ranks: Ranks, word: bytes) -> list[int]:
    """Ids left of one word by merging, through a heap of its pairs."""
    ids, end = [ranks.ids[word[i : i + 1]] for i in range(len(word))], len(word)
    spelled = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < end and (rank := ranks.ids.get(spelled[i] + spelled[j])) is not None:
            heapq.heappush(heap, (rank, i, len(spelled[i]) + len(spelled[j])))

    for i in range(end - 1):
        offer(i)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= end or len(spelled[i]) + len(spelled[j]) != size:
            continue
        ids[i], ids[j] = rank, -1
        spelled[i] += spelled[j]
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [i for i in ids if i >= 0]


def word_ids(ranks: Ranks, words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each)."""
    words = list(words)
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    whole = np.fromiter((ranks.ids.get(w, -1) for w in words), np.int64, n)
    counts, parts = np.ones(n, np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
    begins = np.cumsum(size) - size
    data = ranks.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    rest = np.flatnonzero((whole < 0) & (size <= LONG))
    bucket = np.searchsorted(WIDTHS, size[rest])
    for b in np.unique(bucket):
        same, width = rest[bucket == b], int(WIDTHS[b])
        for low in range(0, len(same), step := max(1, CELLS // width)):
            rows = same[low : low + step]
            at = begins[rows][:, None] + np.arange(width)[None, :]
            inside = np.arange(width)[None, :] < size[rows][:, None]
            ids = np.where(inside, data[np.where(inside, at, 0)], np.int32(-1))
            flat, counts[rows] = merge_matrix(ranks, ids)
            parts.append((rows, flat))
    for i in np.flatnonzero((whole < 0) & (size > LONG)):
        ids = merge_long(ranks, words[i])
        counts[i] = len(ids)
        parts.append((np.array([i]), np.array(ids, np.int32)))
    order = np.concatenate([rows for rows, _ in parts])
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(counts[order]) - counts[order]
    return np.concatenate([ids for _, ids in parts])[ragged(at, counts)], counts


class Encoder:
    """Encodes blocks of texts; keeps the ids of recent words, at most ``CACHE_WORDS`` and those of one block."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.find = regex.compile(ranks.pattern).findall
        self.break_before = regex.compile(r"\S(?= \p{L})")
        self._forget()

    def _forget(self) -> None:
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.ids, self.at, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``CUT`` characters, cut where a word begins whatever stands around."""
        low = 0
        if self.ranks.pattern == public_tokenizers.PATTERN:
            while len(text) - low > CUT and (found := self.break_before.search(text, low + CUT)):
                yield text[low : found.end()]
                low = found.end()
        yield text[low:] if low else text

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where the ids of each text begin, with the end as last value)."""
        if len(self.code) > CACHE_WORDS:
            self._forget()
        known, ends, codes = len(self.code), [0], []
        for text in texts:
            for part in self._parts(text or ""):
                codes.append(np.fromiter(map(self.code.__getitem__, self.find(part)), np.int32))
            ends.append(len(codes))
        if len(self.code) > known:
            ids, count = word_ids(self.ranks, (w.encode() for w in islice(self.code, known, None)))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        words = np.concatenate([[0], np.cumsum([len(c) for c in codes], dtype=np.int64)])[ends]
        code = np.concatenate(codes) if codes else np.empty(0, np.int32)
        count = self.count[code]
        return self.ids[ragged(self.at[code], count)], np.concatenate([[0], np.cumsum(count)])[words]


def encode(df: DataFrame, column: str = "text", out: str = "ids", ranks: Ranks | None = None) -> DataFrame:
    """``df`` with the ids of the whole text in ``column`` as an array of ints.

    A null or empty text has no ids (an empty array). Texts are not cut, whatever their length; repeated rows and rows
    with nulls elsewhere are encoded as all others, an empty table stays empty, and a column named ``out`` is replaced.
    """
    df = df.drop(out) if out != column else df
    kept = [c for c in df.columns if c != out]
    table = df.sparkSession.sparkContext.broadcast(ranks or Ranks())
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(table.value)
        for batch in batches:
            texts = batch.column(column).cast(pa.string())
            for low, high, _, _ in blocks(texts, BLOCK):
                ids, ends = encoder.block(texts[low:high].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[low:high] for c in kept), lists], names=[*kept, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "ids", out: str = "decoded", ranks: Ranks | None = None) -> DataFrame:
    """``df`` with the bytes that the ids in ``column`` spell; null or no ids give no bytes.

    An id outside the vocabulary is an error. A column named ``out`` is replaced; empty tables stay empty.
    """
    df = df.drop(out) if out != column else df
    kept = [c for c in df.columns if c != out]
    table = df.sparkSession.sparkContext.broadcast(ranks or Ranks())
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches):
        known = table.value
        for batch in batches:
            lists = batch.column(column)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(sizes)])
            low = 0
            while low < batch.num_rows:  # rows of about BLOCK ids together
                high = max(low + 1, int(np.searchsorted(total, total[low] + BLOCK // 4, "right")) - 1)
                part = lists[low:high]
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                width = known.spell_len[ids]
                at = np.concatenate([[0], np.cumsum(width)])[total[low : high + 1] - total[low]]
                data = np.ascontiguousarray(known.spell[ragged(known.spell_at[ids], width)])
                raw = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[low:high] for c in kept), raw], names=[*kept, out])
                low = high

    return df.mapInArrow(run, schema)


def bpe_report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded bytes."""
    ranks = Ranks(path)
    both = decode(encode(documents.select("doc_id", "text"), ranks=ranks), ranks=ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
