"""Arrow text batches as numpy byte arrays: blocks, words and hashes.

Every operator of this package that runs Python works on these blocks, so the memory of a
task is bounded by a block (or by its single longest text), never by a partition or a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 1 << 15
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    pow_, inv = _tables.get(base, (np.empty(0, U64), None))
    if len(pow_) <= n:
        size = max(n + 1, BLOCK_BYTES + 2)
        pow_, inv = (
            np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (base, pow(base, -1, 1 << 64))
        )
        if size <= 16 * BLOCK_BYTES:
            _tables[base] = pow_, inv
    return pow_, inv


def fold_table(separators: bytes, lower: bool = False) -> np.ndarray:
    """Byte table for :func:`split_words`: 0 for separators, else the (lower-cased) byte; a zero byte counts as 255."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
PLAIN_WORDS = fold_table(WHITE)
LOWER_WORDS = fold_table(WHITE, lower=True)
BARE_WORDS = fold_table(NOT_ALNUM, lower=True)


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets


def blocks(column, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer text stands alone."""
    data, offsets = text_arrays(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of a block: byte spans, 64-bit keys, and ``first[d]:first[d + 1]`` as the words of row ``d``."""

    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = PLAIN_WORDS) -> Words:
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, U64), np.zeros(len(offsets), np.int64))
    low = fold[data]
    inside = low != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    joined = inside[1:] & inside[:-1] & ~edge[1:n]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~joined
    closes[:-1] &= ~joined
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    pow_, inv = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(low * pow_[:n], out=total[1:])
    key = mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(start, end, key, np.searchsorted(start, offsets))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every run of ``size`` words; a text of fewer words is one shingle, a text without words none."""
    n = len(words.key)
    row = words.row
    bound = words.first[1:][row] if n else np.empty(0, np.int64)
    at = np.arange(n)
    key = words.key.copy()
    for j in range(1, size):
        part = np.zeros(n, U64)
        part[: n - j] = words.key[j:] * U64(pow(_BASE, j, 1 << 64))
        part[at + j >= bound] = 0
        key += part
    short = (at == words.first[:-1][row]) & (bound - at < size) if n else np.empty(0, bool)
    keep = (at + size <= bound) | short
    return row[keep], mix(key[keep])


def window_keys(keys: np.ndarray, size: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """64-bit keys of all runs of ``size`` consecutive values (one for each start that fits)."""
    n = len(keys)
    if n < size:
        return np.empty(0, U64)
    pow_, inv = powers(n, base)
    total = np.zeros(n + 1, U64)
    np.cumsum(keys * pow_[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inv[: n - size + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start..start + length."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    skip = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total) - np.repeat(skip - starts, lengths)


def byte_rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary column of byte spans."""
    out = np.ascontiguousarray(data[ragged(starts, lengths)])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span :])


def range_keys(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """64-bit keys of the runs begin..end of ``keys``, equal for equal runs at any place."""
    pow_, inv = powers(len(keys), base)
    total = np.zeros(len(keys) + 1, U64)
    np.cumsum(keys * pow_[: len(keys)], out=total[1:])
    return mix((total[end] - total[begin]) * inv[begin] + (end - begin).astype(U64))


@dataclass
class Runs:
    """Runs of windows with one anchor: first window, number of windows, anchor position, anchor and context keys."""

    begin: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    fingerprint: np.ndarray
    context: np.ndarray

    def pick(self, at) -> "Runs":
        return Runs(self.begin[at], self.count[at], self.anchor[at], self.fingerprint[at], self.context[at])


_PLACE = U64((1 << 26) - 1)


def window_runs(keys: np.ndarray, first: np.ndarray, window: int, gram: int) -> Runs:
    """Every run of ``window`` values within a row has an anchor: the ``gram`` of least key in it, the leftmost of equals.

    The anchor depends on the window alone, so equal windows have equal anchors at equal places. Consecutive windows
    with one anchor form a run; its context is all they cover.
    """
    n = len(keys)
    empty = np.empty(0, np.int64)
    if n < window:
        return Runs(empty, empty, empty, np.empty(0, U64), np.empty(0, U64))
    grams = window_keys(keys, gram)
    place = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), window - gram + 1) & _PLACE
    bound = np.repeat(first[1:], np.diff(first))[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + window <= bound)
    if not len(at):
        return Runs(empty, empty, empty, np.empty(0, U64), np.empty(0, U64))
    p = place[at].astype(np.int64)
    new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    begin, anchor = at[new], p[new]
    count = np.diff(np.append(new, len(at)))
    context = range_keys(keys, begin, begin + count + window - 1)
    context = mix(context + count.astype(U64) * U64(0x9E6C63D0876A9A47) + (anchor - begin).astype(U64) * U64(0xE7037ED1A0B428DB))
    return Runs(begin, count, anchor, grams[anchor], context)
