"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

The pieces and scores come from a model file, read once on the driver and broadcast (a vocabulary is some megabytes).
A text is cut where no piece can cross (before a space mark, around characters that no piece holds). Distinct words of
a block are encoded once: words of equal length advance together, hashes of their substrings probe the sorted piece
keys, and the best option of each end position leaves a back pointer. Characters outside the vocabulary become bytes.

Scores of a unigram model are log probabilities and add up along a path. Scores of a merge (BPE) model are ranks, whose
sum means nothing; there a step from one piece to the next counts if merging their joint text gives just these two
pieces. One such step leads to every position, so the search gives the ids that merging gives.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, blocks, mix, powers, ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1 << 19
CELLS = 1 << 19
PAIRS = 1 << 20
_BASE = 0xA24BAED4963EE407


class Pieces:
    """Piece keys, scores and byte spellings of a model, as arrays."""

    def __init__(self, model: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names, scores, ids = [], [], []
        spelled: list[bytes] = []
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                spelled.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"" if not sp.is_unknown(i) else " ⁇ ".encode())
            else:
                spelled.append(piece.replace("▁", " ").encode())
                names.append(piece), scores.append(sp.get_score(i)), ids.append(i)
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces that go on after a space are not supported")
        self.byte_fallback = bool((self.byte_ids != sp.unk_id()).any())
        self.unknown = sp.unk_id()
        keys = np.array([_key(np.array([ord(c) for c in p], np.uint32)) for p in names], U64)
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("two pieces share a key")
        self.keys, self.scores, self.ids = keys[order], np.array(scores)[order], np.array(ids, np.int32)[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> U64(42)).astype(np.int64)] = True
        self.longest = max(map(len, names))
        self.chars = np.zeros(0x110000, bool)
        self.chars[sorted({ord(c) for p in names for c in p})] = True
        self.low = float(min(s for s in scores if s > -1e8)) - UNKNOWN_PENALTY
        self.pair_key = self.pair_ok = None
        self.merges = all(float(x).is_integer() for x in scores)
        if self.merges:
            self._learn_merges([names[i] for i in order])
        self.spell_len = np.array([len(s) for s in spelled], np.int64)
        self.spell_at = np.concatenate([[0], np.cumsum(self.spell_len)[:-1]])
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)

    def _learn_merges(self, names: list[str]) -> None:
        """For every piece: the time it is formed at, the parts of its last merge, and whether merging forms it at all."""
        rank = np.unique(-self.scores, return_inverse=True)[1]
        self.rank = {p: int(r) for p, r in zip(names, rank, strict=True)}
        at = {p: i for i, p in enumerate(names)}
        n = len(names)
        self.time, self.part = np.full(n, -1, np.int64), np.repeat(np.arange(n)[:, None], 2, axis=1)
        self.size = np.array([len(p) for p in names])
        pow_, _ = powers(self.longest, _BASE)
        self.raw = np.array([sum(ord(c) * int(pow_[i]) for i, c in enumerate(p)) & (1 << 64) - 1 for p in names], U64)
        self.order = rank.astype(np.int64)
        self.formed = np.zeros(n, bool)
        for p in sorted(names, key=len):
            i = at[p]
            if len(p) == 1:
                self.formed[i] = True
                continue
            last = merge_pieces(self.rank, p, stop_before_last=True)
            if len(last) == 2:
                left, right = at[last[0]], at[last[1]]
                self.formed[i], self.part[i] = True, (left, right)
                self.time[i] = max(int(rank[i]), self.time[left], self.time[right])

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_follows` with a memory of recent pairs, one for each slot of a fixed table."""
        if self.pair_key is None:
            self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        pair = left * len(self.keys) + right
        slot = ((pair.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != pair)
        out = self.pair_ok[slot]
        if len(new):
            out[new] = self._follows(left[new], right[new])
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = pair[new], out[new]
        return out

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces gives these pieces: going back in time through the last merges
        of either, no merge across the border may come earlier than the one undone (or as early, further left)."""
        out = np.ones(len(left), bool)
        alive = np.arange(len(left))
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), np.iinfo(np.int64).max)
        pow_, _ = powers(self.longest, _BASE)
        while len(alive):
            a, b = left[alive], right[alive]
            joint = self.find(mix(self.raw[a] + self.raw[b] * pow_[self.size[a]] + (self.size[a] + self.size[b]).astype(U64)))
            crossed = (joint >= 0) & (self.order[joint] < limit[alive])
            out[alive[crossed]] = False
            alive, a, b = alive[~crossed], a[~crossed], b[~crossed]
            later = self.time[a] > self.time[b]
            base = np.maximum(self.time[a], self.time[b]) < 0
            limit[alive] = np.where(later, self.time[a], self.time[b] + 1)
            left[alive] = np.where(later, self.part[a, 1], a)
            right[alive] = np.where(later, b, self.part[b, 0])
            alive = alive[~base]
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rank of each key among the piece keys, or -1."""
        out = np.full(key.shape, -1, np.int64)
        maybe = np.flatnonzero(self.seen[(key >> U64(42)).astype(np.int64)])
        at = np.searchsorted(self.keys, key[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key[maybe]
        out[maybe[hit]] = at[hit]
        return out


def _key(chars: np.ndarray) -> U64:
    pow_, _ = powers(len(chars), _BASE)
    return mix(np.array([(chars * pow_[: len(chars)]).sum(dtype=U64)], U64) + U64(len(chars)))[0]


def merge_pieces(rank: dict[str, int], text: str, stop_before_last: bool = False) -> list[str]:
    """Pieces that merging leaves of a text: always the neighbours of best rank, the leftmost of equals."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < len(parts) and (r := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, j, len(parts[i]) + len(parts[j])))

    for i in range(len(parts) - 1):
        offer(i)
    left = len(parts)
    while heap and not (stop_before_last and left == 2):
        _, i, j, size = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        left -= 1
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


def viterbi(pieces: Pieces, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segmentation of the rows of ``words`` (n x length code points): (ids, ids per word).

    Ties go to the longer last piece. A character no piece covers counts as unknown and becomes its UTF-8 bytes. Merge
    models: runs of space marks, whose pieces have equal ranks, and words without a path are merged step by step.
    """
    n, length = words.shape
    pow_, inv = powers(length, _BASE)
    total = np.zeros((n, length + 1), U64)
    np.cumsum(words * pow_[:length], axis=1, out=total[:, 1:])
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((n, length + 1), np.int32)
    rank = np.full((n, length + 1), -1, np.int64)
    step = max(1, CELLS // (n * pieces.longest))
    for low in range(1, length + 1, step):
        ends = np.arange(low, min(low + step, length + 1))
        sizes = np.arange(min(pieces.longest, length), 0, -1)
        starts = ends[:, None] - sizes[None, :]
        fits = starts >= 0
        starts = np.maximum(starts, 0)
        key = mix((total[:, ends][:, :, None] - total[:, starts]) * inv[starts] + sizes.astype(U64))
        found = pieces.find(key.ravel()).reshape(n, len(ends), len(sizes))
        found[:, ~fits] = -1
        score = np.where(found >= 0, pieces.scores[found], -np.inf)
        alone = score[:, :, -1]
        alone[alone == -np.inf] = pieces.low
        for k, end in enumerate(ends):
            options = _steps(pieces, rank, starts[k], found[:, k], sizes) if pieces.merges else best[:, starts[k]] + score[:, k]
            pick = options.argmax(axis=1)
            best[:, end] = options[np.arange(n), pick]
            back[:, end] = sizes[pick]
            rank[:, end] = found[np.arange(n), k, pick]
    odd = np.flatnonzero(~np.isfinite(best[:, length]) | (words[:, :2] == MARK).all(1)) if pieces.merges and length > 1 else []
    for i in odd:
        end = 0
        for p in merge_pieces(pieces.rank, "".join(map(chr, words[i]))):
            end += len(p)
            back[i, end], rank[i, end] = len(p), pieces.find(np.array([_key(words[i, end - len(p) : end])], U64))[0]
    # walk back from the ends of all words together
    at, rows, steps = np.full(n, length), np.arange(n), []
    while len(rows):
        steps.append((rows, at[rows], rank[rows, at[rows]]))
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    row, end, r = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((end, row))
    row, end, r = row[order], end[order], r[order]
    ids = np.where(r >= 0, pieces.ids[r], -1)
    if (ids < 0).any():
        return _with_bytes(pieces, words, row, end, ids)
    return ids.astype(np.int32), np.bincount(row, minlength=n)


def _steps(pieces: Pieces, rank: np.ndarray, starts: np.ndarray, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(words x sizes) 0 where the piece of that size may end the prefix, after the piece its start was reached by."""
    out = np.full(found.shape, -np.inf)
    flat = np.flatnonzero(found >= 0)
    row, k = np.divmod(flat, found.shape[1])
    piece, start = found.ravel()[flat], starts[k]
    before = rank[row, start]
    ok = (start == 0) & pieces.formed[piece]
    inner = np.flatnonzero((before >= 0) & (start > 0) & pieces.formed[piece])
    ok[inner] = pieces.follows(before[inner], piece[inner])
    out.ravel()[flat[ok]] = 0.0
    return out


def _with_bytes(pieces: Pieces, words, row, end, ids):
    out, count = [], np.zeros(len(words), np.int64)
    for r, e, i in zip(row, end, ids, strict=True):
        got = [i] if i >= 0 else unknown_ids(pieces, int(words[r, e - 1]))
        out.extend(got)
        count[r] += len(got)
    return np.array(out, np.int32), count


def unknown_ids(pieces: Pieces, char: int) -> list[int]:
    return [int(pieces.byte_ids[b]) for b in chr(char).encode()] if pieces.byte_fallback else [pieces.unknown]


class Encoder:
    """Encodes blocks of texts; keeps the ids of recent words, at most ``CACHE_WORDS``."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self):
        self.key, self.at, self.count, self.ids = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in ids)."""
        chars = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
        n_chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows = n_chars[offsets]
        full = np.flatnonzero(np.diff(rows))  # rows with text get a space mark in front
        chars = np.insert(chars, rows[full], MARK)
        chars[chars == 0x20] = MARK
        rows = rows + np.concatenate([[0], np.cumsum(np.diff(rows) > 0)])
        n = len(chars)
        if n == 0:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        mark, foreign = chars == MARK, ~self.pieces.chars[chars]
        opens = foreign.copy()
        opens[1:] |= foreign[:-1] | (mark[1:] & ~mark[:-1])
        opens[rows[full]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, n))
        pow_, inv = powers(n, _BASE)
        total = np.zeros(n + 1, U64)
        np.cumsum(chars * pow_[:n], out=total[1:])
        key = mix((total[start + size] - total[start]) * inv[start] + size.astype(U64))
        distinct, first, where = np.unique(key, return_index=True, return_inverse=True)
        self._learn(distinct, chars, start[first], size[first])
        slot = np.searchsorted(self.key, distinct)[where]
        count = self.count[slot]
        ids = self.ids[ragged(self.at[slot], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(start, rows)]

    def _learn(self, distinct, chars, start, size):
        if len(self.key) + len(distinct) > CACHE_WORDS:
            self._forget()
        slot = np.searchsorted(self.key, distinct)
        slot[slot == len(self.key)] = 0
        new = np.flatnonzero(self.key[slot] != distinct) if len(self.key) else np.arange(len(distinct))
        if not len(new):
            return
        ids, at, count, used = [self.ids], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), len(self.ids)
        lengths = size[new]
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            length = int(lengths[same[0]])
            rows = max(1, CELLS // (length * self.pieces.longest))
            for i in range(0, len(same), rows):
                part = same[i : i + rows]
                words = chars[start[new[part]][:, None] + np.arange(length)[None, :]]
                got, n = viterbi(self.pieces, words)
                at[part] = used + np.cumsum(n) - n
                count[part] = n
                ids.append(got)
                used += len(got)
        self.ids = np.concatenate(ids)
        key = np.concatenate([self.key, distinct[new]])
        order = np.argsort(key)
        self.key, self.at, self.count = key[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]


def encode(df: DataFrame, column: str = "text", out: str = "ids", pieces: Pieces | None = None) -> DataFrame:
    """``df`` with the piece ids of ``column`` as an array of ints; a null text has null ids, an empty one none.

    ``out`` must not be a column of ``df``. Texts are encoded whole; a space mark (U+2581) in a text reads as a space.
    """
    if out in df.columns:
        raise ValueError(f"{out} is already a column")
    table = df.sparkSession.sparkContext.broadcast(pieces or Pieces())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(table.value)
        for batch in batches:
            texts = batch.column(column)
            for low, high, data, offsets in blocks(texts, 1 << 20):
                ids, ends = encoder.block(data, offsets)
                null = pc.is_null(texts[low:high])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays([*(c[low:high] for c in batch.columns), lists], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "ids", out: str = "decoded", pieces: Pieces | None = None) -> DataFrame:
    """``df`` with the text spelled by the ids in ``column``; null ids give null, no ids an empty text.

    Repeated rows are decoded each, an empty table stays empty; ``out`` must not be a column of ``df``.
    """
    if out in df.columns:
        raise ValueError(f"{out} is already a column")
    table = df.sparkSession.sparkContext.broadcast(pieces or Pieces())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        p = table.value
        for batch in batches:
            lists = batch.column(column)
            n = batch.num_rows
            step = max(1, min(n, 256))
            for low in range(0, n, step):
                part = lists[low : low + step]
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                width = p.spell_len[ids]
                at = np.concatenate([[0], np.cumsum(width)])
                data, bounds = p.spell[ragged(p.spell_at[ids], width)], at[ends]
                # the space mark in front of a text is not part of it
                lead = np.flatnonzero((np.diff(bounds) > 0) & (np.append(data, 0)[bounds[:-1]] == 0x20))
                keep = np.ones(len(data), bool)
                keep[bounds[lead]] = False
                cut = np.zeros(len(bounds), np.int64)
                cut[lead + 1] = 1
                bounds = (bounds - np.cumsum(cut)).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[keep]))])
                text = pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), raw.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(c[low : low + step] for c in batch.columns), text], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def token_report(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: number of ids, a digest of them, and whether decoding gives the text back.

    A null text has no ids and counts as given back; repeated rows are reported each, an empty table gives no rows, texts
    are read whole, and columns other than doc_id and text are not read.
    """
    pieces = Pieces(model)
    both = decode(encode(documents.select("doc_id", "text"), pieces=pieces), pieces=pieces)
    same = F.col("decoded").eqNullSafe(F.translate("text", "▁", " "))
    n = F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.xxhash64("ids").alias("ids_digest"), same.alias("round_trip"))
