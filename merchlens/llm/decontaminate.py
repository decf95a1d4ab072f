"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Texts are read as passages of ``PASSAGE`` words, half overlapping, with TF-IDF weights over hashed words; the
frequencies are counted over the whole corpus. Randomised singular value decompositions of the benchmark's TF-IDF
passages, their products summed by Spark, give latent spaces. A space holds as many passages as it has dimensions, so
none of their cosines is cut. Every passage of the corpus is folded in and compared with every item by cosine; what
comes near is checked by the longest common subsequence of words and, for paraphrases, by looking for the item's
answer. Items that a text holds word for word are also found by the keys of their words, whatever their cosine.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BARE_WORDS, blocks, ragged, range_keys, split_words, text_arrays, window_keys

PASSAGE = 20
HALF = PASSAGE // 2
FEATURE_BITS = 17
#: Dimensions of a latent space, and at most so many item passages in it.
RANK = 256
OVERSAMPLE = 8
#: Items handled in one pass over the corpus; a longer benchmark takes more passes.
ITEMS = 1024
SIMILARITY = 0.4
#: Items over ``LONG`` words are looked for by parts of ``PART`` words, half overlapping, so that a passage inside a long
#: item still comes near to one of its parts.
LONG = 60
PART = 40
#: Words in a larger share of the half passages are no features (function words).
COMMON = 0.05
#: Share of an item's words, in order, that make a copy; and, with its answer present, a paraphrase.
COPY = 0.75
PARAPHRASE = 0.55
ANSWER = 0.9
#: Share of a passage's words (or of a shorter item's) that must follow the item's order for a closer look.
PRESENT = 0.4
MIN_WORDS = 5
#: Answers are the last sentence, or so many last words of an item if that is shorter.
ANSWER_WORDS = 4


def features(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def keys_of(text: str) -> np.ndarray:
    return split_words(*text_arrays(pa.array([text])), BARE_WORDS).key


@dataclass
class Space:
    """Latent space of some item passages: place of each feature, basis, folded passages, their lengths and items."""

    local: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    norm: np.ndarray
    owner: np.ndarray


@dataclass
class Items:
    """Benchmark items as word keys, with the latent spaces they span."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    idf: np.ndarray
    spaces: list[Space]

    def __post_init__(self):
        self.masks = [_masks(w) for w in self.words]
        self.answer_masks = [_masks(w) for w in self.answers]
        keys = [np.array(w, np.uint64) for w in self.words]
        heads = np.array([window_keys(k[:MIN_WORDS], MIN_WORDS)[0] for k in keys], np.uint64)
        self.order = np.argsort(heads, kind="stable")
        self.heads = heads[self.order]
        self.size = np.array([len(k) for k in keys])
        self.whole = np.array([range_keys(k, np.array([0]), np.array([len(k)]))[0] for k in keys], np.uint64)


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words):
        out[w] |= 1 << i
    return dict(out)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence (given by its position masks) and ``words``."""
    full = (1 << n) - 1
    state = full
    get = masks.get
    for w in words:
        m = get(w)
        if m is not None:
            hit = state & m
            state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def answer_of(text: str) -> str:
    """Last sentence or line of an item."""
    parts = [p for p in re.split(r"[.!?:\n]+", text) if p.strip()]
    return parts[-1] if parts else ""


def word_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(half passages each hashed word is in, number of half passages) of a string column, over all rows."""
    column = texts.columns[0]

    def count(batches):
        total, n = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(column)):
                words = split_words(data, offsets, BARE_WORDS)
                if not len(words.key):
                    continue
                begins = _half_starts(words.first)
                half = np.zeros(len(words.key), np.int64)
                half[begins] = 1
                pair = np.sort(((np.cumsum(half) - 1) << FEATURE_BITS) | features(words.key))
                distinct = np.append(True, pair[1:] != pair[:-1])
                total += np.bincount(pair[distinct] & ((1 << FEATURE_BITS) - 1), minlength=len(total))
                n += len(begins)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1).astype(np.int32), "n": np.append(total[at], n)})

    found = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(1 << FEATURE_BITS)
    df[feature[feature >= 0]] = n[feature >= 0]
    return df, int(n[feature < 0].sum())


def _half_starts(first: np.ndarray) -> np.ndarray:
    """Index of the first word of every half passage; half passages do not cross rows."""
    halves = -(-np.diff(first) // HALF)
    return np.repeat(first[:-1], halves) + ragged(np.zeros(len(halves), np.int64), halves) * HALF


def latent_space(passages: DataFrame, n_features: int, rank: int, iterations: int = 2, seed: int = 5) -> np.ndarray:
    """Orthonormal basis (features x rank) of the leading right singular space of sparse rows (at, value).

    Randomised range finder: products of the row matrix with a thin matrix are summed by Spark over all rows; only
    thin matrices come back.
    """
    width = min(rank + OVERSAMPLE, n_features)
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, width)))[0]
    for _ in range(iterations):
        thin = np.linalg.qr(_gram_times(passages, thin))[0]
    small = thin.T @ _gram_times(passages, thin)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    return thin @ vectors[:, keep]


def _gram_times(passages: DataFrame, thin: np.ndarray) -> np.ndarray:
    shared = passages.sparkSession.sparkContext.broadcast(thin)
    width = thin.shape[1]

    def partial(batches):
        total = np.zeros_like(shared.value)
        for batch in batches:
            for at, value in zip(batch.column("at"), batch.column("value"), strict=True):
                a, v = at.values.to_numpy(), value.values.to_numpy()
                total[a] += v[:, None] * (v @ shared.value[a])[None, :]
        rows = np.flatnonzero(np.abs(total).sum(1))
        flat = pa.array(total[rows].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists], names=["row", "sums"])

    rows = passages.mapInArrow(partial, "row long, sums array<double>")
    found = rows.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).toArrow()
    out = np.zeros_like(thin)
    if found.num_rows:
        out[found.column("row").to_numpy()] = np.stack(found.column("sums").to_numpy())
    return out


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """Log odds against a half passage having the word; words in more than ``COMMON`` of them weigh nothing."""
    df = np.minimum(df, n)
    odds = np.log((n - df + 0.5) / (df + 0.5))
    return np.where(df > COMMON * n, 0, np.maximum(odds, 0)).astype(np.float32)


def fit_items(rows: list[tuple[int, str]], df: np.ndarray, n: int, spark) -> Items | None:
    """Latent space of benchmark items (id, text); items of fewer than five words are left out."""
    kept = [(i, t, k) for i, t, k in ((i, t, keys_of(t)) for i, t in rows) if len(k) >= MIN_WORDS]
    if not kept:
        return None
    idf = inverse_frequency(df, n)
    parts, owner = [], []
    for i, (_, _, k) in enumerate(kept):
        cut = [k] if len(k) <= LONG else [k[j : j + PART] for j in range(0, len(k) - PART // 2, PART // 2)]
        for part in cut:
            # words that are no features have no direction; verbatim_items finds them
            if idf[features(part)].any():
                parts.append(part)
                owner.append(i)
    spaces = [fit_space(parts[j : j + RANK], owner[j : j + RANK], idf, spark) for j in range(0, len(parts), RANK)]
    answers = []
    for _, t, k in kept:
        a = keys_of(answer_of(t))
        answers.append((a if len(a) >= ANSWER_WORDS else k[-ANSWER_WORDS:]).tolist())
    return Items([i for i, _, _ in kept], [k.tolist() for _, _, k in kept], answers, idf, spaces)


def fit_space(parts: list[np.ndarray], owner: list[int], idf: np.ndarray, spark) -> Space:
    """Latent space of up to ``RANK`` item passages (word keys), which it represents completely."""
    used = np.unique(np.concatenate([features(k) for k in parts]))
    local = np.full(1 << FEATURE_BITS, -1, np.int32)
    local[used] = np.arange(len(used))
    sparse = []
    for part in parts:
        at, tf = np.unique(local[features(part)], return_counts=True)
        sparse.append((at.tolist(), (tf * idf[used[at]]).astype(float).tolist()))
    passages = spark.createDataFrame(sparse, "at array<int>, value array<double>")
    basis = latent_space(passages, len(used), len(sparse))
    latent = np.stack([np.asarray(v) @ basis[a] for a, v in sparse])
    norm = np.array([np.linalg.norm(v) for _, v in sparse])
    return Space(local, basis.astype(np.float32), latent.astype(np.float32), norm.astype(np.float32), np.array(owner))


def near_passages(words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, item, cosine) of the passages of a block that come near an item.

    The length of a passage counts each occurrence of a word by itself.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    if not len(words.key):
        return none
    feature = features(words.key)
    weight = items.idf[feature]
    begins = _half_starts(words.first)
    square = weight * weight
    full = np.add.reduceat(square, begins)
    next_same = np.append(words.row[begins[1:]] == words.row[begins[:-1]], False)
    full[:-1] += np.where(next_same[:-1], full[1:], 0)
    ends = np.append(begins[1:], len(words.key))
    out = []
    for space in items.spaces:
        local = space.local[feature]
        part = np.add.reduceat(np.where(local >= 0, square, 0), begins)
        part[:-1] += np.where(next_same[:-1], part[1:], 0)
        # the cosine is at most the share of the passage's length that lies in the items' words
        pick = np.flatnonzero((part > 0) & (part >= SIMILARITY**2 * full))
        for low in range(0, len(pick), 1024):
            p = pick[low : low + 1024]
            # every half passage is folded in once; sums of running totals give the halves, two halves a passage
            halves, place = np.unique(np.concatenate([p, p[next_same[p]] + 1]), return_inverse=True)
            at = ragged(begins[halves], ends[halves] - begins[halves])
            bounds = np.concatenate([[0], np.cumsum(ends[halves] - begins[halves])])
            inside = local[at] >= 0
            bounds = np.concatenate([[0], np.cumsum(inside)])[bounds]
            at = at[inside]
            total = np.zeros((len(at) + 1, space.basis.shape[1]), np.float32)
            np.cumsum(space.basis[local[at]] * weight[at][:, None], axis=0, out=total[1:])
            half = total[bounds[1:]] - total[bounds[:-1]]
            folded = half[place[: len(p)]]
            folded[next_same[p]] += half[place[len(p) :]]
            cosine = (folded @ space.latent.T) / (np.sqrt(np.maximum(full[p], 1e-9))[:, None] * space.norm[None, :])
            a, b = np.nonzero(cosine >= SIMILARITY)
            out.append((begins[p[a]], space.owner[b], cosine[a, b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def verbatim_items(words, items: Items) -> set[tuple[int, int]]:
    """(row, item) of the items whose words a block's texts hold one after the other."""
    found = set()
    if len(words.key) < MIN_WORDS:
        return found
    grams = window_keys(words.key, MIN_WORDS)
    low, high = (np.searchsorted(items.heads, grams, side) for side in ("left", "right"))
    starts = np.flatnonzero(high > low)
    row = words.row
    for j in range(0, len(starts), 1024):
        at = starts[j : j + 1024]
        count = high[at] - low[at]
        begin, item = np.repeat(at, count), items.order[ragged(low[at], count)]
        fits = begin + items.size[item] <= words.first[row[begin] + 1]
        begin, item = begin[fits], item[fits]
        equal = range_keys(words.key, begin, begin + items.size[item]) == items.whole[item]
        found.update(zip(row[begin[equal]].tolist(), item[equal].tolist(), strict=True))
    return found


def leaks_of_block(words, items: Items) -> list[tuple[int, int, float, float, bool]]:
    """(row, item, cosine, share of the item's words in order, answer found) of the items a block's texts contain."""
    start, item, cosine = near_passages(words, items)
    row = words.row[start] if len(start) else start
    best: dict[tuple[int, int], tuple[float, float, bool]] = {at: (0.0, 1.0, True) for at in verbatim_items(words, items)}
    for s, i, r, c in zip(start.tolist(), item.tolist(), row.tolist(), cosine.tolist(), strict=True):
        known = best.get((r, i), (0.0, 0.0, False))
        if known[1] >= COPY and known[2]:
            best[r, i] = (max(known[0], c), *known[1:])
            continue
        n, stop = len(items.words[i]), int(words.first[r + 1])
        passage = words.key[s : min(s + PASSAGE, stop)].tolist()
        if common_subsequence(items.masks[i], n, passage) < PRESENT * min(PASSAGE, n):
            continue
        low, high = max(int(words.first[r]), s - n), min(stop, s + PASSAGE + n)
        region = words.key[low:high].tolist()
        share = common_subsequence(items.masks[i], n, region) / n
        found = False
        if share >= PARAPHRASE:
            a = items.answers[i]
            found = common_subsequence(items.answer_masks[i], len(a), region) >= ANSWER * len(a)
        share, found = max((share, found), known[1:])
        best[r, i] = (max(c, known[0]), share, found)
    return [
        (r, i, c or 1.0, share, found)
        for (r, i), (c, share, found) in best.items()
        if share >= COPY or (share >= PARAPHRASE and found)
    ]


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id, similarity, share, answer_found.

    Null and empty texts contain nothing; null or short items are never found; repeated rows are reported each. Words
    are lower-case runs of letters and digits. A word for word copy that no cosine shows has similarity 1. The benchmark is read in blocks of ``ITEMS`` items, each of which is one
    pass over the documents. An empty documents or benchmark table gives an empty result.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, similarity double, share double, answer_found boolean"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.sparkSession.createDataFrame([], schema)
    for items in _item_blocks(texts, benchmark):
        shared = texts.sparkSession.sparkContext.broadcast(items)
        out = out.unionByName(texts.mapInArrow(_reported(shared), schema))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` less the rows that contain a benchmark item, as :func:`find_leaks` finds them; all columns stay."""
    for items in _item_blocks(documents.select(F.col("text").cast("string").alias("text")), benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        documents = documents.mapInArrow(_filtered(shared), documents.schema)
    return documents


def _item_blocks(texts: DataFrame, benchmark: DataFrame):
    """Latent spaces of up to ``ITEMS`` benchmark items each."""
    spark = texts.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    df, n = word_frequencies(texts.select("text"))
    rows = items.filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    while chunk := [(r["item_id"], r["text"]) for r in islice(rows, ITEMS)]:
        found = fit_items(chunk, df, n, spark)
        if found is not None:
            yield found


def _reported(shared):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for low, _, data, offsets in blocks(batch.column("text")):
                found = leaks_of_block(split_words(data, offsets, BARE_WORDS), shared.value)
                if found:
                    rows, item, cosine, share, answer = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": ids.take(pa.array(np.array(rows) + low)),
                            "item_id": pa.array([shared.value.ids[i] for i in item], pa.int64()),
                            "similarity": pa.array(cosine, pa.float64()),
                            "share": pa.array(share, pa.float64()),
                            "answer_found": pa.array(answer, pa.bool_()),
                        }
                    )

    return run


def _filtered(shared):
    def run(batches):
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column("text")):
                keep = np.ones(high - low, bool)
                keep[[row for row, *_ in leaks_of_block(split_words(data, offsets, BARE_WORDS), shared.value)]] = False
                yield batch.slice(low, high - low).filter(pa.array(keep))

    return run
