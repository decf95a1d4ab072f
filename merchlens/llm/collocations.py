"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces and words. A window of ``LONGEST`` - 1 words whose hash is divisible by ``TRIGGER`` ends one
chunk and begins the next, so chunks overlap by that window and equal passages give equal chunks wherever they stand. The
distinct chunks with their frequencies are the dictionary; phrases are counted in it, weighted, and only where they begin
in front of the overlap, so that each is counted once. Sizes are counted from short to long: a phrase is counted only if
the two phrases one word shorter in it may be frequent, which a bit table of bounded size tells without false negatives.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U64, blocks, byte_rows, fold_table, mix, ragged, range_keys, signed, split_words, window_keys
from .common import written

LONGEST = 4
FEWEST = 30
TOP = 2000
SCALE = 2_000_000
INSIDE_PERCENT = 80
TRIGGER = 16
NO_LANG = "und"
SALTS = 64
BLOCK = 1 << 20
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 28

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORDS = fold_table(b" \t" + PIECE_ENDS, lower=True)
JOINED = fold_table(b" ")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ENDS_PIECE = np.zeros(256, np.int32)
ENDS_PIECE[list(PIECE_ENDS)] = 1
_OTHER = 0xBF58476D1CE4E5B5


def _parser(longest: int):
    def parse(batches):
        """(lang, chunk, starts): the chunks of each text, and how many of their words begin phrases to be counted."""
        for batch in batches:
            lang = batch.column("lang")
            for low, _, data, offsets in blocks(batch.column("text")):
                words = split_words(data, offsets, WORDS)
                n = len(words.start)
                if not n:
                    continue
                row = words.row
                ends = np.concatenate([[0], np.cumsum(ENDS_PIECE[data])])
                opens = np.append(True, (row[1:] != row[:-1]) | (ends[words.start[1:]] > ends[words.end[:-1]]))
                piece_start = np.flatnonzero(opens)
                piece_end = np.append(piece_start[1:], n)[np.cumsum(opens) - 1]
                overlap = longest - 1
                trigger = np.zeros(n, bool)
                keys = window_keys(words.key, overlap)
                trigger[: len(keys)] = keys % U64(TRIGGER) == 0
                trigger &= np.arange(n) + overlap <= piece_end
                begin = np.flatnonzero(opens | trigger)
                following = np.append(begin[1:], n)
                inner = following < piece_end[begin]
                end = np.where(inner, following + overlap, piece_end[begin])
                size = words.end - words.start + 1
                plain = np.append(LOWER[data], np.uint8(0x20))[ragged(words.start, size)]
                at = np.concatenate([[0], np.cumsum(size)])
                plain[at[1:] - 1] = 0x20
                chunk = byte_rows(plain, at[begin], at[end] - 1 - at[begin])
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(row[begin] + low)), chunk, pa.array(following - begin)], names=["lang", "chunk", "starts"]
                )

    return parse


def chunk_dictionary(documents: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, chunk, starts, freq): distinct chunks of the texts of each language and how often they occur."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = texts.mapInArrow(_parser(longest), "lang string, chunk binary, starts long")
    return written(chunks.groupBy("lang", "chunk", "starts").agg(F.count("*").alias("freq")), "collocation-chunks")


class Maybe:
    """Bit table of frequent phrases of one size: never false for one of them."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, U64(len(words) * 64 - 1)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = key & self.mask
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0


def _lang_keys(lang: pa.Array) -> np.ndarray:
    coded = lang.dictionary_encode()
    each = [zlib.crc32(x.encode()) << 32 | zlib.crc32(x.encode(), 1) for x in coded.dictionary.to_pylist()]
    return mix(np.array(each, U64))[coded.indices.to_numpy(zero_copy_only=False)] if each else np.empty(0, U64)


def _first_of_equals(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal pairs together, where each kind begins in it)."""
    order = np.argsort(key, kind="stable")
    k, o = key[order], other[order]
    same = k[1:] == k[:-1]
    if (same & (o[1:] != o[:-1])).any():  # different phrases of one key
        order = np.lexsort((other, key))
        k, o = key[order], other[order]
        same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return order, np.flatnonzero(np.append(True, ~same))


def _counter(size: int, shorter):
    """Phrases of ``size`` words in chunks, summed within a block."""

    def count(batches):
        maybe = Maybe(shorter.value) if shorter is not None else None
        for batch in batches:
            lang, starts, freq = batch.column("lang"), batch.column("starts").to_numpy(), batch.column("freq").to_numpy()
            lang_keys = _lang_keys(lang)
            for low, high, data, offsets in blocks(batch.column("chunk"), BLOCK):
                words = split_words(data, offsets, JOINED)
                row = words.row
                at = np.flatnonzero(
                    (np.arange(len(row)) - words.first[row] < starts[low:high][row]) & (np.arange(len(row)) + size <= words.first[row + 1])
                )
                salt = lang_keys[low:high][row[at]]
                if maybe is not None:
                    part = window_keys(words.key, size - 1)
                    keep = maybe(mix(part[at] ^ salt)) & maybe(mix(part[at + 1] ^ salt))
                    at, salt = at[keep], salt[keep]
                if not len(at):
                    continue
                key = window_keys(words.key, size)[at] ^ salt
                other = range_keys(JOINED[data].astype(U64), words.start[at], words.end[at + size - 1], _OTHER) ^ salt
                order, kinds = _first_of_equals(key, other)
                total = np.add.reduceat(freq[low:high][row[at]][order], kinds)
                first = at[order[kinds]]
                begin = words.start[first]
                phrase = byte_rows(data, begin, words.end[first + size - 1] - begin)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(row[first] + low)), phrase, pa.array(total)], names=["lang", "phrase", "f"])

    return count


def _bits(size: int, mask: int):
    def run(batches):
        for batch in batches:
            lang_keys = _lang_keys(batch.column("lang"))
            for low, high, data, offsets in blocks(batch.column("phrase"), BLOCK):
                words = split_words(data, offsets, JOINED)
                at = mix(window_keys(words.key, size)[words.first[:-1]] ^ lang_keys[low:high]) & U64(mask)
                slot, bit = at >> U64(6), U64(1) << (at & U64(63))
                order = np.argsort(slot)
                kinds = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
                joint = np.bitwise_or.reduceat(bit[order], kinds)
                yield pa.RecordBatch.from_arrays([pa.array(signed(slot[order][kinds])), pa.array(signed(joint))], names=["slot", "bits"])

    return run


def _maybe_table(frequent: DataFrame, size: int) -> np.ndarray:
    """Bit table of the phrases: 16 bits each, between ``FEWEST_BITS`` and ``MOST_BITS``, which bound what is broadcast."""
    bits = min(max(FEWEST_BITS, 1 << (16 * frequent.count()).bit_length()), MOST_BITS)
    rows = frequent.select("lang", "phrase").mapInArrow(_bits(size, bits - 1), "slot long, bits long")
    rows = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(U64)


def frequent_phrases(chunks: DataFrame, longest: int = LONGEST, fewest: int = FEWEST) -> list[DataFrame]:
    """(lang, phrase, f) of the phrases of 1, 2, … words that occur ``fewest`` times or more; phrase as bytes."""
    context, found, shorter = chunks.sparkSession.sparkContext, [], None
    for size in range(1, longest + 1):
        counts = chunks.mapInArrow(_counter(size, shorter), "lang string, phrase binary, f long")
        counts = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= fewest)
        found.append(written(counts, f"collocation-frequent-{size}"))
        if size < longest:
            shorter = context.broadcast(_maybe_table(found[-1], size))
    return found


def collocations(documents: DataFrame, longest: int = LONGEST, fewest: int = FEWEST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts (columns text and lang; others are not read) are lower-cased in A-Z, split into pieces at ``.,;:!?`` and the
    bytes 10 to 13, and into words at spaces and tabs. A null or empty text has no words, a null lang is ``und``, repeated
    rows count again; a very long text is held whole by one task, an empty table gives no rows. a is the count of the
    phrase, l and r those of its parts at the cut of least score (of equals the first), n the words of the language.
    Phrases within a longer one that has 80 % of their count or more are left out. Ties go by a, then by phrase.
    """
    if longest < 2:
        raise ValueError("a collocation has two words at least")
    chunks = chunk_dictionary(documents, longest)
    n_words = chunks.groupBy("lang").agg(F.sum(F.col("starts") * F.col("freq")).alias("n"))
    sizes = frequent_phrases(chunks, longest, fewest)
    known = reduce(DataFrame.union, [f.selectExpr("lang", "CAST(phrase AS STRING) AS phrase", "f", f"{k} AS size") for k, f in enumerate(sizes, 1)])
    candidates = known.filter("size > 1").withColumn("words", F.split("phrase", " "))
    part = "array_join(slice(words, {}, {}), ' ')".format
    cuts = candidates.selectExpr("lang", "phrase", "f AS a", "size", "words", "explode(sequence(1, size - 1)) AS k")
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", part(1, "k") + " AS first", part("k + 1", "size - k") + " AS rest")
    cuts = cuts.join(known.selectExpr("lang", "phrase AS first", "f AS l"), ["lang", "first"])
    cuts = cuts.join(known.selectExpr("lang", "phrase AS rest", "f AS r"), ["lang", "rest"])
    wide = "CAST({} AS DECIMAL(19, 0))".format
    score = f"CAST({SCALE} * {wide('a')} div ({wide('l')} + {wide('r')}) AS BIGINT) AS score"
    scored = cuts.selectExpr("lang", "phrase", "a", "k", "l", "r", score)
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter("size > 2").selectExpr("lang", "f", "size", "words", "explode(sequence(2, size - 1)) AS m")
    inner = inner.selectExpr("lang", "f", "words", "m", "explode(sequence(1, size - m + 1)) AS i").selectExpr("lang", "f", part("i", "m") + " AS phrase")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    scored = scored.join(around, ["lang", "phrase"], "left")
    scored = scored.filter(f"around IS NULL OR 100 * {wide('around')} < {INSIDE_PERCENT} * {wide('a')}")
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    scored = place(place(scored, ["lang", "salt"]).filter(F.col("rank") <= top), ["lang"]).filter(F.col("rank") <= top)
    return scored.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
