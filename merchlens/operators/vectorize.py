"""Count and TF-IDF vectorisers with document-frequency bounds and a size limit.

Fitting counts the n-grams of each task's texts in Arrow kernels and adds the counts up by one aggregate.
Transforming is row-local: the bounded vocabulary travels as a broadcast and no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import VECTORIZER_PRESETS
from ..functions.text_merge import blank
from ..session import local_rows, persist_to_table
from .scaling import PopulationScaler

LOG_STEPS = 64  # buckets per doubling of a term frequency
CHUNK_BYTES = 1 << 22  # text whose n-grams are counted at once
MOST_TERMS = 1 << 20  # counted terms a task holds before it passes them on


def sparse_entries(vector: Column) -> Column:
    """Non-zero entries of a sparse vector as an array of (term_idx, value) structs."""
    raw = F.unwrap_udt(vector)
    return F.zip_with(
        raw.getField("indices"),
        raw.getField("values"),
        lambda i, v: F.struct(i.alias("term_idx"), v.alias("value")),
    )


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of up to ``CHUNK_BYTES`` of text (one text at least), with the place of their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        begin = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + CHUNK_BYTES, "right")))
        yield low, texts.slice(low, high - low)
        low = high


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place among the distinct values of each value, distinct values)."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def text_units(texts: pa.Array, analyzer: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place among the distinct units, distinct units) of the words or characters of texts, in order."""
    if analyzer == "word":
        # a word is a run of two or more letters, numbers and underscores, in any script
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}_]+", " "), " ")
        words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
        whole = pc.greater_equal(pc.utf8_length(words), 2)
        return rows.filter(whole).to_numpy(zero_copy_only=False), *_encoded(words.filter(whole))
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    unit, distinct = _encoded(pa.array(points))
    rows = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    return rows, unit, pa.array([chr(x) for x in distinct.to_pylist()], pa.string())


def gram_counts(texts: pa.Array, analyzer: str, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, n-gram, count) of texts without nulls, sorted by row, and the n-grams' names; for each size of ``lo`` to ``hi``.

    The n-grams of a size are those of the size before with the unit after them, so their codes stay small.
    """
    row, unit, names = text_units(texts, analyzer)
    units, gram = names, unit
    for n in range(1, hi + 1):
        if n > 1:
            begins = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.empty(0, np.int64)
            # a row's units are neighbours: its (n-1)-grams are those that begin at these places
            longer = np.full(len(row), -1, np.int64)
            codes, distinct = _encoded(pa.array(gram[begins] * len(units) + unit[begins + n - 1], pa.int64()))
            longer[begins] = codes
            distinct = distinct.to_numpy(zero_copy_only=False)
            parts = names.take(pa.array(distinct // max(1, len(units)))), units.take(pa.array(distinct % max(1, len(units))))
            names, gram = pc.binary_join_element_wise(*parts, " " if analyzer == "word" else ""), longer
        if n >= lo:
            at = gram >= 0
            pairs = np.sort(row[at] * max(1, len(names)) + gram[at])
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(pairs)))
            yield *np.divmod(pairs[first], max(1, len(names))), count, names


_TERMS = "term string, tf long, df long"


def _summed(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
    return table.select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])


@dataclass
class Vectorizer:
    """Parameters of a vectoriser; ``fit`` returns a :class:`FittedVectorizer`."""

    kind: str = "tfidf"  # or "count"
    analyzer: str = "word"  # or "char"
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int | float = 2
    max_df: int | float = 0.95
    max_features: int | None = 10_000
    sublinear_tf: bool = True
    binary: bool = False
    lowercase: bool = False

    def __post_init__(self):
        if self.kind not in ("count", "tfidf"):
            raise ValueError(f"kind must be 'count' or 'tfidf', not {self.kind!r}")

    @classmethod
    def preset(cls, name: str, **overrides) -> Vectorizer:
        if name not in VECTORIZER_PRESETS:
            raise ValueError(f"unknown preset {name!r}; have {sorted(VECTORIZER_PRESETS)}")
        return cls(**{**VECTORIZER_PRESETS[name], **overrides})

    def prepared(self, text: Column) -> Column:
        """The text whose words or characters count; of white space, a run is one blank between characters."""
        text = F.make_valid_utf8(blank(text))
        text = F.lower(text) if self.lowercase else text
        return text if self.analyzer == "word" else F.regexp_replace(text, r"(?U)\s\s+", " ")

    def term_statistics(self, df: DataFrame, text: str) -> DataFrame:
        """Corpus frequency and document frequency per n-gram.

        A task counts its own texts before the shuffle, so a term in a third of all
        documents costs its reducer a few rows per map task.
        """
        analyzer, (lo, hi) = self.analyzer, self.ngram_range

        def run(batches):
            parts, held = [], 0
            for batch in batches:
                for _, texts in text_chunks(batch.column(0)):
                    for _, gram, count, names in gram_counts(texts, analyzer, lo, hi):
                        tf = np.bincount(gram, count, len(names)).astype(np.int64)
                        df = np.bincount(gram, minlength=len(names))
                        parts.append(pa.table({"term": names, "tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64())}))
                        held += len(names)
                    if held > 2 * MOST_TERMS:
                        parts = [_summed(parts)]
                        held = len(parts[0])
                        if held > MOST_TERMS:
                            yield from parts.pop().to_batches(max_chunksize=1 << 16)
                            held = 0
            if parts:
                yield from _summed(parts).to_batches(max_chunksize=1 << 16)

        counted = df.select(self.prepared(F.col(text)).alias("text")).mapInArrow(run, _TERMS)
        return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    def vocabulary(self, df: DataFrame, text: str, n_docs: int | None = None) -> DataFrame:
        """Kept terms (term, tf, df): within the df bounds, most frequent first, ties by term."""
        n_docs = df.count() if n_docs is None else n_docs
        low = self.min_df if isinstance(self.min_df, int) else self.min_df * n_docs
        high = self.max_df if isinstance(self.max_df, int) else self.max_df * n_docs
        stats = self.term_statistics(df, text).filter((F.col("df") >= low) & (F.col("df") <= high))
        return stats if self.max_features is None else top_terms(stats, self.max_features)

    def fit(self, df: DataFrame, text: str) -> FittedVectorizer:
        if self.max_features is None:
            raise ValueError("fit needs max_features; use vocabulary() for an unbounded term table")
        n_docs = df.count()
        kept = sorted(self.vocabulary(df, text, n_docs).collect(), key=lambda r: r["term"])
        if not kept:
            raise ValueError("no terms remain within the document frequency bounds")
        idf = [math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in kept]
        return FittedVectorizer(self, [r["term"] for r in kept], idf, [r["tf"] for r in kept], [r["df"] for r in kept])


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    """The k terms of largest tf, ties by term.

    The statistics are written once, since reading the texts again costs far more. A
    histogram over log-spaced tf buckets then shows which buckets fit whole, and only
    the bucket that crosses the limit is sorted.
    """
    bucketed = persist_to_table(stats.withColumn("_b", F.floor(F.log2("tf") * LOG_STEPS)), "terms")
    histogram = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()
    room, cut = k, None
    for row in sorted(histogram, key=lambda r: -r["_b"]):
        if row["n"] > room:
            cut = row["_b"]
            break
        room -= row["n"]
    if cut is None:
        return bucketed.drop("_b")
    whole = bucketed.filter(F.col("_b") > cut)
    if room == 0:
        return whole.drop("_b")
    edge = bucketed.filter(F.col("_b") == cut).orderBy(F.desc("tf"), "term").limit(room)
    return whole.unionByName(edge).drop("_b")


@dataclass
class FittedVectorizer:
    params: Vectorizer
    terms: list[str]
    idf: list[float]
    tf: list[int] = field(repr=False, default_factory=list)
    df: list[int] = field(repr=False, default_factory=list)

    def vocabulary(self, spark) -> DataFrame:
        rows = list(zip(range(len(self.terms)), self.terms, self.tf, self.df, self.idf))
        return local_rows(spark, rows, "term_idx int, term string, tf long, df long, idf double")

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.vector(F.col(text)))

    def vector(self, text: Column) -> Column:
        """Sparse vector of a text; TF-IDF vectors have length one, or zero without kept terms."""
        p, width = self.params, len(self.terms)
        context = SparkContext.getOrCreate()  # experiments run in threads, which have no active session
        shared = context.broadcast((pa.array(self.terms, pa.string()), np.array(self.idf)))

        def values(row: np.ndarray, place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
            value = np.ones(len(count)) if p.binary else count.astype(np.float64)
            if p.kind == "count":
                return value
            value = (1.0 + np.log(value) if p.sublinear_tf else value) * shared.value[1][place]
            norm = np.sqrt(np.bincount(row, value**2, n))[row]
            return np.divide(value, norm, out=value, where=norm > 0)

        @F.arrow_udf(VectorUDT())
        def vectors(texts: pa.Array) -> pa.Array:
            terms = shared.value[0]
            size, places, cells = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], [np.empty(0)]
            for low, some in text_chunks(texts):
                keys, counts = [], []
                for row, gram, count, names in gram_counts(some, p.analyzer, *p.ngram_range):
                    place = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[gram]
                    kept = place >= 0
                    keys.append(row[kept] * width + place[kept])
                    counts.append(count[kept])
                key, count = np.concatenate(keys), np.concatenate(counts)
                order = np.argsort(key)
                row, place = np.divmod(key[order], width)
                size[low : low + len(some)] = np.bincount(row, minlength=len(some))
                places.append(place)
                cells.append(values(row, place, count[order], len(some)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            kind, wide = pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), width, np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part), of))
                for part, of in ((places, pa.int32()), (cells, pa.float64()))
            ]
            return pa.StructArray.from_arrays([kind, wide, *lists], names=["type", "size", "indices", "values"])

        return vectors(p.prepared(text))

    def entries(self, df: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """Long form: one row per document and kept term (``keep``, term, value)."""
        rows = self.transform(df, text, "_v").select(*keep, F.inline(sparse_entries(F.col("_v"))))
        names = self.vocabulary(df.sparkSession).select("term_idx", "term")
        return rows.join(F.broadcast(names), "term_idx").select(*keep, "term", "value")


@dataclass
class FeatureUnion:
    """Several vectoriser blocks, optionally weighted, next to population-scaled columns."""

    blocks: list[tuple[str, str, Vectorizer, float]]  # name, text column, vectoriser, weight
    feature_columns: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> FittedUnion:
        fitted = [(name, text, v.fit(df, text), w) for name, text, v, w in self.blocks]
        scaler = PopulationScaler.fit(df, self.feature_columns) if self.feature_columns else None
        return FittedUnion(fitted, scaler)


@dataclass
class FittedUnion:
    blocks: list[tuple[str, str, FittedVectorizer, float]]
    scaler: PopulationScaler | None

    def transform(self, df: DataFrame, out: str = "features", weights: dict[str, float] | None = None) -> DataFrame:
        parts = []
        for name, text, vectorizer, weight in self.blocks:
            weight = (weights or {}).get(name, weight)
            df = vectorizer.transform(df, text, f"_block_{name}")
            parts.append(f"_block_{name}")
            if weight != 1.0:
                scale = Vectors.dense([float(weight)] * len(vectorizer.terms))
                df = ElementwiseProduct(scalingVec=scale, inputCol=parts[-1], outputCol=parts[-1] + "_w").transform(df)
                parts[-1] += "_w"
        if self.scaler:
            df = self.scaler.transform(df, prefix="_scaled_")
            parts += ["_scaled_" + c for c in self.scaler.columns]
        df = VectorAssembler(inputCols=parts, outputCol=out).transform(df)
        return df.drop(*[c for c in df.columns if c.startswith(("_block_", "_scaled_"))])

    def feature_names(self) -> list[str]:
        names = [f"{name}__{t}" for name, _, v, _ in self.blocks for t in v.terms]
        return names + (self.scaler.columns if self.scaler else [])


def split_union(
    title: str = "designation",
    description: str = "description",
    feature_columns: list[str] | None = None,
    title_weight: float = 1.0,
    **params,
) -> FeatureUnion:
    """Title block x weight, description block, scaled manual features."""
    return FeatureUnion(
        [("title", title, Vectorizer(**params), title_weight), ("desc", description, Vectorizer(**params), 1.0)],
        feature_columns or [],
    )


def merged_union(text: str = "text", feature_columns: list[str] | None = None, **params) -> FeatureUnion:
    return FeatureUnion([("text", text, Vectorizer(**params), 1.0)], feature_columns or [])


def word_char_union(
    text: str, char_range: tuple[int, int] = (3, 5), word: dict | None = None, char: dict | None = None
) -> FeatureUnion:
    """Word n-grams next to character n-grams of the same text."""
    return FeatureUnion(
        [
            ("word", text, Vectorizer(**{"lowercase": True, "max_features": 250_000, **(word or {})}), 1.0),
            (
                "char",
                text,
                Vectorizer(
                    **{
                        "analyzer": "char", "ngram_range": char_range, "lowercase": True,
                        "max_df": 1.0, "max_features": 150_000, **(char or {}),
                    }
                ),
                1.0,
            ),
        ]
    )
