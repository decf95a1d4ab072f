"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three folded characters are hashed to ``DIMENSIONS`` features. Document frequencies are counted over
every learnable document. The weights are fitted on a bounded sample with the follow-the-regularised-leader method
(per-coordinate steps, elastic-net penalty), then one temperature is fitted on rows kept out of that sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks

DIMENSIONS = 1 << 14
ORDERS = 3
UNDETERMINED = "und"
#: Labelled rows the weights are fitted on, per language and in all.
FIT_PER_LANGUAGE = 1000
FIT_ROWS = 10_000
CALIBRATION_SHARE = 0.2
MIN_SCORE = 0.5


@cache
def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or a space for everything that is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIMENSIONS counts, whether a row has a letter); n-grams do not cross rows."""
    n_rows = len(offsets) - 1
    chars = _folded()[np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)]
    rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # two spaces between rows, the end of one and the begin of the next, so that no n-gram reaches into another row
    chars = np.insert(chars, np.repeat(rows, 2), 0x20)
    rows = rows + 2 * np.arange(n_rows + 1) + 1
    row = np.repeat(np.arange(n_rows, dtype=np.int64) * DIMENSIONS, np.diff(rows))
    chars = chars[rows[0] : rows[-1]]
    letters = chars != 0x20
    h, slots = np.zeros(len(chars), np.uint32), []
    for order in range(1, ORDERS + 1):
        part = np.full(len(chars), 0x20, np.uint32)
        part[: len(chars) - order + 1] = chars[order - 1 :]
        h = (h * np.uint32(0x01000193)) ^ (part + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF))
        slot = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)
        # only n-grams that begin with a letter, or with the space before one
        first = letters if order == 1 else letters | np.append(letters[1:], False)
        slots.append((row + slot)[first])
    flat = np.concatenate(slots)
    counts = np.bincount(flat, minlength=n_rows * DIMENSIONS).reshape(n_rows, DIMENSIONS)
    return counts, np.add.reduceat(letters, rows[:-1] - rows[0]) > 0 if len(letters) else np.zeros(n_rows, bool)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Root term frequency times inverse document frequency, rows of length one."""
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    info: dict = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        logits = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


class Ftrl:
    """Proximal follow-the-regularised-leader for softmax regression, one sparse example at a time."""

    def __init__(self, dims: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        logits = value @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1.0
        g = value[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def fit_weights(rows, labels: np.ndarray, classes: list[str], idf: np.ndarray, epochs: int = 3) -> Model:
    """Weights and temperature from sparse rows (indices, values); every fifth row only sets the temperature.

    The order of the rows is that of the examples; the constant feature is the last coordinate.
    """
    ftrl = Ftrl(DIMENSIONS + 1, len(classes))
    held = np.arange(len(rows)) % round(1 / CALIBRATION_SHARE) == 0 if len(rows) >= 10 else np.zeros(len(rows), bool)
    for _ in range(epochs):
        for (at, value), label in zip((r for r, h in zip(rows, held, strict=True) if not h), labels[~held], strict=True):
            ftrl.learn(np.append(at, DIMENSIONS), np.append(value, 1.0), int(label))
    w = ftrl.weights()
    logits = np.array([v @ w[a] + w[DIMENSIONS] for (a, v), h in zip(rows, held, strict=True) if h]).reshape(-1, len(classes))
    temperature = fit_temperature(logits, labels[held])
    return Model(classes, idf, w[:DIMENSIONS].astype(np.float32), w[DIMENSIONS].astype(np.float32), temperature)


def fit_temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """Temperature of least log loss, by golden-section search over its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]).mean())

    a, b, ratio = np.log(low), np.log(high), (5**0.5 - 1) / 2
    while b - a > 1e-4:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(learnable: DataFrame, text: str = "text", label: str = "lang") -> Model | None:
    """Model from the rows with a label and a text with letters; None if there are none.

    Document frequencies cover all rows. The sample takes at most ``FIT_PER_LANGUAGE`` rows a label and ``FIT_ROWS``
    in all, those with the smallest hash of their text; it is the only thing that reaches the driver, where rows of
    equal text and label come as one with their number.
    """
    rows = learnable.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text"), rows=64):
                counts, _ = gram_counts(data, offsets)
                total += (counts > 0).sum(0)
                n += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1).astype(np.int32), "n": np.append(total[at], n)})

    found = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    table = dict(zip(found["feature"].to_pylist(), found["n"].to_pylist(), strict=True))
    n_docs = int(table.pop(-1, 0))
    df = np.zeros(DIMENSIONS)
    df[list(table.keys())] = list(table.values())
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_ROWS).collect()
    if not sizes:
        return None
    each = max(1, min(FIT_PER_LANGUAGE, FIT_ROWS // len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.1 * each / r["count"]))])
    hashed = F.xxhash64("text").alias("h")
    drawn = rows.select("lang", "text", hashed).filter(F.col("h") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")])
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def sparse(batches):
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column("text"), rows=64):
                counts, letters = gram_counts(data, offsets)
                x = vectors(counts, idf)
                at = [np.flatnonzero(r).astype(np.int32) for r in counts]
                part = pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang")[low:high],
                        batch.column("h")[low:high],
                        batch.column("copies")[low:high],
                        pa.array([a.tobytes() for a in at], pa.binary()),
                        pa.array([x[i, a].tobytes() for i, a in enumerate(at)], pa.binary()),
                    ],
                    names=["lang", "h", "copies", "at", "value"],
                )
                yield part.filter(pa.array(letters))

    sample = drawn.mapInArrow(sparse, "lang string, h long, copies long, at binary, value binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["h"], r["lang"]))
    classes, kept, taken = sorted({r["lang"] for r in sample}), [], {}
    for r in sample:
        before = taken.get(r["lang"], 0)
        taken[r["lang"]] = min(each, before + r["copies"])
        kept += [r] * (taken[r["lang"]] - before)
    if not kept:
        return None
    labels = np.array([classes.index(r["lang"]) for r in kept])
    return fit_weights([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in kept], labels, classes, idf)


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``: the likeliest language of the whole text and its calibrated probability.

    A null text, a text without letters, or no model gives ``und`` with score 0. Equal scores go to the first language
    in alphabetical order.
    """
    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if clash := {"lang_pred", "score"} & set(df.columns):
        raise ValueError(f"already columns: {sorted(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(text), rows=64):
                name, score = np.full(high - low, UNDETERMINED, object), np.zeros(high - low)
                if m is not None:
                    counts, letters = gram_counts(data, offsets)
                    p = m.scores(vectors(counts, m.idf))
                    best = p.argmax(1)
                    name[letters] = np.array(m.classes, object)[best[letters]]
                    score[letters] = p[np.arange(len(p)), best][letters]
                yield pa.RecordBatch.from_arrays(
                    [*(c[low:high] for c in batch.columns), pa.array(name, pa.string()), pa.array(score)],
                    names=[*batch.schema.names, "lang_pred", "score"],
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *out]))


def held_out(doc_id: Column) -> Column:
    """Documents the model never learns from; a null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out: doc_id, held_out,
    lang_pred, score.

    Repeated rows are predicted each and count as often in what is learned; texts are read whole, an empty table gives no
    rows. A null or empty text is ``und`` with score 0. Columns other than doc_id, text and lang are not read.
    """
    model = fit(documents.filter(~held_out(F.col("doc_id"))))
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")
