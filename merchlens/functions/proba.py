"""Algebra on probability and logit arrays."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import let

EPS = 1e-12
DOUBLE_EPS = sys.float_info.epsilon


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _scaled(a: Column, floor: float | None) -> Column:
    def by_total(total: Column, x: Column) -> Column:
        return x / (F.greatest(total, F.lit(floor)) if floor else total)

    return let(a, lambda v: let(array_sum(v), lambda s: F.transform(v, lambda x: by_total(s, x))))


def softmax(logits: Column) -> Column:
    """Max-shifted softmax; the denominator never falls below 1e-12."""
    shifted = let(
        logits,
        lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m))),
    )
    return _scaled(shifted, EPS)


def calibrated(logits: Column, temperature: Column | float) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return let(t, lambda tt: softmax(F.transform(logits, lambda x: x.cast("double") / tt)))


def normalize(probs: Column, eps: float = EPS) -> Column:
    """Clip to [eps, 1] and divide by the row sum."""
    return _scaled(F.transform(probs, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0))), None)


def rescale(probs: Column) -> Column:
    return _scaled(probs, None)


def weighted_sum(columns: list[Column], weights: list[float]) -> Column:
    out = F.transform(columns[0], lambda x: x * F.lit(float(weights[0])))
    for c, w in zip(columns[1:], weights[1:]):
        out = _add(out, c, w)
    return out


def _add(acc: Column, c: Column, w: float) -> Column:
    return F.zip_with(acc, c, lambda a, x: a + x * F.lit(float(w)))


def argmax(probs: Column) -> Column:
    """Zero-based position of the largest value, the first one on a tie."""
    return let(probs, lambda p: F.array_position(p, F.array_max(p)).cast("int") - F.lit(1))


def at(probs: Column, idx: Column) -> Column:
    return F.get(probs, idx)


def negative_log_likelihood(probs: Column, y: Column, eps: float = DOUBLE_EPS) -> Column:
    """-ln of the probability of the true class, clipped to [eps, 1 - eps]."""
    return -F.log(F.least(F.greatest(at(probs, y), F.lit(eps)), F.lit(1.0 - eps)))


def cross_entropy(logits: Column, y: Column, temperature: Column | float) -> Column:
    """Cross-entropy of softmax(logits / T) in log space."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    scaled = F.transform(logits, lambda x: x.cast("double") / t)
    return let(
        scaled,
        lambda z: let(
            F.array_max(z),
            lambda m: m + F.log(array_sum(F.transform(z, lambda x: F.exp(x - m)))) - F.get(z, y),
        ),
    )


def ranked(probs: Column, k: int) -> Column:
    """Top-k (rank, pos, p) structs of one row, by probability, then by position."""
    entries = F.transform(probs, lambda x, i: F.struct((-x).alias("neg"), i.alias("pos")))
    best = F.slice(F.array_sort(entries), 1, k)
    return F.transform(
        best,
        lambda e, r: F.struct(
            (r + 1).alias("rank"), e.getField("pos").alias("pos"), (-e.getField("neg")).alias("p")
        ),
    )
