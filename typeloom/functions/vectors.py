"""Expressions over array<float|double> columns. Arithmetic is in double."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once; written out in a lambda it would be computed anew for each element."""
    return F.transform(F.array(value), of)[0]


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def softmax(logits: Column) -> Column:
    powers = _with(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return _with(F.named_struct(F.lit("p"), powers), lambda s: _with(_sum(s["p"]), lambda total: F.transform(s["p"], lambda x: x / total)))


def log_softmax(logits: Column) -> Column:

    def less(top: Column) -> Column:
        rest = F.log(_sum(F.transform(logits, lambda x: F.exp(x.cast("double") - top))))
        return _with(rest, lambda r: F.transform(logits, lambda x: x.cast("double") - top - r))

    return _with(F.array_max(logits).cast("double"), less)


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0, off_target: bool = False) -> Column:
    """Smoothed cross-entropy: ``smoothing`` goes to all classes alike, or with ``off_target`` to the others only."""
    n = F.size(logits)

    def loss(logs: Column) -> Column:
        own = F.element_at(logs, target.cast("int") + 1)
        if off_target:
            share = F.lit(smoothing) / F.greatest(n - 1, F.lit(1))
            return -((1 - smoothing) * own + share * (_sum(logs) - own))
        return -((1 - smoothing) * own + F.lit(smoothing) / n * _sum(logs))

    return _with(F.named_struct(F.lit("l"), log_softmax(logits)), lambda s: loss(s["l"]))


def top_k(values: Column, k: int) -> Column:
    """array<struct<prob, idx>> of the k largest, ties by the smaller index."""
    pairs = F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("prob"), p["idx"].alias("idx")))


def min_max(values: Column) -> Column:
    """Scaled to [0, 1]; a constant vector becomes zeros."""
    ends = F.named_struct(F.lit("low"), F.array_min(values).cast("double"), F.lit("high"), F.array_max(values).cast("double"))

    def scaled(s: Column) -> Column:
        return F.transform(values, lambda x: F.least(F.greatest((x - s["low"]) / F.greatest(s["high"] - s["low"], F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)))

    return _with(ends, scaled)


def one_hot_delta(delta: Column, limit: int) -> Column:
    """2*limit+1 bins; deltas beyond the limit fall into the outermost ones."""
    at = F.least(F.greatest(delta, F.lit(-limit)), F.lit(limit)) + limit
    return F.transform(F.sequence(F.lit(0), F.lit(2 * limit)), lambda i: (i == at).cast("int"))


def position_code(row: Column, col: Column, width: int) -> Column:
    """2-D sinusoids: the first half of the vector codes the row, the second the column, sine and cosine in turn."""
    half = width // 2

    def one(at: Column) -> list[Column]:
        out = []
        for i in range(half):
            angle = at / F.lit(10_000.0 ** (2 * (i // 2) / half))
            out.append(F.sin(angle) if i % 2 == 0 else F.cos(angle))
        return out

    return F.array(*one(row), *one(col))


def learning_rate(epoch: Column, base: float, epochs: int, warmup: int, floor: float = 0.0) -> Column:
    """Linear warm-up, then a half cosine down to ``floor``."""
    progress = F.least(F.greatest((epoch - warmup) / F.lit(float(max(1, epochs - warmup))), F.lit(0.0)), F.lit(1.0))
    cosine = floor + (base - floor) * 0.5 * (1 + F.cos(progress * math.pi))
    return F.when(epoch < warmup, base * (epoch + 1) / float(max(1, warmup))).otherwise(cosine)


def one_cycle_rate(epoch: Column, peak: float, epochs: int, divisor: float = 25.0, rise: float = 0.3) -> Column:
    """A straight rise from peak/divisor over the first ``rise`` of the epochs, then a straight fall to 0 in the last."""
    part = epoch / F.lit(float(max(1, epochs - 1)))
    up = peak / divisor + (peak - peak / divisor) * part / F.lit(rise)
    return F.when(part < rise, up).otherwise(peak * (1 - (part - rise) / F.lit(max(1e-8, 1 - rise))))
