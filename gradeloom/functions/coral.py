"""Ordinal grades from cumulative probabilities P(y > k), and back.

Probabilities are an array column, or a list of columns where the number of classes is known: a list becomes plain arithmetic, which
Spark compiles, while functions over arrays are interpreted element by element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_targets(y: Column, classes: int) -> Column:
    """[y > 1, ..., y > K-1] as 0 and 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda k: (y > k).cast("int"))


def ordered_thresholds(free: list[float]) -> list[float]:
    """Cut points from free parameters: the first as it is, then steps of exp of the (clipped) others."""
    import math

    out = [float(free[0])]
    for d in free[1:]:
        out.append(out[-1] + math.exp(min(max(d, -30.0), 30.0)))
    return out


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logits(s: Column, thresholds: list[float], slope: float = 1.0) -> list[Column]:
    """Log odds of y > k for each cut point."""
    return [F.lit(float(slope)) * (s - F.lit(float(t))) for t in thresholds]


def bounds(s: Column, thresholds: list[float], slope: float = 1.0) -> list[Column]:
    """P(y > k) for each cut point."""
    return [sigmoid(x) for x in logits(s, thresholds, slope)]


def cumulative(s: Column, thresholds: list[float], slope: float = 1.0) -> Column:
    return F.array(*bounds(s, thresholds, slope))


def expected(p_gt: Column | list[Column]) -> Column:
    if isinstance(p_gt, list):
        return sum(p_gt, F.lit(1.0))
    return F.aggregate(p_gt, F.lit(1.0), lambda a, p: a + p)


def class_probabilities(p_gt: Column | list[Column]) -> Column:
    """[1 - p_1, p_1 - p_2, ..., p_{K-1}]"""
    if isinstance(p_gt, list):
        return F.array(*[a - b for a, b in zip([F.lit(1.0), *p_gt], [*p_gt, F.lit(0.0)], strict=True)])
    upper = F.concat(F.array(F.lit(1.0)), p_gt)
    lower = F.concat(p_gt, F.array(F.lit(0.0)))
    return F.zip_with(upper, lower, lambda a, b: a - b)


def decode(p_gt: Column | list[Column], threshold: float | Column = 0.5) -> Column:
    """1 + the number of probabilities strictly over their threshold: a number, or an array with one for each bound."""
    if isinstance(p_gt, list):
        limit = [threshold[k] for k in range(len(p_gt))] if isinstance(threshold, Column) else [F.lit(float(threshold))] * len(p_gt)
        return sum(((p > t).cast("int") for p, t in zip(p_gt, limit, strict=True)), F.lit(1))
    if isinstance(threshold, Column):
        return F.aggregate(F.zip_with(p_gt, threshold, lambda p, t: (p > t).cast("int")), F.lit(1), lambda a, x: a + x)
    return F.aggregate(p_gt, F.lit(1), lambda a, p: a + (p > F.lit(float(threshold))).cast("int"))


def decode_argmax(p_gt: Column) -> Column:
    """The first class of the largest probability."""
    p = class_probabilities(p_gt)
    return F.array_position(p, F.array_max(p)).cast("int")


def residual(y: Column, p_gt: Column) -> Column:
    """Sum over bounds of [y > k] - P(y > k)."""
    return F.aggregate(F.transform(p_gt, lambda p, i: (y > i + 1).cast("double") - p), F.lit(0.0), lambda a, x: a + x)


def loss(y: Column, scores: list[Column]) -> Column:
    """Mean binary cross-entropy over the bounds of a row, from their log odds: however far these lie, it is finite."""
    each = [F.greatest(x, F.lit(0.0)) - F.when(y > k, x).otherwise(0.0) + F.log1p(F.exp(-F.abs(x))) for k, x in enumerate(scores, 1)]
    return sum(each, F.lit(0.0)) / len(each)


def mean_loss(loss: Column, weight: Column | None = None) -> Column:
    """Mean of the rows' losses, weighted if a weight is given."""
    return F.avg(loss) if weight is None else F.try_divide(F.sum(loss * weight), F.sum(F.when(loss.isNotNull(), weight)))


def decode_offsets(y_cont: Column, offsets: list[float]) -> Column:
    """1 + the number of k with y_cont > k + offset_k."""
    terms = [(y_cont > F.lit(k + float(o))).cast("int") for k, o in enumerate(offsets, 1)]
    return sum(terms[1:], F.lit(1) + terms[0])


def decode_round(y_cont: Column, low: int, high: int) -> Column:
    """Half rounded up, then clipped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(y_cont + 0.5))).cast("int")
