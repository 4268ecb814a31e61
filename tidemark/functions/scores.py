"""Proper scoring rules and uncertainty measures as columns over a probability vector p and an outcome index y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.prices import total

CLIP = 1e-15


def log_loss(p: Column, y: Column) -> Column:
    return -F.log(F.least(F.greatest(F.get(p, y), F.lit(CLIP)), F.lit(1 - CLIP)))


def brier(p: Column, y: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)))


def ranked(p: Column, y: Column) -> Column:
    """Ranked probability score of ordered outcomes."""
    upto = F.transform(p, lambda _, i: F.pow(total(F.slice(p, 1, i + 1)) - F.when(y <= i, 1.0).otherwise(0.0), 2))
    return (total(upto) - F.element_at(upto, -1)) / (F.size(p) - 1)


def accuracy(p: Column, y: Column) -> Column:
    """One for the likeliest outcome, shared among ties."""
    best = F.array_max(p)
    return F.when(F.get(p, y) == best, 1.0 / F.size(F.filter(p, lambda x: x == best))).otherwise(0.0)


def entropy(p: Column) -> Column:
    return -total(F.transform(F.filter(p, lambda x: x > 0), lambda x: x * F.log(x)))


def margin(p: Column) -> Column:
    """Difference of the two largest."""
    s = F.sort_array(p, asc=False)
    return F.get(s, 0) - F.get(s, 1)


def disagreement(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def temperature(p: Column, t: float) -> Column:
    raw = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), 1 / F.lit(t)))
    return F.transform(raw, lambda x: x / total(raw))


METRICS = {"log_loss": log_loss, "brier": brier, "rps": ranked, "accuracy": accuracy}


def metric(name: str, p: Column, y: Column) -> Column:
    """The row value of a metric by name; its mean is the metric. An unknown name is refused."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name](p, y)
