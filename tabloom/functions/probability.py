"""Densities, normalisation and the reweighting of candidates by their violations."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return F.exp(F.lit(-0.5) * z * z) / (sigma * F.sqrt(F.lit(2.0) * F.pi()))


def normalised(p: Column, over: WindowSpec) -> Column:
    """Shares of the window's sum; null where that is 0."""
    return p / F.nullif(F.sum(p).over(over), F.lit(0.0))


def reweighted(p: Column, weights: list[float], counts: list[Column]) -> Column:
    """p * exp(-sum of weight * violations); a weight of 1000 makes a constraint hard."""
    load = F.lit(0.0)
    for w, n in zip(weights, counts):
        load = load + F.lit(float(w)) * n
    return p * F.exp(-load)
