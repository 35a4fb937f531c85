"""Whole runs: what to group, draw first, look up and paste for a kind of table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import rng
from tabloom.operators import constrained, dependency, learning, sampling, transform
from tabloom.operators.constrained import Settings
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.files import toggled


def grouped_flow(true: DataFrame, dcs: Sequence[DenialConstraint], weights: Sequence[float], columns: Sequence[str], groups: dict[str, Sequence[str]], settings: Settings = Settings(), n: int | None = None) -> DataFrame:
    """Attributes of few values are generated as one (such as sex and income), then split again."""
    kinds = dict(true.dtypes)
    joined = true.select(*[F.col(f"`{c}`") for c in columns]).na.drop()
    for name, parts in groups.items():
        joined = transform.concatenated(joined, parts, name)
    made = constrained.synthesize(joined, dcs, weights, joined.columns, n, settings)
    for name, parts in groups.items():
        made = transform.split_again(made, name, parts)
        made = made.withColumns({c: F.col(f"`{c}`").try_cast(kinds[c]) for c in parts})
    return made.select("tid", *[F.col(f"`{c}`") for c in columns])


def binary_flow(true: DataFrame, dcs: Sequence[DenialConstraint], columns: Sequence[str], binaries: Sequence[str], settings: Settings = Settings(), steps: int = 100, batch: int = 128, rate: float = 1e-8, sigma: float = 0.0, tid: str = "tid") -> tuple[DataFrame, list[float]]:
    """Weights are learned from the violations first; the binary attributes are drawn jointly from the full table of their
    combinations, and the rest continues from there. Returns the table and the weights."""
    weights = learning.learn_weights(true, dcs, steps, batch, rate, sigma, settings.seed, tid)
    rows = true.select(*[F.col(f"`{c}`") for c in columns]).na.drop()
    n = rows.count()
    values = {c: sorted(r[0] for r in rows.select(F.col(f"`{c}`")).distinct().limit(3).collect()) for c in binaries}
    if any(len(v) > 2 for v in values.values()):
        raise ValueError("a binary attribute has two values at most")
    cells = sampling.full_histogram(rows, list(binaries), values)
    key = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in binaries])
    noisy = cells.select(key.alias("value"), F.greatest(F.col("n") + F.lit(float(settings.sigma_first)) * rng.normal(settings.seed, "joint", key), F.lit(0.0)).alias("noisy"))
    start = sampling.draw(true.sparkSession.range(n).withColumnRenamed("id", "tid"), sampling.distribution(noisy), "joint_", settings.seed, "joint")
    kinds = dict(true.dtypes)
    start = start.select("tid", *[F.split("joint_", "\\|")[i].cast(kinds[c]).alias(c) for i, c in enumerate(binaries)])
    return constrained.synthesize(rows, dcs, toggled(weights), columns, n, settings, start), weights


def keyed_flow(true: DataFrame, dcs: Sequence[DenialConstraint], weights: Sequence[float], columns: Sequence[str], key: str, owned: Sequence[str], numeric: Sequence[str], bins: dict[str, int], settings: Settings = Settings(), n: int | None = None) -> DataFrame:
    """A key is drawn from its noisy histogram, what it determines is looked up, the other categories continue from there, and
    numbers are drawn independently from noisy bins and pasted by row number."""
    rows = true.select(*[F.col(f"`{c}`") for c in columns]).na.drop()
    n = rows.count() if n is None else n
    start = sampling.first_attribute(true.sparkSession, rows, key, n, settings.sigma_first, settings.seed).select("tid", key)
    for c in owned:
        start = constrained.hard_dependency(start, rows, c, [key], settings)
    categories = [c for c in columns if c not in numeric]
    inner = [(d, w) for d, w in zip(dcs, weights) if set(d.attributes) <= set(categories)]
    order = tuple(c for c in [key, *owned] if c in categories)
    made = constrained.synthesize(rows, [d for d, _ in inner], [w for _, w in inner], categories, n, replace(settings, sequence=None), start.select("tid", *order))
    ids = true.sparkSession.range(n).withColumnRenamed("id", "tid")
    for c in numeric:
        lo, hi = transform.bounds(rows, [c])[c]
        k = bins.get(c, 100)
        at = transform.binned(F.col(f"`{c}`").cast("double"), lo, hi, k).alias("value")
        cells = rows.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
        noise = rng.normal(settings.seed, f"bins.{c}", F.col("value")) * F.lit(float(settings.sigma_first))
        cells = cells.select("value", F.greatest(F.col("n") + noise, F.lit(0.0)).alias("noisy"))
        drawn = sampling.bin_uniform(ids, cells, c, lo, (hi - lo) / k, settings.seed, f"bins.{c}")
        made = transform.pasted(made, drawn.withColumn(c, transform.clipped(F.col(f"`{c}`"), lo, hi)))
    return made.select("tid", *[F.col(f"`{c}`") for c in columns])


def monotone_flow(made: DataFrame, true: DataFrame, within: str, by: str, value: str, bins: int = 50, settings: Settings = Settings(), dependent: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Numbers on top of a synthetic table: `by` from noisy bins, `value` never decreasing in it within `within`, and for each
    attribute of `dependent` one value for each combination of its keys (that of the first row)."""

    def proposals(rows: DataFrame, attr: str, name: str) -> DataFrame:
        lo, hi = transform.bounds(true, [attr])[attr]
        cells = true.filter(F.col(f"`{attr}`").isNotNull()).groupBy(transform.cut(F.col(f"`{attr}`").cast("double"), lo, hi, bins).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        noise = rng.normal(settings.seed, f"bins.{attr}", F.col("value")) * F.lit(float(settings.sigma_first))
        cells = cells.select("value", F.greatest(F.col("n") + noise, F.lit(0.0)).alias("noisy"))
        return sampling.bin_uniform(rows, cells, name, lo, (hi - lo) / bins, settings.seed, f"bins.{attr}")

    out = proposals(proposals(made, by, by), value, "drawn_").withColumn("again_", rng.uniform(settings.seed, f"again.{value}", F.col("tid")))
    lo, hi = transform.bounds(true, [value])[value]
    out = dependency.monotone_fill(out, [within], by, "drawn_", "again_", lo, hi, value).drop("drawn_", "again_")
    for attr, keys in (dependent or {}).items():
        out = dependency.first_of_key(proposals(out, attr, attr), keys, attr)
    return out
