"""Conditional models: what an attribute's value may be, given attributes generated before it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import rng
from tabloom.operators.transform import binned


def _named(columns: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in columns]


def domain_frame(true: DataFrame, attr: str, domains: Mapping[str, Sequence]) -> DataFrame:
    """One column, the attribute's domain: as given, else what occurs (which then counts as public)."""
    if attr in domains:
        kind = dict(true.dtypes)[attr]
        return true.sparkSession.createDataFrame([(v,) for v in domains[attr]], f"`{attr}` {kind}")
    return true.select(F.col(f"`{attr}`")).na.drop().distinct()


@dataclass(frozen=True)
class ConditionalHistogram:
    """Smoothed shares of a categorical target for each combination of its parents.

    With `sigma`, every cell of the parents' and the target's domains gets independent noise of that scale, empty cells
    included, and is clipped at 0; so the release tells no more than the noise allows. `alpha` is what each cell gets besides
    its count. A parent combination without cells falls back to the target's own histogram."""

    target: str
    parents: tuple[str, ...]
    sigma: float = 0.0
    alpha: float = 0.0
    seed: int = 0
    domains: Mapping[str, Sequence] = field(default_factory=dict)

    def fit(self, true: DataFrame) -> DataFrame:
        """(parents..., val, n, p)."""
        keys = _named(self.parents)
        cells = true.filter(F.col(f"`{self.target}`").isNotNull()).groupBy(*keys, F.col(f"`{self.target}`").alias("val")).agg(F.count(F.lit(1)).alias("n"))
        if self.sigma:
            every = domain_frame(true, self.target, self.domains).toDF("val")
            for c in self.parents:
                every = every.crossJoin(domain_frame(true, c, self.domains))  # the table of all cells is what is released
            cells = every.join(cells, [*self.parents, "val"], "left").select(*keys, "val", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
            key = F.concat_ws("|", *[c.cast("string") for c in keys], F.col("val").cast("string"))
            cells = cells.withColumn("w_", F.greatest(F.col("n") + F.lit(float(self.sigma)) * rng.normal(self.seed, f"cond.{self.target}", key), F.lit(0.0)))
        else:
            cells = cells.withColumn("w_", F.col("n").cast("double"))
        cells = cells.withColumn("w_", F.col("w_") + F.lit(float(self.alpha)))
        whole = Window.partitionBy(*keys)
        return cells.withColumn("p", F.col("w_") / F.nullif(F.sum("w_").over(whole), F.lit(0.0))).drop("w_")

    def candidates(self, fitted: DataFrame, top: int | None = 60) -> DataFrame:
        """(parents..., candidates): the `top` most likely values (all of them if None) by (p, value) descending, as array<struct<p, val>>."""
        kept = fitted.filter("p > 0")
        if top is not None:
            best = Window.partitionBy(*_named(self.parents)).orderBy(F.desc("p"), F.desc("val"))
            kept = kept.withColumn("r_", F.row_number().over(best)).filter(F.col("r_") <= top)
        return kept.groupBy(*_named(self.parents)).agg(F.sort_array(F.collect_list(F.struct("p", "val")), False).alias("candidates"))

    def best(self, fitted: DataFrame) -> DataFrame:
        """(parents..., val): the most likely value (the largest of equals)."""
        return fitted.filter("p > 0").groupBy(*_named(self.parents)).agg(F.max(F.struct("p", "val"))["val"].alias("val"))


@dataclass(frozen=True)
class ConditionalNormal:
    """Mean and standard deviation of a numeric target for each combination of its parents.

    With `sigma`, values are clipped to the public `bounds` and scaled to [0, 1]; the count, sum and sum of squares of every
    combination of the parents' domains get independent noise of that scale, and mean and deviation come from these alone."""

    target: str
    parents: tuple[str, ...]
    sigma: float = 0.0
    seed: int = 0
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    bounds: tuple[float, float] | None = None

    def fit(self, true: DataFrame) -> DataFrame:
        """(parents..., mu, sigma, n)."""
        x, keys = F.col(f"`{self.target}`").cast("double"), _named(self.parents)
        if not self.sigma:
            return true.groupBy(*keys).agg(F.avg(x).alias("mu"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("sigma"), F.count(x).alias("n"))
        if self.bounds is None:
            raise ValueError("a private normal needs public bounds")
        lo, width = float(self.bounds[0]), float(self.bounds[1] - self.bounds[0]) or 1.0
        y = F.least(F.greatest((x - F.lit(lo)) / F.lit(width), F.lit(0.0)), F.lit(1.0))
        sums = true.groupBy(*keys).agg(F.count(x).cast("double").alias("m0"), F.coalesce(F.sum(y), F.lit(0.0)).alias("m1"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("m2"))
        if self.parents:
            every = domain_frame(true, self.parents[0], self.domains)
            for c in self.parents[1:]:
                every = every.crossJoin(domain_frame(true, c, self.domains))
            sums = every.join(sums, list(self.parents), "left")
        key = F.concat_ws("|", F.lit(""), *[c.cast("string") for c in keys])
        for m in ("m0", "m1", "m2"):
            sums = sums.withColumn(m, F.coalesce(F.col(m), F.lit(0.0)) + F.lit(float(self.sigma)) * rng.normal(self.seed, f"normal.{self.target}.{m}", key))
        n = F.greatest(F.col("m0"), F.lit(1.0))
        mean = F.least(F.greatest(F.col("m1") / n, F.lit(0.0)), F.lit(1.0))
        deviation = F.sqrt(F.least(F.greatest(F.col("m2") / n - mean * mean, F.lit(0.0)), F.lit(0.25)))
        return sums.select(*keys, (F.lit(lo) + F.lit(width) * mean).alias("mu"), (F.lit(width) * deviation).alias("sigma"), F.col("m0").alias("n"))


def page(candidates: F.Column, attempt: int, size: int = 20) -> F.Column:
    """The candidates of one attempt: ranks [size * attempt, size * (attempt + 1))."""
    return F.slice(candidates, size * attempt + 1, size)


def best(candidates: F.Column) -> F.Column:
    """The most likely candidate's value (the largest of equals)."""
    return F.array_max(candidates)["val"]


def information_sensitivity(rows: int) -> float:
    """How much one row can change the mutual information of two attributes of any size (natural logarithm; Zhang et al. 2014)."""
    n = max(2, rows)
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))


def information(true: DataFrame, target: str, among: Sequence[str], bounds: tuple[float, float] | None = None, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """(attr, g): the mutual information of each attribute with the target (natural logarithm); all pairs are counted in one scan.

    What two independent attributes would show by chance is subtracted, else an attribute of very many values would
    always win. With `sizes` (of the public domains, the target's included) that depends on nothing in the table, so that exchanging a row moves g by no more than `information_sensitivity`; without,
    occupied values are counted. A numeric target is cut into 16 bins of its bounds (17 values, as the maximum is one of its own)."""
    at = {c: f"a{i}" for i, c in enumerate(among)}
    t = F.col(f"`{target}`") if bounds is None else binned(F.col(f"`{target}`").cast("double"), *bounds, 16)
    rows = true.select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in at.items()], t.cast("string").alias("t_")).na.drop()
    pairs = rows.select("t_", F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(a).alias("v")) for c, a in at.items()])).alias("x"))
    cells = pairs.groupBy("x.attr", "x.v", "t_").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_value, by_target = (cells.groupBy("attr", k).agg(F.sum("n").alias("s")) for k in ("v", "t_"))
    # sum of n log n over cells, values and target values gives all three entropies
    terms = [(cells, "n", "joint"), (by_value, "s", "value"), (by_target, "s", "target")]
    sums = [d.groupBy("attr").agg(F.sum(F.col(c) * F.log(c)).alias(f"{k}_h"), F.count(F.lit(1)).alias(f"{k}_m"), F.sum(c).alias(f"{k}_n")) for d, c, k in terms]
    told = sums[0].join(sums[1], "attr").join(sums[2], "attr")
    n, values, targets = F.col("joint_n"), F.col("value_m"), F.col("target_m")
    if sizes is not None:
        values, targets = F.element_at(F.create_map(*[x for c in among for x in (F.lit(c), F.lit(int(sizes[c])))]), F.col("attr")), F.lit(17 if bounds is not None else int(sizes[target]))
    return told.select("attr", ((F.col("joint_h") - F.col("value_h") - F.col("target_h")) / n + F.log(n) - (values - 1) * (targets - 1) / (2 * n)).alias("g"))


def most_informative(true: DataFrame, target: str, among: Sequence[str], sigma: float = 0.0, seed: int = 0, bounds: tuple[float, float] | None = None, sizes: Mapping[str, int] | None = None) -> str | None:
    """The attribute that tells most about the target; None if none tells more than chance would. With `sigma`, each
    attribute's information gets noise of that scale before the highest is taken, and the sizes of the public domains must be given."""
    if not among:
        return None
    if sigma and sizes is None:
        raise ValueError("a private choice needs the sizes of the public domains")
    told = information(true, target, among, bounds, sizes)
    if sigma:
        told = told.withColumn("g", F.col("g") + F.lit(float(sigma)) * rng.normal(seed, f"parent.{target}", F.col("attr")))
    found = told.filter("g > 0").orderBy(F.desc("g"), "attr").first()
    return found[0] if found else None
