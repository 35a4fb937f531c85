"""Noisy histograms and draws from them, keyed by row so that every partitioning gives the same draw."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabloom.functions import rng
from tabloom.operators.profile import histogram
from tabloom.sources.shared import checkpoint

#: Intervals of the unit range by which draws meet the distribution they fall into.
BUCKETS = 1024


def noisy_histogram(df: DataFrame, attr: str, sigma: float = 0.0, seed: int = 0, kind: str = "gauss", domain: Sequence | None = None) -> DataFrame:
    """(value, n, noisy): independent noise for each value, clipped at 0. sigma is the scale for kind 'laplace'.

    With the public `domain`, each of its values gets noise, whether it occurs or not, and no other value is told; without, which values occur is told."""
    noise = rng.normal(seed, f"hist.{attr}", F.col("value")) * F.lit(float(sigma)) if kind == "gauss" else rng.laplace(seed, f"hist.{attr}", F.col("value"), float(sigma))
    counts = histogram(df, attr)
    if domain is not None:
        every = df.sparkSession.createDataFrame([(v,) for v in domain], f"value {dict(df.dtypes)[attr]}")
        counts = every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return counts.withColumn("noisy", F.greatest(F.col("n") + noise, F.lit(0.0)) if sigma else F.col("n").cast("double"))


def full_histogram(df: DataFrame, columns: Sequence[str], domains: dict[str, Sequence[object]]) -> DataFrame:
    """Counts of every combination of the given domains, 0 where there is no row; the domains are small and given."""
    cells = df.sparkSession.range(1).drop("id")
    for c in columns:
        cells = cells.withColumn(c, F.explode(F.array(*[F.lit(v) for v in domains[c]])))
    found = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(found, list(columns), "left").select(*columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def permuted(i: F.Column, half: int, seed: int, rounds: int = 6) -> F.Column:
    """A keyed permutation of the numbers below 4 ** half (a Feistel network)."""
    low = F.lit((1 << half) - 1).cast("long")
    halves = F.struct(F.shiftright(i, half).alias("l"), i.bitwiseAND(low).alias("r"))
    turn = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], k, F.lit(seed)).bitwiseAND(low)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), halves, turn, lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))


@F.pandas_udf(DoubleType())
def _upper_quantile(q: pd.Series) -> pd.Series:
    """The standard normal's value that is exceeded with probability q."""
    inverse = NormalDist().inv_cdf
    return -q.map(inverse)


def _numbered(df: DataFrame, at: int, column: str, domain: Sequence) -> DataFrame:
    """With ``i{at}_``: the number of the column's value in its domain; rows of other values go."""
    if isinstance(domain, range):
        x = F.col(f"`{column}`").cast("long")
        i = F.floor((x - F.lit(domain.start)) / F.lit(domain.step)).cast("long")
        return df.withColumn(f"i{at}_", i).filter((F.col(f"i{at}_") >= 0) & (F.col(f"i{at}_") < len(domain)) & ((x - F.lit(domain.start)) % F.lit(domain.step) == 0))
    known = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(domain)], f"i{at}_ long, w{at}_ {dict(df.dtypes)[column]}")
    return df.join(known, F.col(f"`{column}`") == F.col(f"w{at}_")).drop(f"w{at}_")


def sparse_private_histogram(df: DataFrame, domains: Mapping[str, Sequence], sigma: float, threshold: float, seed: int = 0) -> DataFrame:
    """(columns..., noisy): what is left if every cell of the domains' product gets normal noise of scale `sigma` and only cells of `threshold` or more are told.

    Cells that hold rows are noised one by one. Of the empty ones, each passes with the same small probability: how many pass is one binomial draw, which ones is told by a keyed permutation of all
    cells (the first that are empty), and their noise comes from the normal's tail. So the result has exactly the law of noising
    all cells, while the work is that of the rows and of the cells told, whatever the size of the domain (up to 2 ** 60 cells). Domains are sequences, or ranges of whole numbers; values outside don't count."""
    spark, columns = df.sparkSession, list(domains)
    sizes = [len(domains[c]) for c in columns]
    cells = math.prod(sizes)
    if cells > 1 << 60 or sigma <= 0 or cells == 0:
        raise ValueError("needs noise and between 1 and 2 ** 60 cells")
    strides = [math.prod(sizes[k + 1 :]) for k in range(len(sizes))]
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    for k, c in enumerate(columns):
        rows = _numbered(rows, k, c, domains[c])
    cell = sum((F.col(f"i{k}_") * F.lit(stride).cast("long") for k, stride in enumerate(strides)), F.lit(0).cast("long"))
    held = checkpoint(rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    occupied = held.count()
    told = held.select("cell", (F.col("n") + F.lit(float(sigma)) * rng.normal(seed, "sparse", F.col("cell"))).alias("noisy")).filter(F.col("noisy") >= threshold)
    passes = 0.5 * math.erfc(threshold / sigma / math.sqrt(2))
    survivors = int(np.random.default_rng([seed & (1 << 63) - 1, 0x5A]).binomial(cells - occupied, passes))
    half = max(1, -(-(cells - 1).bit_length() // 2))
    take = int(1.1 * (survivors + occupied) * (4**half / cells)) + 1000
    while True:
        take = min(take, 4**half)
        empty = spark.range(take).select("id", permuted(F.col("id"), half, seed).alias("cell")).filter(F.col("cell") < cells).join(held.select("cell"), "cell", "left_anti")
        empty = checkpoint(empty)
        if take == 4**half or empty.count() >= survivors:
            break
        take *= 2
    u = rng.uniform(seed, "sparse.tail", F.col("cell"))
    risen = ranked(empty, "id").filter(F.col("rank_") < survivors).select("cell", (F.lit(float(sigma)) * _upper_quantile(F.lit(passes) * u)).alias("noisy"))
    out = told.unionByName(risen)
    for k, (c, size, stride) in enumerate(zip(columns, sizes, strides)):
        out = out.withColumn(f"i{k}_", F.expr(f"(cell div {stride}L) % {size}L"))
        if isinstance(domains[c], range):
            out = out.withColumn(c, (F.lit(domains[c].start) + F.lit(domains[c].step) * F.col(f"i{k}_")).cast(dict(df.dtypes)[c]))
        else:
            out = out.join(spark.createDataFrame([(i, v) for i, v in enumerate(domains[c])], f"i{k}_ long, `{c}` {dict(df.dtypes)[c]}"), f"i{k}_")
    return out.select(*[F.col(f"`{c}`") for c in columns], "noisy")


def distribution(weights: DataFrame, value: str = "value", weight: str = "noisy", in_one: int = 100_000) -> DataFrame:
    """(value, p, lo, hi): shares and their running sums by value.

    A domain of at most `in_one` values is summed in one task; a larger one in ranges of values, between bounds taken
    from the domain itself, whose sums (one row for each range) are added up first."""
    total = weights.agg(F.sum(weight).alias("total_"))
    shares = weights.join(F.broadcast(total)).filter("total_ > 0").select(F.col(value).alias("value"), (F.col(weight) / F.col("total_")).alias("p")).filter("p > 0")
    size = shares.count()
    if size <= in_one:
        shares = shares.withColumn("range_", F.lit(0))
    else:
        picked = [r[0] for r in shares.orderBy(F.xxhash64("value"), "value").limit(min(1000, size // in_one + 1)).select("value").collect()]
        bounds = F.array(*[F.lit(v) for v in sorted(picked)])
        shares = shares.withColumn("range_", F.size(F.filter(bounds, lambda x: x <= F.col("value"))))
    by, all_ = Window.partitionBy("range_").orderBy("value"), Window.orderBy("range_")
    sums = shares.groupBy("range_").agg(F.sum("p").alias("sum_"))
    sums = sums.select(F.col("range_").alias("r_"), F.coalesce(F.sum("sum_").over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base_"))
    upto = F.col("base_") + F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = shares.join(F.broadcast(sums), F.col("range_") == F.col("r_")).withColumn("hi", upto).drop("base_", "r_")
    # a range begins where the one before it ends, to the last bit; the very last is open-ended, whatever rounding leaves
    ends = out.groupBy("range_").agg(F.max("hi").alias("end_"))
    ends = ends.select(F.col("range_").alias("r_"), F.coalesce(F.lag("end_").over(all_), F.lit(0.0)).alias("from_"), F.lead("end_").over(all_).isNull().alias("last_"))
    out = out.join(F.broadcast(ends), F.col("range_") == F.col("r_"))
    out = out.withColumn("lo", F.coalesce(F.lag("hi").over(by), F.col("from_"))).withColumn("final_", F.col("last_") & F.lead("value").over(by).isNull())
    return out.select("value", "p", "lo", F.when(F.col("final_"), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))


def draw(rows: DataFrame, dist: DataFrame, name: str, seed: int, stream: str, tid: str = "tid") -> DataFrame:
    """`rows` with the column `name`: the value whose interval [lo, hi) holds the row's uniform. An equi-join on buckets of the unit range."""
    last = F.least(F.floor(F.col("hi") * BUCKETS), F.lit(BUCKETS - 1))
    spread = dist.withColumn("b_", F.explode(F.sequence(F.least(F.floor(F.col("lo") * BUCKETS), F.lit(BUCKETS - 1)), last))).select(F.col("value").alias(name), "lo", "hi", "b_")
    keyed = rows.withColumn("u_", rng.uniform(seed, stream, F.col(f"`{tid}`"))).withColumn("b_", F.floor(F.col("u_") * BUCKETS))
    return keyed.join(spread, "b_").filter((F.col("u_") >= F.col("lo")) & (F.col("u_") < F.col("hi"))).drop("b_", "u_", "lo", "hi")


def conditional_draw(rows: DataFrame, cells: DataFrame, parents: Sequence[str], name: str, seed: int, stream: str, tid: str = "tid") -> DataFrame:
    """`rows` with the column `name`, drawn from the shares (parents..., val, p) of the row's parents; null where they have none.

    Rows meet the cells in an equi-join on the parents and a bucket of the unit range, so a parent with very many rows is spread;
    the more parents there are, the fewer buckets each needs. Every value can be drawn, however rare."""
    keys = [f"k{i}_" for i in range(len(parents))]
    shares = cells.filter("p > 0").select(*[F.col(f"`{c}`").alias(k) for c, k in zip(parents, keys)], "val", "p")
    buckets = max(1, min(BUCKETS, 1_000_000 // max(1, shares.select(*keys).distinct().count()))) if keys else BUCKETS
    over = Window.partitionBy(*keys).orderBy("val")
    upto = shares.select(*keys, "val", F.sum("p").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("hi_"))
    dist = upto.select(*keys, F.col("val").alias(name), F.coalesce(F.lag("hi_").over(over), F.lit(0.0)).alias("lo_"), F.when(F.lead("val").over(over).isNull(), F.lit(2.0)).otherwise(F.col("hi_")).alias("hi_"))
    bucket = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1))
    dist = dist.withColumn("b_", F.explode(F.sequence(bucket(F.col("lo_")), bucket(F.col("hi_"))))).withColumnRenamed("b_", "db_")
    keyed = rows.withColumn("u_", rng.uniform(seed, stream, F.col(f"`{tid}`"))).withColumn("b_", bucket(F.col("u_")))
    on = (F.col("b_") == F.col("db_")) & (F.col("u_") >= F.col("lo_")) & (F.col("u_") < F.col("hi_"))
    for c, k in zip(parents, keys):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return keyed.join(dist, on, "left").drop("u_", "b_", "db_", "lo_", "hi_", *keys)


def first_attribute(spark: SparkSession, true: DataFrame, attr: str, n: int, sigma: float = 0.0, seed: int = 0, domain: Sequence | None = None) -> DataFrame:
    """(tid, attr): n rows drawn from the (noisy) histogram of the attribute, over its public domain if given."""
    rows = spark.range(n).withColumnRenamed("id", "tid")
    return draw(rows, distribution(noisy_histogram(true, attr, sigma, seed, domain=domain if sigma else None)), attr, seed, f"first.{attr}")


def bin_uniform(rows: DataFrame, bins: DataFrame, name: str, lo: float, width: float, seed: int, stream: str, tid: str = "tid") -> DataFrame:
    """Draw a bin from (value, noisy), then a point in it: lo + width * (bin + u)."""
    drawn = draw(rows, distribution(bins), "bin_", seed, f"{stream}.bin", tid)
    return drawn.withColumn(name, F.lit(float(lo)) + F.lit(float(width)) * (F.col("bin_") + rng.uniform(seed, f"{stream}.in", F.col(f"`{tid}`")))).drop("bin_")


def gaussian_mixture(true: DataFrame, attr: str, rows: DataFrame, k: int = 5, seed: int = 0, tid: str = "tid") -> DataFrame:
    """Numeric first attribute without privacy: draws from a fitted mixture of k normals."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["x_"], outputCol="features").transform(true.select(F.col(f"`{attr}`").cast("double").alias("x_")).na.drop())
    fitted = GaussianMixture(k=k, seed=seed).fit(points)
    parts = [(i, float(w), float(g.mean[0]), float(g.cov.toArray()[0][0]) ** 0.5) for i, (w, g) in enumerate(zip(fitted.weights, [r for r in fitted.gaussiansDF.collect()]))]
    dist = distribution(true.sparkSession.createDataFrame([(i, w) for i, w, _, _ in parts], "value int, noisy double"))
    drawn = draw(rows, dist, "part_", seed, f"gmm.{attr}", tid)
    mu, sd = (F.element_at(F.array(*[F.lit(p[j]) for p in parts]), F.col("part_") + 1) for j in (2, 3))
    return drawn.withColumn(attr, mu + sd * rng.normal(seed, f"gmm.{attr}.z", F.col(f"`{tid}`"))).drop("part_")


def subsample(df: DataFrame, n: int, seed: int, tid: str = "tid") -> DataFrame:
    """Exactly n rows (or all) without replacement: those of the smallest keyed uniforms."""
    u = rng.uniform(seed, "subsample", F.col(f"`{tid}`"))
    return df.withColumn("u_", u).orderBy("u_", tid).limit(n).drop("u_")


def ranked(df: DataFrame, tid: str = "tid", each: int = 100_000) -> DataFrame:
    """With ``rank_``: 0, 1, ... in the order of tid. Ranges of tid of about `each` rows are ranked apart, from the sizes of those before."""
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(tid), F.max(tid)).first()
    parts = max(1, -(-n // each))
    width = (hi - lo) // parts + 1 if n else 1
    rows = df.withColumn("part_", F.floor((F.col(tid) - F.lit(lo or 0)) / F.lit(width)).cast("long"))
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("part_").alias("p_"), F.coalesce(before, F.lit(0)).alias("before_"))
    out = rows.join(sizes, F.col("part_") == F.col("p_"))
    return out.withColumn("rank_", F.col("before_") + F.row_number().over(Window.partitionBy("part_").orderBy(tid)) - 1).drop("part_", "p_", "before_")


def upsample(df: DataFrame, n: int, seed: int, tid: str = "tid") -> DataFrame:
    """n rows with replacement; tid is numbered anew. Rows of the table are found by their rank in the order of tid."""
    size = df.count()
    rows = ranked(df, tid).drop(tid)
    wanted = df.sparkSession.range(n).withColumnRenamed("id", tid)
    wanted = wanted.withColumn("rank_", F.floor(rng.uniform(seed, "upsample", F.col(tid)) * size))
    return wanted.join(rows, "rank_").drop("rank_")


def poisson_batch(df: DataFrame, rate: float, seed: int, step: int, tid: str = "tid") -> DataFrame:
    """Each row independently with probability `rate`."""
    return df.filter(rng.uniform(seed, f"batch.{step}", F.col(f"`{tid}`")) < F.lit(float(rate)))


def keyed_split(df: DataFrame, share: float, seed: int, tid: str = "tid") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a keyed uniform."""
    u = rng.uniform(seed, "split", F.col(f"`{tid}`"))
    return df.filter(u < F.lit(float(share))), df.filter(u >= F.lit(float(share)))


def owner_draw(rows: DataFrame, true: DataFrame, key: str, owner: str, seed: int, tid: str = "tid") -> DataFrame:
    """Draw `key` given `owner` so that owner depends on key: each key belongs to the owner it occurs with most.

    A set-based stand-in for drawing keys again and again until an earlier row's owner fits."""
    pairs = true.groupBy(F.col(f"`{key}`").alias("k_"), F.col(f"`{owner}`").alias("o_")).agg(F.count(F.lit(1)).alias("n_"))
    best = pairs.groupBy("k_").agg(F.max(F.struct("n_", "o_")).alias("m_")).select("k_", F.col("m_.o_").alias("o_"), F.col("m_.n_").cast("double").alias("n_"))
    cells = best.select(F.col("o_").alias(owner), F.col("k_").alias("val"), (F.col("n_") / F.sum("n_").over(Window.partitionBy("o_"))).alias("p"))
    return conditional_draw(rows, cells, [owner], key, seed, f"owner.{key}", tid)
