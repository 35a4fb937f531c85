"""Weights of soft constraints, from the violations of sampled rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions import rng
from tabloom.operators.sampling import ranked
from tabloom.operators.violations import violation_matrix
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.shared import checkpoint


def learning_rate(step: int, steps: int, top: float) -> float:
    """Cosine annealing from `top` to 0."""
    return top / 2 * (1 + math.cos(math.pi * step / steps))


def noisy_matrix(matrix: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """(tid, dc, n) with Gaussian noise, clipped at 0."""
    key = F.concat_ws("|", F.col("tid").cast("string"), F.col("dc").cast("string"))
    return matrix.withColumn("n", F.greatest(F.col("n") + F.lit(float(sigma)) * rng.normal(seed, "matrix", key), F.lit(0.0)))


def matrix_sensitivity(rows: int, constraints: int) -> float:
    """How far the violation matrix moves (Euclidean) if one row is exchanged: in each constraint's column its own count by at most rows - 1, and every other count by one."""
    return math.sqrt(constraints * (rows * rows - rows))


def matrix_sigma(rows: int, constraints: int, epsilon: float, delta: float) -> float:
    """Noise of a release of the whole violation matrix."""
    return matrix_sensitivity(rows, constraints) * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def skip_batches(spark: SparkSession, steps: int, rate: float, rows: int, seed: int = 0, stream: str = "skip") -> DataFrame:
    """(step, rank): the rows, by rank from 0, of a Poisson batch for each step, each row with probability `rate` on its own.

    Distances from one chosen row to the next are geometric, so the work is that of the rows that are chosen, not of all rows in all steps."""
    if not 0 < rate < 1:
        every = spark.range(steps).select(F.col("id").cast("int").alias("step"))
        return every.select("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("rank")) if rate >= 1 and rows else every.filter("false").select("step", F.lit(0).cast("long").alias("rank"))
    mean, most = rows * rate, 0
    most = int(mean + 10 * math.sqrt(mean) + 20)
    run = Window.partitionBy("step").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:  # until every step has passed the last row; the first number of gaps is nearly always enough
        each = spark.range(steps).select(F.col("id").cast("int").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("j"))
        u = rng.uniform(seed, stream, F.concat_ws("|", F.col("step").cast("string"), F.col("j").cast("string")))
        gap = F.floor(F.log(u) / F.lit(math.log1p(-rate))) + 1
        found = each.withColumn("rank", F.sum(gap).over(run) - 1)
        if (found.groupBy("step").agg(F.max("rank").alias("m")).agg(F.min("m")).first()[0] or 0) >= rows:
            return found.filter(F.col("rank") < rows).select("step", F.col("rank").cast("long").alias("rank"))
        most *= 2


def closed_form_skipping(matrix: DataFrame, steps: int, batch: int, rows: int, rate: float = 1e-4, seed: int = 0) -> DataFrame:
    """(dc, weight) as `closed_form`, with batches found by skipping: time grows with steps * batch, not steps * rows."""
    chosen = skip_batches(matrix.sparkSession, steps, batch / rows, rows, seed)
    # a row's whole factor is known before it meets its counts
    factors = chosen.withColumn("lr", F.lit(rate / 2) * (1 + F.cos(F.lit(math.pi) * F.col("step") / F.lit(float(steps))))).groupBy("rank").agg(F.sum("lr").alias("lr"))
    ids = ranked(matrix.select("tid").distinct()).withColumnRenamed("rank_", "rank")
    used = matrix.filter("n > 0").join(ids.join(factors, "rank").select("tid", "lr"), "tid").groupBy("dc").agg(F.sum(F.col("lr") * F.col("n")).alias("weight"))
    return matrix.select("dc").distinct().join(used, "dc", "left").select("dc", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def closed_form(matrix: DataFrame, steps: int, batch: int, rows: int, rate: float = 1e-4, seed: int = 0) -> DataFrame:
    """(dc, weight): the sum over steps of rate(step) * violations of the rows in the step's Poisson batch.

    The gradient of the linear loss is the violation count itself, so stochastic descent is this sum; a constraint's weight
    grows with its violations."""
    q = batch / rows
    rates = F.array(*[F.lit(learning_rate(s, steps, rate)) for s in range(steps)])
    spread = matrix.filter("n > 0").select("dc", "n", "tid", F.posexplode(rates).alias("step", "lr"))
    u = rng.uniform(seed, "batch", F.concat_ws("|", F.col("step").cast("string"), F.col("tid").cast("string")))
    used = spread.filter(u < F.lit(float(q))).groupBy("dc").agg(F.sum(F.col("lr") * F.col("n")).alias("weight"))
    every = matrix.select("dc").distinct()
    return every.join(used, "dc", "left").select("dc", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def likelihood(matrix: DataFrame, prior: float = 1.0) -> DataFrame:
    """(dc, weight): log-likelihood weights, larger for constraints that are violated less: log((rows + prior) / (violations + prior)), at least 0."""
    sums = matrix.groupBy("dc").agg(F.sum("n").alias("v"), F.count(F.lit(1)).alias("rows"))
    return sums.select("dc", F.greatest(F.log((F.col("rows") + F.lit(prior)) / (F.col("v") + F.lit(prior))), F.lit(0.0)).alias("weight"))


def learn_weights(df: DataFrame, dcs: Sequence[DenialConstraint], steps: int, batch: int, rate: float = 1e-4, sigma: float = 0.0, seed: int = 0, tid: str = "tid", mode: str = "closed_form") -> list[float]:
    """One weight for each constraint."""
    matrix = checkpoint(violation_matrix(df, dcs, tid))
    if sigma:
        matrix = noisy_matrix(matrix, sigma, seed)
    found = likelihood(matrix) if mode == "likelihood" else closed_form_skipping(matrix, steps, batch, df.count(), rate, seed)
    by = {r[0]: float(r[1]) for r in found.collect()}
    return [by.get(i, 0.0) for i in range(len(dcs))]
