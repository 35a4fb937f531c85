"""A conditional model of an attribute given all earlier ones: multinomial logistic regression on hashed values.

Each earlier attribute of a row gives one feature: its value (a fraction: its bin), hashed into the attribute's slots. Training takes full passes over the table: every step sums the
rows' gradients on the executors, and only the sums, one for each weight, come back. With `sigma` each row's gradient is scaled to a norm of at most `clip` and the sums get normal noise, so a step is one
Gaussian release of sensitivity 2 * clip if a row is exchanged, and the accountant of the run counts it. The model's size is bounded (``MOST_WEIGHTS``), whatever the table's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tabloom.operators.transform import binned
from tabloom.sources.shared import checkpoint

#: Weights of a model (features times values of the target), slots of an attribute, bins of a fraction.
MOST_WEIGHTS, SLOTS, BINS = 1 << 22, 512, 16


@dataclass
class Fitted:
    """Values of the target, largest first, and a weight for each feature (the last is the bias) and value."""

    values: list
    weights: np.ndarray

    def shares(self, features: np.ndarray) -> np.ndarray:
        """Probability of each value, for rows of features."""
        z = self.weights[features].sum(1) + self.weights[-1]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


@dataclass(frozen=True)
class ConditionalLogistic:
    target: str
    parents: tuple[str, ...]
    steps: int = 25
    rate: float = 0.4
    clip: float = 1.0
    sigma: float = 0.0
    seed: int = 0
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def features(self, kinds: Mapping[str, str]) -> Column:
        """array<int> of a row: the slot of each earlier attribute's value."""
        out = []
        for j, c in enumerate(self.parents):
            x = F.col(f"`{c}`")
            if kinds[c] in ("double", "float"):
                x = binned(x.cast("double"), *self.bounds[c], BINS)
            out.append((F.pmod(F.xxhash64(F.lit(j), F.coalesce(x.cast("string"), F.lit(""))), F.lit(SLOTS)) + j * SLOTS).cast("int"))
        return F.array(*out)

    def values(self, true: DataFrame) -> list | None:
        """The target's domain, as given, else what occurs; None if the model would be too large."""
        most = MOST_WEIGHTS // (len(self.parents) * SLOTS + 1)
        if self.target in self.domains:
            found = list(self.domains[self.target])
        else:
            found = [r[0] for r in true.select(F.col(f"`{self.target}`")).na.drop().distinct().limit(most + 1).collect()]
        return sorted(found, reverse=True) if 0 < len(found) <= most else None

    def fit(self, true: DataFrame) -> Fitted | None:
        values = self.values(true)
        if values is None or not self.parents:
            return None
        kind = dict(true.dtypes)[self.target]
        labels = true.sparkSession.createDataFrame(list(enumerate(values)), f"y int, v_ {kind}")
        rows = checkpoint(true.join(F.broadcast(labels), F.col(f"`{self.target}`") == F.col("v_")).select("y", self.features(dict(true.dtypes)).alias("f")))
        n, width, many = max(1, rows.count()), len(self.parents) * SLOTS + 1, len(values)
        weights = np.zeros((width, many))
        m, s = np.zeros_like(weights), np.zeros_like(weights)
        noise = np.random.default_rng([self.seed & (1 << 63) - 1, 0x106])
        for step in range(1, self.steps + 1):
            grad = self._gradient(rows, Fitted(values, weights), self.clip if self.sigma else math.inf)
            if self.sigma:
                grad += noise.normal(0.0, self.sigma, grad.shape)
            grad /= n
            m, s = 0.8 * m + 0.2 * grad, 0.95 * s + 0.05 * grad * grad
            weights = weights - self.rate * (m / (1 - 0.8**step)) / (np.sqrt(s / (1 - 0.95**step)) + 1e-4)
        return Fitted(values, weights)

    def _gradient(self, rows: DataFrame, now: Fitted, clip: float) -> np.ndarray:
        """Sum over all rows of their gradients, each of a norm of at most `clip`."""
        shared = rows.sparkSession.sparkContext.broadcast(now)
        width, many = now.weights.shape
        schema = pa.schema([("at", pa.int32()), ("g", pa.float64())])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, model = np.zeros((width, many)), shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, f = batch.column(0).to_numpy(), batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)
                d = model.shares(f)
                d[np.arange(len(y)), y] -= 1.0
                d *= np.minimum(1.0, clip / np.maximum(np.linalg.norm(d, axis=1) * math.sqrt(f.shape[1] + 1), 1e-12))[:, None]
                for k in range(many):
                    total[:-1, k] += np.bincount(f.ravel(), np.repeat(d[:, k], f.shape[1]), width)[:-1]
                total[-1] += d.sum(0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], schema=schema)

        sums = rows.mapInArrow(partial, "at int, g double").groupBy("at").agg(F.sum("g").alias("g"))
        out = np.zeros(width * many)
        for at, g in sums.collect():  # one for each weight at most
            out[at] = g
        shared.destroy()
        return out.reshape(width, many)


def drawn(rows: DataFrame, features: Column, u: Column, fitted: Fitted, name: str, kind: str) -> DataFrame:
    """`rows` with the column `name`, drawn from the model's shares by the uniform `u`."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf(IntegerType())
    def pick(f: pd.Series, at: pd.Series) -> pd.Series:
        cdf = np.cumsum(shared.value.shares(np.stack(f.to_numpy())), axis=1)
        return pd.Series(np.minimum((cdf <= at.to_numpy()[:, None]).sum(1), cdf.shape[1] - 1).astype(np.int32))

    values = rows.sparkSession.createDataFrame(list(enumerate(fitted.values)), f"pick_ int, `{name}` {kind}")
    return rows.withColumn("pick_", pick(features, u)).join(F.broadcast(values), "pick_").drop("pick_")


def log_likelihood(rows: DataFrame, model: ConditionalLogistic, fitted: Fitted) -> float:
    """Mean natural log-likelihood of the target's values in `rows`; values that the model doesn't know don't count."""
    labels = rows.sparkSession.createDataFrame(list(enumerate(fitted.values)), f"y_ int, v_ {dict(rows.dtypes)[model.target]}")
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def told(f: pd.Series, y: pd.Series) -> pd.Series:
        p = shared.value.shares(np.stack(f.to_numpy()))
        return pd.Series(np.log(p[np.arange(len(y)), y.to_numpy()]))

    known = rows.join(F.broadcast(labels), F.col(f"`{model.target}`") == F.col("v_"))
    return known.select(told(model.features(dict(rows.dtypes)), F.col("y_")).alias("l")).agg(F.avg("l")).first()[0]
