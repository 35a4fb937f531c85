"""Filling attributes so that dependencies hold: the first row of a key decides, or bounds from rows before."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.dominance import BLOCK_ROWS, nearest_before
from tabloom.sources.shared import checkpoint


#: Numbers in one of the lists of `Steps`, at most.
LIST = 2048


class Steps:
    """Different numbers in order, each with its value, in short lists: a new one moves few others, however many there are."""

    def __init__(self):
        self.first, self.at, self.value = [], [], []

    def taken(self, x, lo: float, hi: float, make: Callable[[float, float], float]) -> float:
        """The value of x; a new x gets what `make` gives for the values next below and next above (`lo` and `hi` if there is none)."""
        if not self.first:
            self.first, self.at, self.value = [x], [[x]], [[make(lo, hi)]]
            return self.value[0][0]
        i = max(bisect.bisect_right(self.first, x) - 1, 0)
        at, value = self.at[i], self.value[i]
        j = bisect.bisect_left(at, x)
        if j < len(at) and at[j] == x:
            return value[j]
        high = value[j] if j < len(at) else self.value[i + 1][0] if i + 1 < len(self.at) else hi
        made = make(value[j - 1] if j else lo, high)
        at.insert(j, x)
        value.insert(j, made)
        self.first[i] = at[0]
        if len(at) > LIST:
            half = LIST // 2
            self.first.insert(i + 1, at[half])
            self.at.insert(i + 1, at[half:])
            self.value.insert(i + 1, value[half:])
            del at[half:], value[half:]
        return made


def first_of_key(df: DataFrame, keys: Sequence[str], value: str, tid: str = "tid", name: str | None = None) -> DataFrame:
    """Every row takes the value of the first row (by tid) of its key.

    The first rows are aggregated before the shuffle and joined back, so a key of very many rows is spread."""
    first = df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}_") for i, k in enumerate(keys)]).agg(F.min_by(F.col(f"`{value}`"), F.col(f"`{tid}`")).alias("first_"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}_"))
    return df.join(first, on).drop(*[f"k{i}_" for i in range(len(keys))]).withColumn(name or value, F.col("first_")).drop("first_")


def running_first(df: DataFrame, keys: Sequence[str], value: str, tid: str = "tid", name: str = "first") -> DataFrame:
    """The same as a window function."""
    over = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(tid).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.first(F.col(f"`{value}`")).over(over))


def nearest_earlier(df: DataFrame, keys: Sequence[str], by: str, value: str, tid: str = "tid", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As-of bounds of each row among the rows before it (by tid) with its keys: ``below`` is the value at the greatest `by` not
    above the row's, ``above`` that at the least `by` not below it; the earliest row wins ties; null if there is none, or if the row has no `by`.

    A key of very many rows is cut into blocks (`dominance.nearest_before`)."""
    ks = [f"k{i}_" for i in range(len(keys))]
    rows = df.select(F.col(f"`{tid}`").cast("long").alias("tid_"), *[F.col(f"`{k}`").alias(c) for k, c in zip(keys, ks)], F.col(f"`{by}`").alias("v_")).na.drop(subset=["tid_", "v_"])
    rows, out = checkpoint(rows), df
    values = df.select(F.col(f"`{tid}`").cast("long").alias("near"), F.col(f"`{value}`").alias("value_"))
    for name, descending in (("below", False), ("above", True)):
        found = nearest_before(rows, ks, descending, block_rows).join(values, "near").select(F.col("tid").alias("near_of_"), F.col("value_").alias(name))
        out = out.join(found, F.col(f"`{tid}`").cast("long") == F.col("near_of_"), "left").drop("near_of_")
    return out


def monotone_fill(df: DataFrame, keys: Sequence[str], by: str, drawn: str, again: str, lo: float, hi: float, name: str, tid: str = "tid") -> DataFrame:
    """`name` from proposals in `drawn`, never decreasing in `by` within the keys.

    Rows are taken by tid. A row whose `by` was seen takes the value given then; a proposal outside what earlier rows allow is
    replaced by the point at `again` (a uniform in [0, 1)) between the bounds. Earlier rows decide later ones, so a key is one sequence, streamed:
    a task keeps the different values of `by` of one key, never its rows."""
    kinds = dict(df.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, Steps()
        for batch in batches:
            out = []
            held = [batch.column(c).to_pylist() for c in keys]
            for i, (x, v, u) in enumerate(zip(*(batch.column(c).to_pylist() for c in (by, drawn, again)))):
                at = tuple("nan" if h[i] != h[i] else h[i] for h in held)
                if at != key:
                    key, known = at, Steps()
                v, u = math.nan if v is None else v, math.nan if u is None else u
                if x is None or x != x:  # bound by no row, and binds none
                    out.append(v if lo <= v <= hi else lo + u * (hi - lo))
                    continue
                out.append(known.taken(x, lo, hi, lambda low, high: v if low <= v <= high else low + u * (high - low)))  # noqa: B023
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", `{name}` double"
    by_key = [F.col(f"`{k}`") for k in keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    rows = df.repartition(parts, *by_key) if keys else df.repartition(1)
    return rows.sortWithinPartitions(*by_key, F.col(f"`{tid}`")).mapInArrow(scan, schema)


def repaired(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Repair a dependency after the fact: every row takes its key's commonest value (the smallest of equals)."""
    columns = [F.col(f"`{k}`").alias(f"k{i}_") for i, k in enumerate(keys)]
    sizes = df.groupBy(*columns, F.col(f"`{value}`").alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    names = [f"k{i}_" for i in range(len(keys))]
    most = sizes.groupBy(*names).agg(F.min(F.struct((-F.col("n_")).alias("n_"), "v_")).alias("m_")).select(*names, F.col("m_.v_").alias("best_"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}_"))
    return df.join(most, on).withColumn(value, F.col("best_")).select(*df.columns)
