"""k-way marginals and total variation distances, all attribute sets in one scan."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import transform
from tabloom.operators.profile import numeric_columns
from tabloom.sources.shared import checkpoint


def attribute_sets(columns: Sequence[str], k: int) -> list[tuple[str, ...]]:
    return list(itertools.combinations(columns, k))


def _grouped(df: DataFrame, sets: Sequence[Sequence[str]], *counts: F.Column) -> DataFrame:
    every = list(dict.fromkeys(c for s in sets for c in s))
    at = {c: f"a{i}" for i, c in enumerate(every)}
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(at[c]) for c in every], *[F.col(c) for c in ("is_synthetic",) if c in df.columns])
    out = rows.groupingSets([[F.col(at[c]) for c in s] for s in sets], *[F.col(at[c]) for c in every]).agg(*counts, F.grouping_id().alias("gid_"))
    name, cell = F.lit(None).cast("string"), F.array().cast("array<string>")
    for s in sets:
        gid = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s)
        name = F.when(F.col("gid_") == gid, F.lit(",".join(s))).otherwise(name)
        cell = F.when(F.col("gid_") == gid, F.array(*[F.col(at[c]) for c in s])).otherwise(cell)
    return out.withColumn("attrs", name).withColumn("cell", cell)


def marginals(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(attrs, cell, n): counts of every value combination of every set."""
    return _grouped(df, sets, F.count(F.lit(1)).alias("n")).select("attrs", "cell", "n")


def distances(both: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(attrs, tvd): half the sum of absolute differences of true and synthetic shares; a missing cell has share 0.

    `both` is a stacked table; shares are of each side's rows."""
    sizes = both.agg(F.count_if(~F.col("is_synthetic")).alias("nt"), F.count_if(F.col("is_synthetic")).alias("ns"))
    cells = _grouped(both, sets, F.count_if(~F.col("is_synthetic")).alias("t"), F.count_if(F.col("is_synthetic")).alias("s"))
    gap = F.abs(F.col("t") / F.nullif(F.col("nt"), F.lit(0)) - F.col("s") / F.nullif(F.col("ns"), F.lit(0)))
    return cells.join(F.broadcast(sizes)).groupBy("attrs").agg((F.sum(gap) / 2).alias("tvd"))


def lattice(both: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(size, attrs, cell, t, s): counts of the true and synthetic rows in every cell of every set of 1 to k attributes.

    Rows are read, and expanded, once, for the sets of k attributes; the cells of smaller sets are sums of cells of one larger set each."""
    counts = [F.count_if(~F.col("is_synthetic")).alias("t"), F.count_if(F.col("is_synthetic")).alias("s")]
    level = checkpoint(_grouped(both, attribute_sets(columns, k), *counts).select(F.lit(k).alias("size"), "attrs", "cell", "t", "s"))
    out = level
    for size in range(k - 1, 0, -1):
        below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for small in attribute_sets(columns, size):  # with the last attribute that it lacks, so that sets are spread over the larger ones
            more = [c for c in columns if c not in small][-1]
            below.setdefault(tuple(c for c in columns if c in small or c == more), []).append(small)
        parts = F.lit(None).cast("array<struct<attrs:string,cell:array<string>>>")
        for large, smaller in below.items():
            made = F.array(*[F.struct(F.lit(",".join(x)).alias("attrs"), F.array(*[F.col("cell")[large.index(c)] for c in x]).alias("cell")) for x in smaller])
            parts = F.when(F.col("attrs") == ",".join(large), made).otherwise(parts)
        rows = level.select(F.explode(parts).alias("x"), "t", "s").select("x.*", "t", "s")
        level = checkpoint(rows.groupBy("attrs", "cell").agg(F.sum("t").alias("t"), F.sum("s").alias("s")).select(F.lit(size).alias("size"), "attrs", "cell", "t", "s"))
        out = out.unionByName(level)
    return out


def lattice_report(true: DataFrame, synthetic: DataFrame, columns: Sequence[str], k: int, bins: int = 16) -> DataFrame:
    """(size, attrs, tvd) of every 1 to k attributes, from one pass over the tables."""
    cells = lattice(prepared(true, synthetic, columns, bins), columns, k)
    sizes = cells.filter(F.col("attrs") == columns[0]).agg(F.sum("t").alias("nt"), F.sum("s").alias("ns"))  # the cells of any one set hold all rows
    gap = F.abs(F.col("t") / F.nullif(F.col("nt"), F.lit(0)) - F.col("s") / F.nullif(F.col("ns"), F.lit(0)))
    return cells.join(F.broadcast(sizes)).groupBy("size", "attrs").agg((F.sum(gap) / 2).alias("tvd"))


def average(found: DataFrame) -> DataFrame:
    """(n_sets, avg_tvd)."""
    return found.agg(F.count(F.lit(1)).alias("n_sets"), F.avg("tvd").alias("avg_tvd"))


def prepared(true: DataFrame, synthetic: DataFrame, columns: Sequence[str], bins: int = 16, numeric: Sequence[str] | None = None) -> DataFrame:
    """Stacked tables made comparable: complete rows, the true types, synthetic numbers clipped to the true range, numbers in bins, text in lower case."""
    numbers = [c for c in (numeric if numeric is not None else numeric_columns(true)) if c in columns]
    others = [c for c in columns if c not in numbers]
    true = transform.complete_rows(transform.project(true, columns))
    synthetic = transform.complete_rows(transform.cast_like(transform.project(synthetic, columns), true))
    limits = transform.bounds(true, numbers) if numbers else {}

    def ready(df: DataFrame) -> DataFrame:
        df = transform.lower_cased(df, others)
        known = {c: v for c, v in limits.items() if v[0] is not None}
        return df.withColumns({c: transform.binned(transform.clipped(F.col(f"`{c}`").cast("double"), lo, hi), lo, hi, bins) for c, (lo, hi) in known.items()})

    return transform.stacked(ready(true), ready(synthetic))


def marginal_report(true: DataFrame, synthetic: DataFrame, columns: Sequence[str], k: int, bins: int = 16) -> DataFrame:
    """(attrs, tvd) of every k attributes."""
    return distances(prepared(true, synthetic, columns, bins), attribute_sets(columns, k))
