"""Domains, ranges and histograms of a table's attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans import sequence as seq
from tabloom.plans.constraint import DenialConstraint


def domain_sizes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(attr, size): exact distinct values (without null) of each column, in one job.

    Columns become (attr, value) rows which are made distinct before they are counted, so a large domain is spread."""
    columns = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("x")).select("x.attr", "x.value").filter("value is not null").distinct()
    found = values.groupBy("attr").agg(F.count(F.lit(1)).alias("size"))
    # one row for each column
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("attr"))
    return names.join(found, "attr", "left").select("attr", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attr, lo, hi) as doubles, in one scan."""
    aggregated = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(columns)])
    return aggregated.select(F.explode(rows).alias("x")).select("x.*")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]


def histogram(df: DataFrame, attr: str) -> DataFrame:
    """(value, n) of an attribute, nulls left out."""
    return df.select(F.col(f"`{attr}`").alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def domains(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    return {r[0]: r[1] for r in domain_sizes(df, columns).collect()}


def attribute_roles(df: DataFrame, dcs: Sequence[DenialConstraint], columns: Sequence[str]) -> dict[str, str]:
    numbers = [c for c in numeric_columns(df) if c in columns]
    bounds = {r[0]: (r[1], r[2]) for r in ranges(df, numbers).collect()} if numbers else {}
    return seq.roles({c: t for c, t in df.dtypes if c in columns}, bounds, dcs)


def attribute_sequence(df: DataFrame, dcs: Sequence[DenialConstraint], columns: Sequence[str], bins: dict[str, int] | None = None) -> list[str]:
    return seq.sequence(columns, dcs, domains(df, columns), bins)


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_keys): rows, and distinct values of a key."""
    groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
