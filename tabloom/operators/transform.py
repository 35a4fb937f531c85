"""Row-wise preparation: scaling, bins, clipping, grouping attributes and rare values, one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import rng


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=[f"`{c}`" for c in columns] if columns else None)


def bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Range of each numeric column, in one job; a row of 2 * len(columns) numbers comes to the driver."""
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in columns for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def binned(x: Column, lo: float, hi: float, bins: int) -> Column:
    """floor((x - lo) / width): the maximum falls into bin `bins`, so there are bins + 1; a range of no width is bin 0."""
    width = (hi - lo) / bins
    return F.lit(0).cast("int") if width == 0 else F.floor((x - F.lit(float(lo))) / F.lit(float(width))).cast("int")


def cut(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Right-closed bins 0 .. bins - 1; the minimum belongs to the first."""
    width = (hi - lo) / bins
    return F.lit(0).cast("int") if width == 0 else F.greatest(F.ceil((x - F.lit(float(lo))) / F.lit(float(width))) - 1, F.lit(0)).cast("int")


def scaled(x: Column, lo: float, hi: float) -> Column:
    return F.lit(0.0) if hi == lo else (x - F.lit(float(lo))) / F.lit(float(hi - lo))


def positive(x: Column, labels: Sequence[object] | None = None, lo: float | None = None, hi: float | None = None) -> Column:
    """Binary target: membership of a label set, or lo <= x < hi."""
    return (x.isin(*labels) if labels is not None else (x >= F.lit(lo)) & (x < F.lit(hi))).cast("int")


def lower_cased(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.col(f"`{c}`").cast("string")) for c in columns})


def cast_like(df: DataFrame, other: DataFrame) -> DataFrame:
    """With the column types of another table of the same columns (in any order)."""
    if set(df.columns) != set(other.columns):
        raise ValueError("the tables differ in their columns")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in other.schema.fields])


def concatenated(df: DataFrame, columns: Sequence[str], name: str, sep: str = "_") -> DataFrame:
    """One attribute instead of several."""
    joined = F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in columns])
    return df.withColumn(name, joined).drop(*[c for c in columns if c != name])


def split_again(df: DataFrame, name: str, columns: Sequence[str], sep: str = "_") -> DataFrame:
    parts = F.split(F.col(f"`{name}`"), f"\\Q{sep}\\E")
    out = df.withColumns({c: parts[i] for i, c in enumerate(columns)})
    return out if name in columns else out.drop(name)


def generalised(df: DataFrame, within: str, columns: dict[str, str], key: str, least: int = 3) -> DataFrame:
    """Rare (within, key) pairs lose their values: column c becomes '{within}_{suffix}' where fewer than `least` rows share the pair."""
    sizes = df.groupBy(F.col(f"`{within}`").alias("w_"), F.col(f"`{key}`").alias("k_")).agg(F.count(F.lit(1)).alias("n_"))
    rows = df.join(sizes, F.col(f"`{within}`").eqNullSafe(F.col("w_")) & F.col(f"`{key}`").eqNullSafe(F.col("k_")))
    rare = F.col("n_") < least
    out = rows.withColumns({c: F.when(rare, F.concat(F.col(f"`{within}`").cast("string"), F.lit(f"_{s}"))).otherwise(F.col(f"`{c}`").cast("string")) for c, s in columns.items()})
    return out.select(*df.columns)


def restored(df: DataFrame, true: DataFrame, within: str, column: str, suffix: str, tid: str = "tid", seed: int = 0) -> DataFrame:
    """Placeholders become a random true value of the same `within` (by a keyed index into its sorted values)."""
    values = true.select(F.col(f"`{within}`").alias("w_"), F.col(f"`{column}`").cast("string").alias("v_")).filter("v_ is not null").distinct()
    ranked = values.withColumn("i_", F.row_number().over(Window.partitionBy("w_").orderBy("v_")) - 1)
    sizes = values.groupBy("w_").agg(F.count(F.lit(1)).alias("n_"))
    marked = df.join(sizes, F.col(f"`{within}`") == F.col("w_"), "left").drop("w_")
    holds = F.col(f"`{column}`") == F.concat(F.col(f"`{within}`").cast("string"), F.lit(f"_{suffix}"))
    index = F.floor(rng.uniform(seed, f"restore.{column}", F.col(f"`{tid}`")) * F.col("n_")).cast("int")
    marked = marked.withColumn("at_", F.when(holds, index))
    ranked = ranked.withColumnsRenamed({"i_": "j_"})
    out = marked.join(ranked, (F.col(f"`{within}`") == F.col("w_")) & (F.col("at_") == F.col("j_")), "left")
    return out.withColumn(column, F.when(holds, F.coalesce("v_", F.col(f"`{column}`"))).otherwise(F.col(f"`{column}`"))).select(*df.columns)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each given value, named '{column}_{value}' with blanks, brackets and < as _."""
    clean = lambda v: "".join("_" if c in " []<" else c for c in f"{column}_{v}")
    return df.withColumns({clean(v): F.coalesce((F.col(f"`{column}`").cast("string") == v).cast("int"), F.lit(0)) for v in values})


def stacked(true: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both tables in one, told apart by is_synthetic; columns of both must agree."""
    if set(true.columns) != set(synthetic.columns):
        raise ValueError("the tables differ in their columns")
    return true.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic.withColumn("is_synthetic", F.lit(True)))


def unstacked(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(both.filter(F.col("is_synthetic") == flag).drop("is_synthetic") for flag in (False, True))


def training_rows(true: DataFrame, synthetic: DataFrame, done: Sequence[str], target: str) -> DataFrame:
    """True rows with the attributes done and the target, and synthetic rows whose target is still empty."""
    kind = dict(true.dtypes)[target]
    known = project(true, [*done, target])
    return stacked(known, project(synthetic, done).withColumn(target, F.lit(None).cast(kind)))


def pasted(left: DataFrame, right: DataFrame, tid: str = "tid") -> DataFrame:
    """Columns of two tables side by side, by row number."""
    return left.join(right, tid)
