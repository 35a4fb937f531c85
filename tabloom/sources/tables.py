"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; give a schema to spare the pass that infers one."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_tid(df: DataFrame, key: str | None = None) -> DataFrame:
    """With the row number `tid`: a key column, or else 0, 1, ... in the order of the files.

    Without a key the rows of each partition are counted first (one row for each partition), then numbered from the partition's start."""
    if key:
        return df.withColumn("tid", F.col(key).cast("long"))
    rows = df.withColumn("id_", F.monotonically_increasing_id())
    part, offset = F.shiftright("id_", 33), F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("before_"))
    return rows.join(F.broadcast(sizes), part == F.col("part_")).withColumn("tid", F.col("before_") + offset).drop("id_", "part_", "before_")


def save_table(df: DataFrame, path: str, kind: str = "parquet", columns: list[str] | None = None) -> None:
    """Parquet or CSV (with a header), with the columns in their first order."""
    out = df.select(*columns) if columns else df
    (out.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else out.write.mode("overwrite").parquet(path))


def output_name(data: str, epsilon: float | None, flags: dict[str, object]) -> str:
    """File name that tells the run's settings."""
    parts = [data, "nondp" if epsilon is None else f"eps{epsilon:g}"]
    return "_".join(parts + [f"{k}{int(v) if isinstance(v, bool) else v}" for k, v in sorted(flags.items())])


def load_view(df: DataFrame, name: str) -> DataFrame:
    """Named for SQL; read again by each query, unless the caller caches or checkpoints it."""
    df.createOrReplaceTempView(name)
    return df


def order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation, one row for each order; tid is the order's key."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    wide = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return wide.select(
        F.col("o_orderkey").alias("tid"), "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name",
        F.col("n_regionkey").alias("n_regionkey"), "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate",
    )


#: The same in SQL.
ORDER_WIDE_SQL = """wide AS (
  SELECT o_orderkey AS tid, c_custkey, c_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey, o_orderpriority, o_totalprice, o_orderstatus, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
