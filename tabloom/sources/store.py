"""Tables kept in the shared folder under a digest of what they were made from, so that a run that was ended goes on where it was."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.shared import shared_folder


def content(df: DataFrame) -> tuple[int, int, int]:
    """(rows, and two sums over hashes of them): the same for any order and partitioning of the rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    found = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).first()
    return tuple(int(x or 0) for x in found)


class Store:
    """Tables by what they were made from. A table counts once Spark has committed it as a whole; what a killed run left half-written is overwritten."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/store"

    def path(self, made_from: dict[str, Any]) -> str:
        return f"{self.folder}/{hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()}"

    def holds(self, made_from: dict[str, Any]) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(made_from) + "/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def get(self, made_from: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
        """The table made from this: read, if it is held, else made and written."""
        path = self.path(made_from)
        if not self.holds(made_from):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
