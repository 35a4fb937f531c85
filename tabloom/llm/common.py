"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.sources.shared import checkpoint  # noqa: F401  (used by the operators)

#: Rows of text that a vectorised kernel takes at once; bounds a Python worker's memory.
KERNEL_BYTES = 4 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words a worker remembers before it starts its vocabulary afresh.
VOCABULARY = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parallelism(spark: SparkSession, size: int, each: int) -> int:
    """Shuffle partitions: those configured, or more if a partition would exceed `each` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the whole table (0 if empty)."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def slices(lengths: np.ndarray, most: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts sum to about `most` bytes; one long row may exceed it."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in binary.to_pylist()]


def text_slices(column: pa.Array, most: int = KERNEL_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) by bounded amounts of text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    lengths = np.nan_to_num(pa.compute.binary_length(column.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(float))
    for a, b in slices(lengths.astype(np.int64), most):
        yield a, b, raw_texts(column.slice(a, b - a))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; forgets all when it has grown past VOCABULARY."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(x: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each `width` consecutive values; empty if there are fewer."""
    if len(x) < width:
        return np.empty(0, np.uint64)
    out, have = None, 0
    power, size = x.astype(np.uint64, copy=False), 1
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, size
            else:
                n = len(x) - have - size + 1
                mult = np.uint64(pow(factor, size, 1 << 64))
                out, have = power[:n] + out[size : size + n] * mult, have + size
        rest >>= 1
        if rest:
            n = len(power) - size
            power, size = power[:n] + power[size : size + n] * np.uint64(pow(factor, size, 1 << 64)), size * 2
    return out[: len(x) - width + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def row_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def window_mask(counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which window starts over concatenated rows lie within one row."""
    ok = np.zeros(max(0, n), bool)
    starts = row_starts(counts)
    for a, c in zip(starts[:-1], counts):
        if c >= width:
            ok[a : a + c - width + 1] = True
    return ok


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def map_texts(docs: DataFrame, keep: list[str], added: str, kernel: Callable[[], Callable[[list[bytes], pa.RecordBatch], dict]], column: str = "text", most: int = KERNEL_BYTES) -> DataFrame:
    """`keep` columns of `docs` and the columns that a kernel makes of the whole texts, about `most` bytes at a time.

    `kernel()` is called once a task; what it returns gets the texts as UTF-8 bytes (null: empty) and their rows
    (the text last), and returns a list or array for each added column. A kept column of an added one's name is
    replaced. Sets Spark's bound on the bytes of an Arrow batch for the session to BATCH_BYTES: batches of whole texts are what these tasks hold besides their kernels."""
    docs.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    keep = [c for c in keep if c not in StructType.fromDDL(added).names]
    kept = docs.select(*keep).schema
    schema = StructType(kept.fields + StructType.fromDDL(added).fields)
    names = StructType.fromDDL(added).names
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b, raw in text_slices(texts, most):
                made = f(raw, batch.slice(a, b - a))
                columns = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(made[n], type=arrow.field(n).type) for n in names], schema=arrow)
        del f
        pa.default_memory_pool().release_unused()  # the worker waits for its next task beside others

    return docs.select(*keep, F.col(column).alias("tabloom_text_")).mapInArrow(run, schema)
