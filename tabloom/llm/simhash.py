"""Near duplicates by SimHash fingerprints, paired exactly through vantage points.

A text's fingerprint has bit j set if over half of its word shingles' 64-bit hashes have it set. Equal
fingerprints form a class; classes link if their fingerprints differ in at most ``RADIUS`` bits.

Classes are dealt into the shells around a few vantage points (fingerprints taken from the data): by the
triangle bound, two fingerprints within the radius lie at distances from any vantage point that differ by
no more than the radius, and all differences have the parity of their distance. So a class visits its own
shell and those boundary shells after it that can hold a partner. Within a shell a vantage-point tree
prunes branches by the same bound down to small leaves that are compared outright. A shell returns a
spanning forest of its links, not all pairs; components of the forests are those of all links. Shells of two
vantage points are dealt; only those that hold more than ``MAX_SHELL`` classes are split by two further points, and so on.

Defined results: null and empty texts have no words and fingerprint 0, linked like any other; texts with fewer
words than a shingle have their whole sequence as the only one. A null doc_id is never the name of a
component unless all of its ids are null. Repeated rows are one class. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import checkpoint, map_texts, table
from tabloom.llm.components import forest, stars

SHINGLE, RADIUS, SEED = 3, 2, 42
MAX_SHELL, MAX_POINTS, LEAF_PAIRS = 200_000, 12, 1 << 21
#: Shingle hashes whose bits are counted at once.
HASHES = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    hash_ = xxhash.xxh64_intdigest
    hashes, counts, size = [], [], 0

    def settle(first: int) -> None:
        at = np.concatenate([[0], np.cumsum(counts)])
        full = np.flatnonzero(np.diff(at))
        if len(full) == 1:  # it may be very long
            ones = sum(_bits(hashes[a : a + HASHES]).sum(0, dtype=np.int64) for a in range(0, len(hashes), HASHES))[None, :]
        elif len(full):
            ones = np.add.reduceat(_bits(hashes), at[:-1][full], axis=0, dtype=np.int32)
        else:
            return
        major = ones * 2 > np.diff(at)[full][:, None]
        out[first + full] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)

    first = 0
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if len(words) <= shingle:
            grams = [b" ".join(words)] if words else []
        else:
            grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)))]
        if size and size + len(grams) > HASHES:
            settle(first)
            hashes, counts, size, first = [], [], 0, i
        hashes += [hash_(g, SEED) for g in grams]
        counts.append(len(grams))
        size += len(grams)
        if size >= HASHES:
            settle(first)
            hashes, counts, size, first = [], [], 0, i + 1
    settle(first)
    return out


def fingerprint(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """`keep` columns with ``fp``: the fingerprint as a signed long."""
    return map_texts(docs, keep, "fp long", lambda: lambda raw, _: {"fp": fingerprints_of(raw, shingle).view(np.int64)})


def close_pairs(q: np.ndarray, c: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into q, into c) at Hamming distance `radius` or less, by a vantage-point tree over c."""
    todo = [(np.arange(len(q)), np.arange(len(c)), 0)]
    while todo:
        qi, ci, depth = todo.pop()
        if not len(qi) or not len(ci):
            continue
        if len(qi) * len(ci) <= LEAF_PAIRS or depth >= 24:
            step = max(1, LEAF_PAIRS // len(ci))
            for a in range(0, len(qi), step):
                part = qi[a : a + step]
                x, y = np.nonzero(np.bitwise_count(q[part][:, None] ^ c[ci][None, :]) <= radius)
                if len(x):
                    yield part[x], ci[y]
            continue
        point = c[ci[len(ci) // 2]]
        dc, dq = np.bitwise_count(c[ci] ^ point).astype(np.int16), np.bitwise_count(q[qi] ^ point).astype(np.int16)
        for shell in np.unique(dc):
            todo.append((qi[np.abs(dq - shell) <= radius], ci[dc == shell], depth + 1))


def shell_links(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between home fingerprints, and between them and visitors: (fp, root fp)."""
    fps, at = np.unique(fps, return_inverse=True)
    own = np.zeros(len(fps), bool)
    own[at[home]] = True
    ci = np.flatnonzero(own)
    root, held, n = np.arange(len(fps)), [], 0
    for x, y in close_pairs(fps, fps[ci], radius):
        held.append((x, ci[y]))
        n += len(x)
        if n >= 1 << 20:
            root = _merge(root, held)
            held, n = [], 0
    root = _merge(root, held)
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def _merge(root: np.ndarray, pairs: list) -> np.ndarray:
    a = np.concatenate([np.arange(len(root)), *(p[0] for p in pairs)])
    b = np.concatenate([root, *(p[1] for p in pairs)])
    return forest(len(root), a, b)


def _shell(points: list[int]) -> F.Column:
    return F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in points])


def _moves(n: int, radius: int) -> list[tuple[int, ...]]:
    """How the distances of two close fingerprints to n points may differ: all differences have the parity of their own distance."""
    return [m for m in itertools.product(range(-radius, radius + 1), repeat=n) if len({x % 2 for x in m}) == 1]


def _deal(rows: DataFrame, points: list[int], radius: int) -> DataFrame:
    """Rows (k, fp, home) with the distances to further points added to k, the shell.

    A fingerprint at home has one shell; of two shells the lower visits the higher. A visitor visits every shell it may have links in."""
    moves = _moves(len(points), radius)
    literal = lambda found: F.array(*[F.array(*[F.lit(x) for x in m]) for m in found])
    here = rows.withColumn("s", _shell(points))
    own = here.filter("home").select(F.concat("k", "s").alias("k"), "fp", "home")
    upward = literal([m for m in moves if m > (0,) * len(points)])
    visits = here.withColumn("move", F.explode(F.when(F.col("home"), upward).otherwise(literal(moves))))
    visits = visits.select(F.concat("k", F.zip_with("s", "move", lambda a, b: a + b)).alias("k"), "fp", F.lit(False).alias("home"))
    return own.unionByName(visits)


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints `fp`.

    Shells around the first two vantage points are dealt out; only those that hold more than ``MAX_SHELL`` are split by further points."""
    points = [r[0] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(MAX_POINTS).select("fp").collect()]
    if not points:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def search(t: pa.Table) -> pa.Table:
        fps, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b = shell_links(fps, home, radius) if home.any() else (np.zeros(0, np.uint64),) * 2
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = classes.select(F.array().cast("array<int>").alias("k"), "fp", F.lit(True).alias("home"))
    found = None
    for at in range(0, len(points), 2):
        rows = _deal(rows, points[at : at + 2], radius)
        large = rows.filter("home").groupBy("k").count().filter(F.col("count") > MAX_SHELL).select("k")
        if at + 2 < len(points) and not (large := checkpoint(large)).isEmpty():
            rows = checkpoint(rows)
            large = F.broadcast(large) if large.count() <= 100_000 else large
            done, rows = rows.join(large, "k", "left_anti"), rows.join(large, "k", "left_semi")
        else:
            done, rows = rows, None
        part = done.groupBy("k").applyInArrow(search, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if rows is None:
            break
    return found


def with_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`rows` (checkpointed; with doc_id and ``fp``) with ``component_id``, the smallest doc_id that each reaches (null if no row
    of the component has one), and ``root``, a fingerprint that names the component whatever its ids."""
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = stars(links(classes, radius))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "fp")
    members = members.join(classes, "fp")
    lowest = members.groupBy("root").agg(F.min("rep").alias("low"))
    members = members.join(lowest, "root").select("fp", "root", "low")
    named = classes.join(members.hint("merge"), "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(named.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: `keep` columns, ``fp`` (long), ``component_id`` and ``root``."""
    return with_components(checkpoint(fingerprint(docs, keep or ["doc_id"], shingle)), radius)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
