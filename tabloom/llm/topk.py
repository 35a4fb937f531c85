"""Exact top-k search by inner product: columnar branch and bound.

Component x of a vector becomes floor(64 * x). Vectors are stored vertically, dimension by dimension. For a
query, scores accumulate over one block of dimensions after another, the query's heaviest first; what a
candidate can still gain or lose is bounded by the norms of the remaining dimensions (Cauchy-Schwarz), and
candidates that cannot reach the k best any more are compacted away before the next block.

Queries and candidates are dealt into blocks of rows; each pair of a query block and a candidate block is
one unit of work, so that nothing is broadcast and memory is bounded whatever the sizes. Each unit returns at
most k rows a query, which a rank over (score, id) merges.

Defined results: a null vector, one with a null or non-finite component, and a row with a null id take no part.
Missing components of shorter vectors count as 0. Ties go to the smaller id. Rows that repeat an id are
separate candidates (but never of a query of that id); as queries, rows of equal id and vector are one query, and rows of one id but
different vectors are separate queries, each with its own k results. An empty table gives an empty result. If scores can exceed 2**53 they are summed
as 64-bit integers, which wrap as Java's do. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import table

K, EVERY, DIM_BLOCK = 20, 20, 16
#: Rows in a block of candidates and of queries.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 4096
PAIR = "query_id long, query_key long, vec_id long, score long"
_PAIR = pa.schema([(c, pa.int64()) for c in ("query_id", "query_key", "vec_id", "score")])


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * 64).cast("long")).alias("v"))


def dense(t: pa.Table, width: int = 0) -> np.ndarray:
    """(rows x dimensions) of a table's vectors."""
    lists = t.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K, block: int = DIM_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best candidates of each query."""
    norm = lambda x: np.sqrt((x.astype(float) ** 2).sum(1))
    exact = norm(q).max(initial=0) * norm(c).max(initial=0) < 2**52
    kind = np.float64 if exact else np.int64
    order = np.argsort(cid, kind="stable")
    cid, columns = cid[order], np.ascontiguousarray(c[order].T.astype(kind))  # vertical layout
    q = q.astype(kind)
    blocks = [slice(a, a + block) for a in range(0, q.shape[1], block)] or [slice(0, 0)]
    tail = [np.sqrt((columns[b].astype(float) ** 2).sum(0)) for b in blocks]  # norm of a candidate in each block
    found: tuple[list, list, list] = ([], [], [])
    for i in range(len(q)):
        mass = np.array([np.sqrt((q[i, b].astype(float) ** 2).sum()) for b in blocks])
        turn = np.argsort(-mass, kind="stable")
        alive = np.flatnonzero(cid != qid[i])
        score = np.zeros(len(alive), kind)
        for step, j in enumerate(turn):
            score = score + q[i, blocks[j]] @ (columns[blocks[j]] if len(alive) == len(cid) else columns[blocks[j]][:, alive])
            rest = turn[step + 1 :]
            if exact and len(rest) and len(alive) > 4 * k:
                slack = sum(mass[r] * tail[r][alive] for r in rest) * (1 + 1e-9) + 1e-6
                low = score - slack
                keep = score + slack >= np.partition(low, len(low) - k)[len(low) - k]
                if keep.mean() < 0.7:
                    alive, score = alive[keep], score[keep]
        if len(alive) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            sel = np.flatnonzero(score >= least)
            sel = sel[np.lexsort((cid[alive[sel]], -score[sel]))][:k]
            alive, score = alive[sel], score[sel]
        found[0].append(np.full(len(alive), i))
        found[1].append(cid[alive])
        found[2].append(score.astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised (id, v) rows of queries and candidates."""
    queries = queries.select("id", "v").dropDuplicates().withColumn("key", F.xxhash64("v"))
    nq, nc = max(1, math.ceil(queries.count() / query_rows)), max(1, math.ceil(candidates.count() / candidate_rows))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("qb", block(nq)).withColumn("cb", every(nc))
    right = candidates.withColumn("cb", block(nc)).withColumn("qb", every(nq))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        q, c = dense(a), dense(b)
        width = max(q.shape[1], c.shape[1])
        q, c = dense(a, width), dense(b, width)
        ids, keys = a.column("id").to_numpy(), a.column("key").to_numpy()
        row, vec, score = best_of(ids, q, b.column("id").to_numpy(), c, k) if len(q) and len(c) else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (ids[row], keys[row], vec, score)], schema=_PAIR)

    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(work, PAIR)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose vec_id is divisible by 20."""
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.filter(F.col("id") % EVERY == 0), vectors)


def oracle() -> str:
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
      SELECT q.vec_id AS query_id, q.v AS query, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
    """
