"""For every query, how many points come before it in several orders at once.

Each order cuts all rows into blocks of neighbours. A point that comes before a query in every order is in no later block in any of them, so each such pair is met
exactly once: in the first order in which both are in one block (where only numbers of blocks are compared for the orders
before it, and values for the others), or, if their blocks differ in every order, in a grid of blocks, by sums over cells. So rows are shuffled once for each order, no
block meets another block, and a task's work is m log^(k-1) m for blocks of m rows and k orders. The grid has at most ``CELLS`` cells, whatever the size of
the table: blocks grow beyond that.

Equal values need no care: a point stands behind an equal query if the order is strict, else before it, so every order is total, and
a value that very many rows share is spread over blocks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.sources.shared import checkpoint

#: Rows of a block, cells of the grid (one task holds them all).
BLOCK_ROWS, CELLS = 65_536, 1 << 21
#: Within a task: rows that are compared by sets of bits, cells of a grid for each row, and at most.
FEW, GRID_SHARE, GRID_CELLS = 8192, 32, 1 << 24


@dataclass(frozen=True)
class Order:
    """A point comes before a query if its value is smaller (larger, if `descending`) or, unless `strict`, equal."""

    descending: bool
    strict: bool


def dominated(qx: np.ndarray, rx: np.ndarray, qy: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """For each query the points with a smaller x and a smaller y.

    Points are sorted by x; a query's prefix splits into blocks of powers of two, which are sorted by y."""
    order = np.argsort(rx, kind="stable")
    ry = ry[order]
    prefix = np.searchsorted(rx[order], qx, "left")
    low = min(int(ry.min(initial=0)), int(qy.min(initial=0)))
    ry, qy = ry - low, qy - low
    big = max(int(ry.max(initial=0)), int(qy.max(initial=0))) + 2
    out, size, at = np.zeros(len(qx), np.int64), 1, np.arange(len(ry))
    while size <= len(ry):
        sel = np.flatnonzero(prefix & size)
        if len(sel):
            start = prefix[sel] // (2 * size) * (2 * size)
            blocks = np.sort(at // size * big + ry)
            out[sel] += np.searchsorted(blocks, start // size * big + qy[sel], "left") - start
        size *= 2
    return out


def count_before(points: Sequence[np.ndarray], queries: Sequence[np.ndarray]) -> np.ndarray:
    """For each query the points whose codes are all smaller."""
    if not len(points[0]) or not len(queries[0]):
        return np.zeros(len(queries[0]), np.int64)
    if len(points) == 1:
        return np.searchsorted(np.sort(points[0]), queries[0], "left").astype(np.int64)
    if len(points) == 2:
        return dominated(queries[0], points[0], queries[1], points[1])
    query = np.repeat([False, True], [len(points[0]), len(queries[0])])
    ranks = [np.unique(np.concatenate([p, q]), return_inverse=True) for p, q in zip(points, queries)]
    return _met([r for _, r in ranks], [len(known) for known, _ in ranks], query)[query]


def _order(codes: np.ndarray) -> np.ndarray:
    """As a stable argsort; code and row are one number, as numbers are sorted much faster than places of numbers. Codes are few times the rows."""
    bits = len(codes).bit_length()
    return np.sort(codes << bits | np.arange(len(codes))) & (1 << bits) - 1


def _places(codes: np.ndarray) -> np.ndarray:
    """Each row's place in the order of the codes."""
    out = np.empty(len(codes), np.int64)
    out[_order(codes)] = np.arange(len(codes))
    return out


def _few_met(codes: Sequence[np.ndarray], widths: Sequence[int], query: np.ndarray) -> np.ndarray:
    """`_met` for few rows: each order gives a query the set of the points before it, one bit for each point, and the sets are intersected."""
    points = np.flatnonzero(~query)
    bit = np.zeros((len(query), -(-len(points) // 64)), np.uint64)
    bit[points, np.arange(len(points)) >> 6] = np.uint64(1) << (np.arange(len(points)) & 63).astype(np.uint64)
    held = None
    for code, width in zip(codes, widths):
        order = _order(2 * code + ~query if width else code)
        lies = ~query[order]
        before = np.zeros((len(points) + 1, bit.shape[1]), np.uint64)
        np.bitwise_or.accumulate(bit[order[lies]], axis=0, out=before[1:])
        number = np.empty(len(query), np.int64)
        number[order] = np.cumsum(lies)
        sets = before[number[query]]
        held = sets if held is None else np.bitwise_and(held, sets, out=held)
    out = np.zeros(len(query), np.int64)
    out[query] = np.bitwise_count(held).sum(1, dtype=np.int64)
    return out


def _met(codes: Sequence[np.ndarray], widths: Sequence[int], query: np.ndarray) -> np.ndarray:
    """For each row that is a query the points that come before it in every order, as `counts_before` finds them: by blocks in each order and a grid.

    An order of width 0 has places, different for all rows; one of another width has numbers of blocks below it. An order of no more numbers than the grid
    has cells along it needs no blocks of its own, as a point of the same number is not before."""
    size, total, out = len(query), int(query.sum()), np.zeros(len(query), np.int64)
    if not total or total == size:
        return out
    if size <= FEW:
        return _few_met(codes, widths, query)
    room, cells, told = min(GRID_SHARE * size, GRID_CELLS), [0] * len(codes), sorted(range(len(codes)), key=lambda j: widths[j] or size)
    for n, j in enumerate(told):  # what narrow orders leave is shared by the others
        cells[j] = min(widths[j] or size, max(2, int(room ** (1 / (len(told) - n)))))
        room = max(1.0, room / cells[j])
    codes, blocks, wide = list(codes), [], []
    for j, n in enumerate(cells):
        if widths[j] and widths[j] <= n:
            blocks.append(codes[j])
            continue
        wide.append(j)
        codes[j] = _places(2 * codes[j] + ~query if widths[j] else codes[j])
        blocks.append(codes[j] * n // size)
    grid = np.zeros([n + 1 for n in cells], np.int32 if size < 1 << 31 else np.int64)
    np.add.at(grid, tuple(b[~query] + 1 for b in blocks), 1)
    for axis in range(len(cells)):
        np.cumsum(grid, axis=axis, out=grid)
    out[query] = grid[tuple(b[query] for b in blocks)]
    del grid
    for j in wide:
        order = _order(blocks[j])
        ends = np.searchsorted(blocks[j][order], np.arange(cells[j] + 1))
        kinds = [cells[i] if i < j or i not in wide else 0 for i in range(len(codes))]
        for a, b in zip(ends[:-1], ends[1:]):
            sel = order[a:b]
            out[sel] += _met([(codes if n == 0 else blocks)[i][sel] for i, n in enumerate(kinds)], kinds, query[sel])
    return out


def last_before(points: Sequence[np.ndarray], queries: Sequence[np.ndarray], least: np.ndarray | None = None) -> np.ndarray:
    """For each query the point of the largest second code among those whose both codes are smaller; -1 if there is none, or none whose second code is at least the query's `least`."""
    if not len(points[0]) or not len(queries[0]):
        return np.full(len(queries[0]), -1, np.int64)
    known, rank = np.unique(np.concatenate([points[0], queries[0]]), return_inverse=True)
    r, q = rank[: len(points[0])], rank[len(points[0]) :]
    low = min(int(points[1].min()), int(queries[1].min()))
    if least is not None:
        low = min(low, int(least.min()))
    y, z, floor = points[1] - low, queries[1] - low, (least - low if least is not None else np.zeros(len(q), np.int64))
    wide = max(int(y.max()), int(z.max())) + 1
    best, found, level = np.full(len(q), -1, np.int64), np.full(len(q), -1, np.int64), 0
    while len(known) > 1 << level:
        a, b = np.flatnonzero(~(r >> level) & 1), np.flatnonzero((q >> level) & 1)
        if len(a) and len(b):
            inside = (r[a] >> (level + 1)) * wide + y[a]
            order = np.argsort(inside, kind="stable")
            start = (q[b] >> (level + 1)) * wide
            at = np.searchsorted(inside[order], start + z[b], "left") - 1
            near = np.maximum(at, 0)
            code = np.where((at >= 0) & (inside[order][near] >= start + floor[b]), inside[order][near] - start, -1)
            better = code > best[b]
            best[b[better]], found[b[better]] = code[better], a[order][near[better]]
        level += 1
    return found


def _codes(values: np.ndarray, query: np.ndarray, order: Order) -> np.ndarray:
    code = 2 * np.unique(values, return_inverse=True)[1].astype(np.int64)
    return (-code if order.descending else code) + (query != order.strict)


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_COUNTS = pa.schema([("tid", pa.int64()), ("n", pa.int64())])


def _told(tid: np.ndarray, n: np.ndarray, per_row: bool) -> pa.Table:
    if per_row:
        sel = np.flatnonzero(n)
        return pa.table({"tid": tid[sel], "n": n[sel]}, schema=_COUNTS)
    return pa.table({"tid": np.zeros(1, np.int64), "n": np.array([n.sum()])}, schema=_COUNTS)


def counts_before(rows: DataFrame, keys: Sequence[str], orders: Sequence[Order], per_row: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tid, n): partial counts for each query of the points of its key that come before it; tid is 0 unless `per_row`.

    `rows` has `tid_`, `query_` (else it is a point), the `keys` and a value `v0_`, `v1_`, ... for each order; nothing in it is null."""
    keys, width = list(keys), len(orders)
    blocks = min(max(1, -(-rows.count() // block_rows)), int(CELLS ** (1 / width)))
    for i, order in enumerate(orders):
        if blocks == 1:
            rows = rows.withColumn(f"b{i}_", F.lit(0))
            continue
        value = F.col(f"v{i}_").desc() if order.descending else F.col(f"v{i}_").asc()
        role = F.col("query_").desc() if order.strict else F.col("query_").asc()
        # bounds of ranges are sampled, so the rows are written before anything is built on them
        rows = checkpoint(rows.repartitionByRange(blocks, *keys, value, role, "tid_").withColumn(f"b{i}_", F.spark_partition_id()))

    def within(i: int):
        def work(t: pa.Table) -> pa.Table:
            query = t.column("query_").to_numpy().astype(bool)
            if query.all() or not query.any():
                return _empty(_COUNTS)
            codes = [t.column(f"b{j}_").to_numpy().astype(np.int64) for j in range(i)]
            codes += [_codes(t.column(f"v{j}_").to_pandas().to_numpy(), query, orders[j]) for j in range(i, width)]
            return _told(t.column("tid_").to_numpy()[query], count_before([c[~query] for c in codes], [c[query] for c in codes]), per_row)

        return work

    parts = []
    for i in range(width if blocks > 1 else 1):
        held = rows.select(*keys, "tid_", "query_", *[f"b{j}_" for j in range(i + 1)], *[f"v{j}_" for j in range(i, width)])
        if blocks > 1:  # one block for each task: by a hash some tasks would get several
            held = held.repartitionById(blocks, f"b{i}_")
        parts.append(held.groupBy(*keys, f"b{i}_").applyInArrow(within(i), "tid long, n long"))
    if blocks > 1:
        parts.append(_grid(rows, keys, [f"b{i}_" for i in range(width)], per_row, blocks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grid(rows: DataFrame, keys: list[str], at: list[str], per_row: bool, blocks: int) -> DataFrame:
    """Pairs whose blocks differ in every order: each cell with queries sums the points of all cells below it in every order."""
    cells = rows.groupBy(*keys, *at).agg(F.count_if(F.col("query_")).alias("q_"), F.count_if(~F.col("query_")).alias("r_")).withColumn("one_", F.lit(0))

    def sums(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        where = tuple(np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in at)
        grid = np.zeros([int(w.max()) + 2 for w in where], np.int64)
        np.add.at(grid, tuple(w + 1 for w in where), t.column("r_").to_numpy())
        for axis in range(len(at)):
            np.cumsum(grid, axis=axis, out=grid)
        return grid[where], t.column("q_").to_numpy()

    if not per_row:

        def total(t: pa.Table) -> pa.Table:
            below, queries = sums(t)
            return _told(np.zeros(1, np.int64), below * queries, False)

        return cells.groupBy(*keys, "one_").applyInArrow(total, "tid long, n long")

    def told(t: pa.Table) -> pa.Table:
        below, queries = sums(t)
        return t.select([*keys, *at]).append_column("n", pa.array(below)).filter(pa.array((below > 0) & (queries > 0)))

    kinds = dict(rows.dtypes)
    found = cells.groupBy(*keys, "one_").applyInArrow(told, ", ".join(f"{c} {kinds[c]}" for c in [*keys, *at]) + ", n long")
    rows = rows.filter("query_").select("tid_", *keys, *at)
    if len(at) == 1:  # few cells of many rows: a block has one for each of its keys
        found = F.broadcast(found)
    else:  # many cells, so their rows are spread evenly
        rows, found = rows.repartition(blocks, *keys, *at), found.repartition(blocks, *keys, *at)
    return rows.join(found, [*keys, *at]).select(F.col("tid_").alias("tid"), "n")


def nearest_before(rows: DataFrame, keys: Sequence[str], descending: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tid, near): for each row of `rows` (`tid_`, the `keys`, a value `v_`) the row of an earlier tid whose value is the greatest not above its own (the least not
    below it, if `descending`), the earliest of equals. Rows without such a row are absent. With a column `query_` a row is only a query or only a point.

    Rows are cut into blocks by tid and by value; as for counts, each pair is met in one place: a block of tid, a block of values, or the grid, where cells hold their best
    point and running maxima take the place of sums."""
    keys, kind = list(keys), dict(rows.dtypes)["v_"]
    if "query_" not in rows.columns:
        rows = rows.withColumn("query_", F.explode(F.array(F.lit(False), F.lit(True))))
    blocks = min(max(1, -(-rows.count() // block_rows)), int(CELLS**0.5))
    value = F.col("v_").desc() if descending else F.col("v_").asc()
    if blocks > 1:  # of equal values the earliest row is the last point, and queries follow
        rows = checkpoint(rows.repartitionByRange(blocks, *keys, "tid_", F.desc("query_")).withColumn("b0_", F.spark_partition_id()))
        rows = checkpoint(rows.repartitionByRange(blocks, *keys, value, "query_", F.desc("tid_")).withColumn("b1_", F.spark_partition_id()))
    else:
        rows = rows.withColumns({"b0_": F.lit(0), "b1_": F.lit(0)})
    schema = f"tid long, near long, v {kind}"

    def codes(t: pa.Table) -> np.ndarray:
        code = np.unique(t.column("v_").to_pandas().to_numpy(), return_inverse=True)[1].astype(np.int64)
        return -code if descending else code

    def within(first: str):
        def work(t: pa.Table) -> pa.Table:
            query, code = t.column("query_").to_numpy().astype(bool), codes(t)
            points, queries = np.flatnonzero(~query), np.flatnonzero(query)
            if not len(points):
                return pa.table({"tid": t.column("tid_").slice(0, 0), "near": t.column("tid_").slice(0, 0), "v": t.column("v_").slice(0, 0)})
            # the keys of a block are told apart by a part of the code: points lie by key, value and tid
            key = t.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(code), np.int64)
            code = code - code.min()
            base = key * (int(code.max()) + 1)
            order = np.lexsort((-t.column("tid_").to_numpy()[points], (base + code)[points]))
            place = np.empty(len(points), np.int64)
            place[order] = np.arange(len(points))
            lying = (base + code)[points][order]
            ends, begins = np.searchsorted(lying, (base + code)[queries], "right"), np.searchsorted(lying, base[queries], "left")
            x = t.column(first).to_numpy().astype(np.int64)
            near = last_before([x[points], place], [x[queries], ends], begins)
            at = np.flatnonzero(near >= 0)
            found = pa.array(points[near[at]])
            return pa.table({"tid": t.column("tid_").take(pa.array(queries[at])), "near": t.column("tid_").take(found), "v": t.column("v_").take(found)})

        return work

    parts = [rows.select(*keys, "tid_", "query_", "v_", "b0_").groupBy("b0_").applyInArrow(within("tid_"), schema)]
    if blocks > 1:
        parts.append(rows.select(*keys, "tid_", "query_", "v_", "b0_", "b1_").groupBy("b1_").applyInArrow(within("b0_"), schema))
        point = lambda *c: F.when(~F.col("query_"), F.struct(*c))
        best = F.min(point("v_", "tid_")) if descending else F.max(point("v_", (-F.col("tid_")).alias("n_")))
        tid_of = F.col("m_.tid_") if descending else -F.col("m_.n_")
        if keys:  # only keys that more than one block of tid holds have such pairs: no more keys than blocks
            wide = rows.groupBy(*[F.col(k).alias(f"w{k}") for k in keys]).agg(F.min("b0_").alias("lo_"), F.max("b0_").alias("hi_")).filter("lo_ < hi_")
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"w{k}"))
            rows = rows.join(F.broadcast(wide), same, "left_semi")
        cells = rows.groupBy(*keys, "b0_", "b1_").agg(best.alias("m_")).select(*keys, "b0_", "b1_", tid_of.alias("tid_"), F.col("m_.v_").alias("v_")).withColumn("one_", F.lit(0))

        def grid(t: pa.Table) -> pa.Table:
            where = tuple(np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("b0_", "b1_"))
            points = np.flatnonzero(t.column("tid_").is_valid().to_numpy(zero_copy_only=False))
            some = t.take(pa.array(points))
            order = np.lexsort((-some.column("tid_").to_numpy().astype(np.int64), codes(some)))
            held = np.zeros([int(w.max()) + 2 for w in where], np.int64)
            held[tuple(w[points[order]] + 1 for w in where)] = np.arange(1, len(points) + 1)
            held = np.maximum.accumulate(np.maximum.accumulate(held, 0), 1)[where]
            at = np.flatnonzero(held)
            near = pa.array(points[order][held[at] - 1])
            made = {c: t.column(c).take(pa.array(at)) for c in [*keys, "b0_", "b1_"]}
            return pa.table({**made, "near": t.column("tid_").take(near), "v": t.column("v_").take(near)})

        kinds = dict(rows.dtypes)
        found = cells.groupBy(*keys, "one_").applyInArrow(grid, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "b0_", "b1_"]) + f", near long, v {kind}")
        both = F.lit(True)
        for c in [*keys, "b0_", "b1_"]:
            both = both & F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
        parts.append(rows.filter("query_").alias("r").join(found.alias("g"), both).select(F.col("r.tid_").alias("tid"), "near", "v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min(F.struct("v", "near"))["near"] if descending else -F.max(F.struct("v", (-F.col("near")).alias("n")))["n"]
    return out.groupBy("tid").agg(best.alias("near"))
