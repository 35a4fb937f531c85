"""Counting the row pairs that violate a denial constraint, with a plan that fits its shape.

``tid_ordered`` counts pairs with t1.tid < t2.tid (one orientation); ``ordered`` counts pairs with t1.tid <> t2.tid; per-row
counts take the row as t1 against all others. A comparison with null never holds.

Constraints without order predicates never form a pair: counts of equal groups, one for each subset of the <> attributes,
are combined by inclusion and exclusion. All others are counted by dominance (`dominance.py`): rows as t1 are queries, rows as t2 are points, each order predicate (and the order of tid) is an
order in which a point must come before the query, whether it compares one attribute of both or two different ones; tests of one tuple filter queries or points. Only keys of few
rows are joined with a residual filter. No block of rows meets another, and nothing is a nested loop.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.dominance import BLOCK_ROWS, Order, counts_before
from tabloom.plans.constraint import DenialConstraint, Operand, Predicate, shape
from tabloom.sources.shared import checkpoint

#: Pairs within keys of at most so many rows are joined.
JOIN_ROWS = 1024


def _named(columns: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in columns]


def _pairs_of(count: F.Column, mode: str) -> F.Column:
    c = count.cast("decimal(19,0)")
    both = (c * (c - F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)")
    return F.floor(both / F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)") if mode == "tid_ordered" else both


#: Constraints that one pass of grouping sets counts: each row is expanded once for each set.
PASS = 8
#: Rows that a task of such a pass counts at most: its groups are as many for each set. Also rows whose counts one task adds up.
GROUP_ROWS = 1 << 17


def equal_group_pairs(df: DataFrame, items: Sequence[tuple[Sequence[str], Sequence[Sequence[str]], Sequence[int]]], mode: str) -> DataFrame:
    """(item, n) for each item (attributes, sets of them, signs): the signed sum over the sets of the pairs of rows that agree on a set.

    Rows with a null in an item's attributes count for other items only. One scan for all sets of all items."""
    every = list(dict.fromkeys(c for attrs, _, _ in items for c in attrs))
    # attributes are renamed: their names may hold any character
    at = {c: f"a{i}" for i, c in enumerate(every)}
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    full = [F.lit(True) if not attrs else ~F.greatest(*[F.col(at[c]).isNull() for c in attrs], F.lit(False)) for attrs, _, _ in items]
    rows = rows.select(*at.values(), *[f.alias(f"f{j}") for j, f in enumerate(full)])
    sets = sorted({tuple(sorted(s)) for _, part, _ in items for s in part})
    groups = rows.groupingSets([[F.col(at[c]) for c in s] for s in sets], *[F.col(a) for a in at.values()])
    counted = groups.agg(*[F.count_if(F.col(f"f{j}")).alias(f"c{j}") for j in range(len(items))], F.grouping_id().alias("gid"))
    gid = {s: sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s) for s in sets}
    zero, sums = F.lit(0).cast("decimal(38,0)"), []
    for j, (_, part, signs) in enumerate(items):
        sign = F.lit(0)
        for s, g in zip(part, signs):
            sign = F.when(F.col("gid") == gid[tuple(sorted(s))], F.lit(g)).otherwise(sign)
        sums.append(F.coalesce(F.sum((sign.cast("decimal(1,0)") * _pairs_of(F.col(f"c{j}"), mode)).cast("decimal(38,0)")), zero).alias(f"n{j}"))
    told = counted.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(j).alias("item"), F.col(f"n{j}").alias("n")) for j in range(len(items))])).alias("x"))
    return told.select("x.item", F.col("x.n").cast("long").alias("n"))


def _item(dc: DenialConstraint) -> tuple:
    return (dc.attributes, *_subsets(dc.of("="), dc.of("<>")))


def _subsets(eq: Sequence[str], iq: Sequence[str]) -> tuple[list[tuple[str, ...]], list[int]]:
    sets: dict[tuple[str, ...], int] = {}
    for k in range(len(iq) + 1):
        for s in itertools.combinations(iq, k):
            key = tuple(sorted(set(eq) | set(s)))
            sets[key] = sets.get(key, 0) + (-1) ** k
    return [s for s, g in sets.items() if g], [g for g in sets.values() if g]


def _sides(dc: DenialConstraint) -> tuple[list[Predicate], list[Predicate], list[tuple[Operand, str, Operand]]]:
    """(predicates about t1 alone, about t2 alone, (operand of t1, operator, operand of t2) for the others)."""
    one, two, both = [], [], []
    for p in dc.predicates:
        sides = {p.left.side, p.right.side}
        if sides == {1, 2}:
            both.append((p.left, p.op, p.right) if p.left.side == 1 else (p.right, p.oriented, p.left))
        else:
            (two if 2 in sides else one).append(p)
    return one, two, both


def _holds(predicates: Sequence[Predicate]) -> F.Column:
    out = F.lit(True)
    for p in predicates:
        out = out & F.coalesce(p.column("t", "t"), F.lit(False))
    return out


def _pair_counts(df: DataFrame, dc: DenialConstraint, tid: str, mode: str, per_row: bool, join_rows: int, block_rows: int) -> DataFrame:
    """(tid, n) partial counts for any constraint of two tuples; tid means nothing unless per_row.

    Rows as t1 are queries, rows as t2 points; what is tested of one of them alone filters it. Equal operands make the key. In keys of few rows pairs are joined; in others the points of each
    query are counted by dominance, and <> is what is left without what is equal."""
    one, two, both = _sides(dc)
    equal, other = [(a, b) for a, op, b in both if op == "="], [(a, b) for a, op, b in both if op == "<>"]
    order = [(a, op, b) for a, op, b in both if op not in ("=", "<>")]
    names = [*(f"e{i}_" for i in range(len(equal))), *(f"u{i}_" for i in range(len(other))), *(f"v{i}_" for i in range(len(order)))]
    pairs = [*equal, *other, *((a, b) for a, _, b in order)]
    id_ = F.col(f"t.`{tid}`").cast("long").alias("tid_")
    roles = [df.alias("t").filter(_holds(tests)).select(id_, F.lit(k == 0).alias("query_"), *[p[k].column("t", "t").alias(c) for c, p in zip(names, pairs)]) for k, tests in ((0, one), (1, two))]
    rows = roles[0].union(roles[1]).na.drop(subset=names) if names else roles[0].union(roles[1])
    keys, test = names[: len(equal)], {"=": "=", "<>": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
    parts = []
    if keys:
        # a key of many rows is never one task: such keys are few, and told to all tasks
        large = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size_")).filter(F.col("size_") > 2 * join_rows).select(*keys, F.lit(True).alias("large_")))
        rows = checkpoint(rows.join(F.broadcast(large), keys, "left"))
        small = rows.filter("large_ is null").drop("large_")
        on = F.expr("l.tid_ < r.tid_" if mode == "tid_ordered" else "l.tid_ <> r.tid_")
        for c, op in [*((c, "=") for c in keys), *((f"u{i}_", "<>") for i in range(len(other))), *((f"v{i}_", test[op]) for i, (_, op, _) in enumerate(order))]:
            on = on & F.expr(f"l.{c} {op} r.{c}")
        met = small.filter("query_").alias("l").join(small.filter("not query_").alias("r"), on)
        parts.append(met.groupBy(F.col("l.tid_").alias("tid")).agg(F.count(F.lit(1)).alias("n")) if per_row else met.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("tid"), "n"))
        rows = rows.filter("large_").drop("large_")
    # of a query t1 < t2 the points are larger: they come before it in descending order
    orders = [Order(op[0] == "<", len(op) == 1) for _, op, _ in order]
    if mode == "tid_ordered" or not orders:
        rows = rows.withColumn(f"v{len(orders)}_", F.col("tid_") if mode == "tid_ordered" else F.lit(0))
        orders.append(Order(True, mode == "tid_ordered"))
    for k in range(len(other) + 1):
        for some in itertools.combinations(range(len(other)), k):
            found = counts_before(rows.select("tid_", "query_", *keys, *[f"u{i}_" for i in some], *[f"v{i}_" for i in range(len(orders))]), [*keys, *[f"u{i}_" for i in some]], orders, per_row, block_rows)
            parts.append(found.select("tid", (F.col("n") * (-1) ** k).alias("n")))
    if mode == "ordered":  # a row is no partner of its own
        alone = df.alias("t").filter(_holds(dc.predicates)).select(id_, *[a.column("t", "t").alias(c) for c, (a, _) in zip(keys, equal)])
        if keys:
            alone = alone.join(F.broadcast(large), keys, "left_semi")
        alone = alone.select(F.col("tid_").alias("tid"), F.lit(-1).cast("long").alias("n"))
        parts.append(alone if per_row else alone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).cast("long").alias("tid"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_violations(df: DataFrame, dc: DenialConstraint, tid: str = "tid", mode: str = "tid_ordered", join_rows: int = JOIN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row, ``n_vio`` (long)."""
    if mode not in ("tid_ordered", "ordered"):
        raise ValueError("mode is tid_ordered or ordered")
    kind = shape(dc)
    if kind == "one_tuple":
        return df.alias("t1").filter(dc.column("t1", "t2")).agg(F.count(F.lit(1)).alias("n_vio"))
    if kind == "counts":
        return equal_group_pairs(df, [_item(dc)], mode).select(F.col("n").alias("n_vio"))
    return _pair_counts(df, dc, tid, mode, False, join_rows, block_rows).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_vio"))


def row_violations(df: DataFrame, dc: DenialConstraint, tid: str = "tid", join_rows: int = JOIN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tid, n) for every row: how many others it violates the constraint with, as t1."""
    ids = df.select(F.col(f"`{tid}`").cast("long").alias("tid"))
    kind = shape(dc)
    if kind == "one_tuple":
        hit = F.coalesce(dc.column("t1", "t2"), F.lit(False))
        return df.alias("t1").select(F.col(f"t1.`{tid}`").cast("long").alias("tid"), hit.cast("long").alias("n"))
    if kind == "counts":
        sets, signs = _subsets(dc.of("="), dc.of("<>"))
        names = {a: f"a{i}" for i, a in enumerate(dc.attributes)}
        rows = df.select(F.col(f"`{tid}`").cast("long").alias("tid"), *[F.col(f"`{a}`").alias(n) for a, n in names.items()])
        full = rows.na.drop(subset=list(names.values()))
        total, found = F.lit(0).cast("long"), full
        for i, (s, g) in enumerate(zip(sets, signs)):
            keys = [names[a] for a in s]
            sizes = full.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"c{i}"))
            # without keys this is one row
            found = found.join(sizes, keys) if keys else found.join(F.broadcast(sizes))
            total = total + F.lit(g) * (F.col(f"c{i}") - 1)
        return ids.join(found.select("tid", total.alias("n")), "tid", "left").select("tid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    counts, parts = _pair_counts(df, dc, tid, "ordered", True, join_rows, block_rows), -(-ids.count() // GROUP_ROWS)
    if parts > 1:
        ids, counts = ids.repartition(parts, "tid"), counts.repartition(parts, "tid")
    summed = counts.groupBy("tid").agg(F.sum("n").alias("n"))
    return ids.join(summed, "tid", "left").select("tid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def violating_rows(df: DataFrame, dc: DenialConstraint, tid: str = "tid") -> DataFrame:
    """The rows that violate the constraint, as t1, with any other (existence, not a count)."""
    if shape(dc) == "one_tuple":
        return df.alias("t1").filter(dc.column("t1", "t2"))
    return df.join(row_violations(df, dc, tid).filter("n > 0").select(F.col("tid").alias(tid)), tid, "left_semi")


def violation_matrix(df: DataFrame, dcs: Sequence[DenialConstraint], tid: str = "tid") -> DataFrame:
    """(tid, dc, n): per-row counts of every constraint, dc being its index."""
    out = None
    for i, dc in enumerate(dcs):
        one = row_violations(df, dc, tid).select("tid", F.lit(i).alias("dc"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def violation_report(df: DataFrame, dcs: Sequence[DenialConstraint], tid: str = "tid", mode: str = "tid_ordered") -> DataFrame:
    """(dc, n_vio, n_pair, ratio): one row for each constraint; pairs are rows for one-tuple constraints; the ratio has 3 decimals."""
    if not dcs:
        return df.sparkSession.createDataFrame([], "dc string, n_vio long, n_pair long, ratio double")
    used = sorted({a for dc in dcs for a in dc.attributes} | {tid})
    df = checkpoint(df.select(*_named(used)))  # read by every pass
    size = df.agg(F.count(F.lit(1)).alias("rows_"))
    lone, grouped = [i for i, dc in enumerate(dcs) if shape(dc) == "one_tuple"], [i for i, dc in enumerate(dcs) if shape(dc) == "counts"]
    counts, spread = [], df
    if grouped and (parts := -(-df.count() // GROUP_ROWS)) > 1:  # files may be few and large
        spread = df.repartition(parts, F.col(f"`{tid}`"))
    if lone:  # all of them in one scan
        hits = df.alias("t1").agg(*[F.count_if(dcs[i].column("t1", "t2")).alias(f"n{i}") for i in lone])
        counts.append(hits.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n_vio")) for i in lone])).alias("x")).select("x.*"))
    for a in range(0, len(grouped), PASS):
        part = grouped[a : a + PASS]
        told = equal_group_pairs(spread, [_item(dcs[i]) for i in part], mode)
        counts.append(told.select(F.element_at(F.array(*[F.lit(i) for i in part]), F.col("item") + 1).alias("i"), F.col("n").alias("n_vio")))
    for i, dc in enumerate(dcs):
        if i not in lone and i not in grouped:
            counts.append(count_violations(df, dc, tid, mode).select(F.lit(i).alias("i"), "n_vio"))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    pairs = _pairs_of(F.col("rows_"), mode).cast("long")
    about = [F.struct(F.lit(str(dc)).alias("dc"), F.lit(dc.two_tuple).alias("two")) for dc in dcs]
    out = out.join(F.broadcast(size)).select(F.element_at(F.array(*about), F.col("i") + 1).alias("x"), "n_vio", pairs.alias("pairs_"), "rows_")
    out = out.select("x.dc", "n_vio", F.when(F.col("x.two"), F.col("pairs_")).otherwise(F.col("rows_")).alias("n_pair"))
    ratio = F.when(F.col("n_pair") > 0, F.round(F.col("n_vio") / F.col("n_pair"), 3)).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio.cast("double"))
