"""Repair of a table that violates constraints of any kind.

Rows that conflict are the vertices of a graph, a pair that violates a constraint is an edge, and a row that violates a constraint of one tuple must go by itself. A vertex cover is found by degrees alone, which
`row_violations` counts without listing an edge: every round takes all rows of at least half the highest degree, so the degree halves and there are about log2(rows) rounds.
What is left has no conflict. Each row of the cover then takes the constraints' attributes of a row that stays: of its nearest neighbours with the same key
(below and above it in the first order) the one that changes fewer cells. As it now equals a row without conflicts in all that is compared, it has none either.

Constraints that two equal rows violate can't be mended so; for these the attribute that fewest constraints hold becomes null, which violates nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.dominance import nearest_before
from tabloom.operators.violations import row_violations
from tabloom.plans.constraint import DenialConstraint, Operand, Predicate
from tabloom.sources.shared import checkpoint

#: Queries are told apart from points by tids beyond this.
_BEYOND = 1 << 61


def _turned(dc: DenialConstraint) -> DenialConstraint:
    """The same constraint with t1 and t2 exchanged."""
    turn = lambda o: Operand(3 - o.side, o.value) if o.side else o
    return DenialConstraint(tuple(Predicate(p.op, turn(p.left), turn(p.right)) for p in dc.predicates))


def degrees(df: DataFrame, dcs: Sequence[DenialConstraint], tid: str) -> DataFrame:
    """(tid, n): in how many violations each row takes part; rows without any are absent."""
    out = None
    for dc in dcs:
        for way in (dc, _turned(dc)) if dc.two_tuple and not dc.symmetric else (dc,):
            found = row_violations(df, way, tid).filter("n > 0")
            out = found if out is None else out.unionByName(found)
    return out.groupBy("tid").agg(F.sum("n").alias("n"))


def vertex_cover(df: DataFrame, dcs: Sequence[DenialConstraint], tid: str = "tid") -> DataFrame:
    """(tid): rows without which nothing is violated.

    Rounds pass on what the constraints compare, and only rows that are in conflict: one that isn't never will be, as rows only go."""
    cover = df.sparkSession.createDataFrame([], "tid long")
    left = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([tid, *(a for dc in dcs for a in dc.attributes)])])
    while True:
        found = checkpoint(degrees(left, dcs, tid))
        most = found.agg(F.max("n")).first()[0]
        if not most:
            return cover
        cover = checkpoint(cover.unionByName(found.filter(F.col("n") * 2 >= most).select("tid")))
        stays = found.filter(F.col("n") * 2 < most).select(F.col("tid").alias("stays_"))
        left = checkpoint(left.join(stays, F.col(f"`{tid}`").cast("long") == F.col("stays_"), "left_semi"))


def _on_equal_rows(dc: DenialConstraint) -> bool:
    return dc.two_tuple and dc.plain and all(p.op in ("=", "<=", ">=") for p in dc.predicates)


def repair(df: DataFrame, dcs: Sequence[DenialConstraint], tid: str = "tid") -> tuple[DataFrame, DataFrame]:
    """The repaired table, and (attr, n): how many cells of each attribute were changed. Rows with no other row that stays keep null in what is compared."""
    dcs, columns = list(dcs), df.columns
    lost: list[str] = []
    held = Counter(a for dc in dcs for a in dc.attributes)
    for dc in dcs:
        if _on_equal_rows(dc) and not set(dc.attributes) & set(lost):
            lost.append(min(dc.attributes, key=lambda a: (held[a], a)))
    if not dcs:
        return df, df.sparkSession.createDataFrame([], "attr string, n long")
    df = checkpoint(df)
    cover = checkpoint(vertex_cover(df, dcs, tid).withColumnRenamed("tid", "cover_"))
    attrs, id_ = list(held), F.col(f"`{tid}`").cast("long")
    marked = df.join(cover, id_ == F.col("cover_"), "left").withColumn("query_", F.col("cover_").isNotNull()).drop("cover_")
    marked = checkpoint(marked)
    keys = [a for a in (dcs[0].of("=") if dcs[0].two_tuple else ())]
    by = next((a for dc in dcs for a, _ in dc.orders), None) or next(a for a in attrs if a not in keys or len(attrs) == len(keys))
    ks = [f"k{i}_" for i in range(len(keys))]
    rows = marked.select(F.when(F.col("query_"), id_ + F.lit(_BEYOND)).otherwise(id_).alias("tid_"), *[F.col(f"`{k}`").alias(c) for k, c in zip(keys, ks)], F.col(f"`{by}`").alias("v_"), "query_").na.drop(subset=["v_"])
    near = None
    for order in (False, True):
        found = nearest_before(rows, ks, order)
        near = found if near is None else near.unionByName(found)
    near = near.select((F.col("tid") - F.lit(_BEYOND)).alias("of_"), F.col("near").alias("from_"))
    some = marked.filter(~F.col("query_")).agg(F.min(id_)).first()[0]  # for rows without a neighbour of their key
    alone = marked.filter("query_").select(id_.alias("of_")).join(near.select("of_"), "of_", "left_anti").select("of_", F.lit(some).cast("long").alias("from_"))
    near = near.unionByName(alone)
    stays = df.select(id_.alias("from_"), F.struct(*[F.col(f"`{a}`") for a in attrs]).alias("new_"))
    own = df.select(id_.alias("of_"), F.struct(*[F.col(f"`{a}`") for a in attrs]).alias("old_"))
    cost = sum(((~F.col(f"new_.`{a}`").eqNullSafe(F.col(f"old_.`{a}`"))).cast("int") for a in attrs), F.lit(0))
    taken = near.join(own, "of_").join(stays, "from_", "left").groupBy("of_").agg(F.min_by("new_", F.struct(cost.alias("c"), "from_")).alias("new_"))
    out = marked.join(taken, id_ == F.col("of_"), "left")
    made = checkpoint(out.select(*[(F.when(F.col("query_"), F.lit(None) if c in lost else F.col(f"new_.`{c}`")).otherwise(F.col(f"`{c}`")) if c in attrs else F.col(f"`{c}`")).alias(c) for c in columns]))
    both = made.select(id_.alias("i_"), F.struct(*[F.col(f"`{a}`") for a in attrs]).alias("new_")).join(own, F.col("i_") == F.col("of_"))
    changed = both.agg(*[F.count_if(~F.col(f"new_.`{a}`").eqNullSafe(F.col(f"old_.`{a}`"))).alias(f"n{i}") for i, a in enumerate(attrs)])
    told = changed.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"n{i}").alias("n")) for i, a in enumerate(attrs)])).alias("x")).select("x.*")
    return made, told
