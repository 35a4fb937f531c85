"""Repair of constraints of every kind."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import repair, violations
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse
RULES = [
    ["t1&t2&EQ(t1.a,t2.a)&LT(t1.x,t2.x)&GT(t1.y,t2.y)"],
    ["t1&t2&LT(t1.x,t2.x)&GT(t1.y,t2.y)"],
    ["t1&GT(t1.x,30)", "t1&LT(t1.y,t1.x)"],
    ["t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", "t1&t2&EQ(t1.b,t2.b)&LT(t1.x,t2.x)&GTE(t1.y,t2.y)", 't1&EQ(t1.b,"q")'],
    ["t1&t2&EQ(t1.a,t2.a)&EQ(t1.x,t2.x)"],
    ["t1&t2&EQ(t1.a,t2.a)&LT(t1.x,t2.y)&IQ(t1.b,t2.b)"],
]


@pytest.mark.parametrize("texts", RULES)
def test_nothing_is_violated_afterwards(spark, texts):
    r = random.Random(len(texts))
    rows = [(3 * i, r.randint(0, 4), r.choice("pqr"), i // 4 + r.choice([0] * 9 + [20]), float(i // 4 + r.choice([0] * 9 + [-15])), "z") for i in range(160)]
    df = spark.createDataFrame(rows, "tid long, a int, b string, x int, y double, other string").repartition(3)
    dcs = [dc(t) for t in texts]
    before = sum(violations.count_violations(df, c, mode="ordered" if c.two_tuple else "tid_ordered").first()[0] for c in dcs)
    made, told = repair.repair(df, dcs)
    assert before > 0
    assert made.schema.names == df.schema.names and [f.dataType for f in made.schema] == [f.dataType for f in df.schema] and made.count() == 160
    assert sum(violations.count_violations(made, c, mode="ordered" if c.two_tuple else "tid_ordered").first()[0] for c in dcs) == 0
    old, new = ({x.tid: x for x in t.collect()} for t in (df, made))
    assert old.keys() == new.keys()
    counts = {x.attr: x.n for x in told.collect()}
    assert set(counts) == {a for c in dcs for a in c.attributes}
    for a, n in counts.items():
        assert n == sum(old[i][a] != new[i][a] for i in old)
    assert all(old[i][c] == new[i][c] for i in old for c in df.columns if c not in counts)
    changed = sum(old[i] != new[i] for i in old)
    assert 0 < changed < 160


def test_a_clean_table_stays(spark):
    df = spark.createDataFrame([(i, i, float(i)) for i in range(40)], "tid long, x int, y double")
    made, told = repair.repair(df, [dc("t1&t2&LT(t1.x,t2.x)&GT(t1.y,t2.y)")])
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect())) and {r.n for r in told.collect()} == {0}
    assert repair.repair(df, [])[0] is df


def test_one_bad_row_is_the_one_that_changes(spark):
    """A cover by degree takes the row that conflicts with all others."""
    df = spark.createDataFrame([(i, i, float(i)) for i in range(50)] + [(99, 100, -5.0)], "tid long, x int, y double")
    made, _ = repair.repair(df, [dc("t1&t2&LT(t1.x,t2.x)&GT(t1.y,t2.y)")])
    got = {r.tid: (r.x, r.y) for r in made.collect()}
    assert all(got[i] == (i, float(i)) for i in range(50)) and got[99] == (49, 49.0)


def test_cover_passes_on_conflicts_only(spark, monkeypatch):
    """Rounds after the first one read the compared attributes of the rows in conflict, not the table."""
    seen, real = [], repair.degrees
    monkeypatch.setattr(repair, "degrees", lambda df, dcs, tid: (seen.append((df.columns, df.count())), real(df, dcs, tid))[1])
    rows = spark.createDataFrame([(i, i // 4 if i < 400 else -i, i % 3, "x" * 50) for i in range(1000)], "tid long, k long, v long, other string")
    left = rows.join(repair.vertex_cover(rows, [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")]), "tid", "left_anti")
    assert left.groupBy("k").agg(F.countDistinct("v").alias("n")).filter("n > 1").isEmpty()
    assert seen[0] == (["tid", "k", "v"], 1000) and len(seen) > 1 and all(c == ["tid", "k", "v"] and n <= 400 for c, n in seen[1:])
