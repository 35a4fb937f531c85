"""Constraint format, plans and the counting of violations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import dominance, violations
from tabloom.plans import sequence as seq
from tabloom.plans.constraint import DenialConstraint, from_discovery, shape
from tabloom.sources import files, tables

dc = DenialConstraint.parse
TESTS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
SHAPES = [
    "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)&IQ(t1.c,t2.c)", "t1&t2&IQ(t1.a,t2.a)&IQ(t1.b,t2.b)&IQ(t1.c,t2.c)", "t1&t2&EQ(t1.a,t2.a)&EQ(t1.b,t2.b)",
    "t1&t2&EQ(t1.a,t2.a)&LT(t1.x,t2.x)", "t1&t2&EQ(t1.a,t2.a)&GT(t1.x,t2.x)&LTE(t1.y-z,t2.y-z)", "t1&t2&LT(t1.x,t2.x)&GTE(t1.y-z,t2.y-z)", "t1&t2&IQ(t1.a,t2.a)&LTE(t1.x,t2.x)",
    "t1&t2&GTE(t1.x,t2.x)", "t1&t2&EQ(t2.a,t1.a)&LT(t2.x,t1.x)", "t1&t2&LT(t1.c,t2.c)&IQ(t1.b,t2.b)",
]

#: Different attributes, constants, tests of one tuple alone, three orders, <> besides an order, nothing that ties the tuples.
THETA = [
    "t1&t2&LT(t1.a,t2.x)", "t1&t2&EQ(t1.a,t2.y-z)&GTE(t1.x,t2.a)", "t1&t2&LT(t1.a,t2.x)&GT(t1.x,t2.y-z)&IQ(t1.b,t2.c)", 't1&t2&GT(t1.x,2)&LTE(t2.y-z,t1.a)&EQ(t2.b,"p")',
    "t1&t2&LT(t1.x,t2.x)&GT(t1.y-z,t2.y-z)&LTE(t1.a,t2.a)", "t1&t2&GT(t1.x,2)&LT(t2.a,3)", "t1&t2&IQ(t1.a,t2.y-z)&IQ(t1.b,t2.b)", "t1&t2&LTE(t1.x,t2.x)&GTE(t1.a,t2.a)", "t1&t2&EQ(t1.b,t2.b)&EQ(t1.a,t2.x)&LTE(t1.x,t2.y-z)", "t1&t2&LTE(t1.a,t1.x)&GT(t1.x,t2.a)",
]


@pytest.fixture(scope="module")
def table():
    r = random.Random(1)
    pick = lambda v: r.choice([*v, None]) if r.random() < 0.2 else r.choice(v)
    return [(i, pick([1, 2, 3]), pick(["p", "q"]), pick(["u", "v", "w"]), pick([1.0, 2.0, 2.5, 4.0]), pick([1, 2, 3, 10])) for i in range(90)]


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table, "tid long, a int, b string, c string, x double, `y-z` long")


def holds(c, s, t):
    at = {"tid": 0, "a": 1, "b": 2, "c": 3, "x": 4, "y-z": 5}
    value = lambda o: o.value if not o.side else (s if o.side == 1 else t)[at[o.value]]
    return all(value(p.left) is not None and value(p.right) is not None and TESTS[p.op](value(p.left), value(p.right)) for p in c.predicates)


def test_format():
    c = dc("t1&t2&EQ(t1.education,t2.education)&IQ(t1.education-num,t2.education-num)")
    assert c.is_fd and c.attributes == ("education", "education-num") and shape(c) == "counts" and str(dc(str(c))) == str(c)
    assert c.sql() == 't1."education" = t2."education" AND t1."education-num" <> t2."education-num"'
    assert not dc(SHAPES[3]).is_fd and shape(dc(SHAPES[5])) == "grouped_order" and shape(dc(SHAPES[6])) == "order_only"
    one = dc("t1&GT(t1.a,5)&EQ(t1.b,\"it's\")")
    assert shape(one) == "one_tuple" and one.sql() == "t1.\"a\" > 5 AND t1.\"b\" = 'it''s'"
    assert shape(dc("t1&t2&LT(t1.a,t2.b)")) == "theta"
    for bad in ("t1&t2", "t1&t2&XX(t1.a,t2.a)", "t1&EQ(t1.a)"):
        with pytest.raises(ValueError):
            dc(bad)


def test_discovered():
    assert str(from_discovery("t0.native-country!=t1.native-country and t0.capital-loss<t1.capital-loss")) == "t1&t2&IQ(t1.native-country,t2.native-country)&LT(t1.capital-loss,t2.capital-loss)"
    assert str(from_discovery("t0.a>=t1.longer")) == "t1&t2&GTE(t1.a,t2.longer)"


@pytest.mark.parametrize("text", [*SHAPES, *THETA])
@pytest.mark.parametrize("mode", ["tid_ordered", "ordered"])
def test_counts(df, table, text, mode):
    c = dc(text)
    want = sum(holds(c, s, t) for s, t in itertools.permutations(table, 2) if mode == "ordered" or s[0] < t[0])
    for join_rows, tile_rows in ((1024, 16384), (5, 7)):
        assert violations.count_violations(df, c, mode=mode, join_rows=join_rows, block_rows=tile_rows).first()[0] == want


@pytest.mark.parametrize("text", [*SHAPES, *THETA, "t1&GT(t1.x,2)"])
def test_row_counts(df, table, text):
    c = dc(text)
    want = [(s[0], sum(holds(c, s, t) for t in table if t[0] != s[0]) if c.two_tuple else int(holds(c, s, s))) for s in table]
    assert sorted(map(tuple, violations.row_violations(df, c, join_rows=5, block_rows=7).collect())) == want
    assert sorted(r.tid for r in violations.violating_rows(df, c).select("tid").collect()) == [i for i, n in want if n]


def test_count_before():
    r = np.random.default_rng(1)
    for k, high in itertools.product((1, 2, 3, 4), (3, 40, 100_000)):
        points, queries = ([r.integers(0, high, n) for _ in range(k)] for n in (700, 600))
        want = np.all([p[:, None] < q[None, :] for p, q in zip(points, queries)], axis=0).sum(0)
        assert (dominance.count_before(points, queries) == want).all()
    assert dominance.count_before([np.zeros(0, int)], [np.zeros(3, int)]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("text", ["t1&t2&LT(t1.x,t2.x)&GTE(t1.y,t2.y)", "t1&t2&LTE(t1.y,t2.y)", "t1&t2&EQ(t1.k,t2.k)&LT(t1.x,t2.y)&LTE(t1.y,t2.x)", "t1&t2&IQ(t1.k,t2.k)&GT(t1.x,t2.x)"])
def test_blocks_of_many_rows_and_common_values(spark, text):
    """Blocks cut through values that most rows share, and through keys."""
    r = np.random.default_rng(2)
    n = 1500
    x, y, k = np.where(r.random(n) < 0.6, 5, r.integers(0, 50, n)), r.integers(0, 4, n), np.where(r.random(n) < 0.7, 1, r.integers(0, 9, n))
    data = spark.createDataFrame([(int(i), int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, k))], "tid long, x int, y int, k int")
    c, at = dc(text), {"x": x, "y": y, "k": k}
    ok = ~np.eye(n, dtype=bool)
    for p in c.predicates:
        one, two = at[p.left.value], at[p.right.value]
        ok &= {"=": np.equal, "<>": np.not_equal, "<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal}[p.op](one[:, None], two[None, :])
    for block_rows in (400, 10**6):
        assert violations.count_violations(data, c, mode="ordered", join_rows=10, block_rows=block_rows).first()[0] == ok.sum()
        assert violations.count_violations(data, c, join_rows=10, block_rows=block_rows).first()[0] == np.triu(ok).sum()
        assert [r.n for r in violations.row_violations(data, c, join_rows=10, block_rows=block_rows).orderBy("tid").collect()] == ok.sum(1).tolist()


@pytest.mark.parametrize("text", [SHAPES[6], THETA[0], THETA[2], THETA[5]])
def test_no_nested_loop(df, text):
    for made in (violations.count_violations(df, dc(text)), violations.row_violations(df, dc(text)), violations.violating_rows(df, dc(text))):
        plan = made._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_and_report(df):
    none = df.limit(0)
    assert [r.n_vio for r in violations.violation_report(none, [dc(t) for t in SHAPES[:5]]).collect()] == [0] * 5
    r = violations.violation_report(df, [dc("t1&GT(t1.x,2)")]).first()
    assert r.n_pair == 90 and r.ratio == round(r.n_vio / 90, 3)


def test_sequence_and_roles():
    dcs = [dc("t1&t2&EQ(t1.zip,t2.zip)&IQ(t1.city,t2.city)"), dc("t1&t2&EQ(t1.area,t2.area)&IQ(t1.state,t2.state)"), dc("t1&t2&LT(t1.pay,t2.pay)&GT(t1.rate,t2.rate)")]
    size = {"zip": 100, "city": 50, "area": 20, "state": 10, "pay": 1000, "rate": 500, "sex": 2}
    order = seq.sequence(list(size), dcs, size, {"pay": 50, "rate": 10})
    assert order == ["area", "state", "zip", "city", "sex", "rate", "pay"]
    assert seq.relevant(dcs, ["area"], "state") == [1] and seq.relevant(dcs, [], "city") == []
    assert seq.start_categorical(["pay", "sex"], ["pay"]) == ["sex", "pay"]
    kinds = {"zip": "bigint", "pay": "double", "age": "bigint", "sex": "string", "rate": "bigint"}
    assert seq.roles(kinds, {"age": (18, 79), "zip": (0, 99999), "rate": (0, 5000)}, dcs) == {"zip": "categorical", "pay": "numeric", "age": "categorical", "sex": "categorical", "rate": "numeric"}


def test_files(tmp_path):
    at = str(tmp_path / "w")
    files.write_weights(at, [1000, 2.5e-4], {"dp": False})
    assert files.read_weights(at, 2) == [1000.0, 2.5e-4] and files.toggled([1e-9, 0.3]) == [1000.0, 0.3]
    with pytest.raises(ValueError):
        files.read_weights(at, 3)
    dcs = [dc(t) for t in SHAPES]
    files.write_constraints(str(tmp_path / "c"), dcs)
    assert files.read_constraints(str(tmp_path / "c")) == dcs
    (tmp_path / "d").write_text("t0.a=t1.a and t0.b!=t1.b\n")
    assert files.import_discovered(str(tmp_path / "d"))[0].is_fd
    log = files.report_log(str(tmp_path / "log"))
    log.info("done")
    assert "done" in (tmp_path / "log" / "run.log").read_text()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for kind in ("parquet", "csv"):
        tables.save_table(df, str(tmp_path / kind), kind, ["s", "n"])
    assert tables.read_csv(spark, str(tmp_path / "csv")).columns == ["s", "n"]
    assert tables.read_parquet(spark, str(tmp_path / "parquet")).count() == 2
    assert sorted(r.tid for r in tables.with_tid(df).collect()) == [0, 1]
    assert tables.output_name("adult", 1.0, {"ar": True, "mcmc": 0}) == "adult_eps1_ar1_mcmc0"
    assert tables.load_view(df, "v_").count() == spark.sql("select * from v_").count()


def test_blocks_in_a_task_and_a_small_grid(monkeypatch):
    """Counts in three to five orders by blocks, grid and sets of bits are those of all pairs; one task's grid stays far below a table's rows."""
    monkeypatch.setattr(dominance, "FEW", 64)
    rng = np.random.default_rng(3)
    for width in (3, 4, 5):
        for many in (3, 40, 10**6):
            points, queries = ([rng.integers(0, many if j else 5, n) for j in range(width)] for n in (700, 900))
            want = np.logical_and.reduce([p[:, None] < q[None, :] for p, q in zip(points, queries)]).sum(0)
            assert (dominance.count_before(points, queries) == want).all()
    assert dominance.CELLS <= 1 << 21


def test_a_key_of_many_rows_is_not_one_task(spark, monkeypatch):
    """Rows of one key stay in the partitions they are read in, whether joins may broadcast or not."""
    seen = []
    counted = violations.counts_before
    monkeypatch.setattr(violations, "counts_before", lambda rows, *a: seen.append(rows) or counted(rows, *a))
    data = spark.range(0, 4000, 1, 4).selectExpr("id as tid", "1 as k", "id % 7 as x", "id % 5 as y")
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for c in kept:
        spark.conf.set(c, "-1")
    try:
        got = violations.row_violations(data, dc("t1&t2&EQ(t1.k,t2.k)&LT(t1.x,t2.y)"), join_rows=10).agg(F.sum("n")).first()[0]
        sizes = [r[0] for r in seen[0].groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    x, y = np.arange(4000) % 7, np.arange(4000) % 5
    assert got == (x[:, None] < y[None, :]).sum() - (x < y).sum()
    assert sum(sizes) == 8000 and max(sizes) <= 2000


def test_one_block_is_one_task(spark, df, monkeypatch):
    seen, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (seen.append(self) if c and c[-1] in ("b0_", "b1_") and "query_" in self.columns else None) or group(self, *c))
    rows = spark.range(0, 400, 1, 4).selectExpr("id as tid", "id * 37 % 101 as x")
    assert violations.count_violations(rows, dc("t1&t2&LT(t1.x,t2.x)"), block_rows=50).first()[0] == sum(a * 37 % 101 < b * 37 % 101 for a in range(400) for b in range(a + 1, 400))
    held = group(seen[0], F.spark_partition_id()).agg(F.count_distinct("b0_").alias("n"))
    assert [r.n for r in held.collect()] == [1] * 16
