"""Runs that go on, and marginals rolled up from larger ones."""

import random

import pytest

from tabloom.operators import constrained, marginals
from tabloom.operators.constrained import Settings
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.store import Store, content


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    return spark.createDataFrame([(i, r.randint(0, 3), r.choice("ab"), r.choice(["x", "y", None]), r.random()) for i in range(300)], "tid long, a int, b string, c string, d double")


def test_content(table):
    assert content(table) == content(table.repartition(7)) == content(table.orderBy("d"))
    assert content(table) != content(table.filter("tid > 0")) and content(table.limit(0))[0] == 0


def test_a_killed_run_goes_on_at_its_attribute(spark, table, tmp_path, monkeypatch):
    store, dcs, columns = Store(spark, str(tmp_path)), [DenialConstraint.parse("t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)")], ["a", "b", "c", "d"]
    args, settings = (table, dcs, [1000.0], columns), Settings(seed=4, sequence=("a", "b", "c", "d"))
    want = sorted(map(tuple, constrained.synthesize(*args, settings=settings).collect()))
    fill, filled = constrained.fill_attribute, []

    def dies_at_c(syn, true, target, *more):
        filled.append(target)
        if target == "c" and filled.count("c") == 1:
            raise KeyboardInterrupt
        return fill(syn, true, target, *more)

    monkeypatch.setattr(constrained, "fill_attribute", dies_at_c)
    with pytest.raises(KeyboardInterrupt):
        constrained.synthesize(*args, settings=settings, store=store)
    assert filled == ["b", "c"]
    made = constrained.synthesize(*args, settings=settings, store=store)
    assert filled == ["b", "c", "c", "d"]  # what was done is not done again
    assert sorted(map(tuple, made.collect())) == want
    constrained.synthesize(*args, settings=settings, store=store)
    assert len(filled) == 4
    constrained.synthesize(*args, settings=Settings(seed=5, sequence=("a", "b", "c", "d")), store=store)
    constrained.synthesize(table.filter("tid > 0"), *args[1:], settings=settings, store=store)
    assert len(filled) == 10  # other settings and other tables are other runs


def test_half_written_tables_do_not_count(spark, table, tmp_path):
    store, key = Store(spark, str(tmp_path)), {"of": "this"}
    store.get(key, lambda: table)
    (tmp_path / store.path(key).split("/")[-1] / "_SUCCESS").unlink()
    assert not store.holds(key) and store.get(key, lambda: table.limit(5)).count() == 5 and store.holds(key)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_lattice_is_all_marginals(spark, table, k):
    syn = table.filter("tid % 3 = 0").replace("a", "b", "b")
    columns = ["a", "b", "c", "d"]
    both = marginals.prepared(table, syn, columns)
    got = {(r["size"], r.attrs): round(r.tvd, 12) for r in marginals.lattice_report(table, syn, columns, k).collect()}
    want = {(j, r.attrs): round(r.tvd, 12) for j in range(1, k + 1) for r in marginals.distances(both, marginals.attribute_sets(columns, j)).collect()}
    assert got == want
