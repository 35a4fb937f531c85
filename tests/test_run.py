"""A whole run, and what is known about data sets."""

import random

import pytest

from tabloom.operators import constrained, violations
from tabloom.operators.evaluate import Target
from tabloom.plans import datasets
from tabloom.plans.constraint import DenialConstraint
from tabloom.run import run
from tabloom.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, r = tmp_path_factory.mktemp("run"), random.Random(2)
    lines = ["city,state,flag,sex,pay,age"]
    for _ in range(300):
        city = r.randrange(12)
        lines.append(f"c{city},s{city % 4},{r.choice(['y', 'n'])},{r.choice(['f', 'm'])},{r.random() * 1000:.2f},{r.randint(18, 79)}")
    (at / "town.csv").write_text("\n".join(lines) + "\n")
    (at / "town.ic").write_text("t1&t2&EQ(t1.city,t2.city)&IQ(t1.state,t2.state)\nt1&t2&EQ(t1.state,t2.state)&GT(t1.age,t2.age)&LT(t1.pay,t2.pay)\n")
    files.write_weights(str(at / "town.w"), [1000.0, 0.01], {"rows": 300})
    return at


@pytest.mark.parametrize("epsilon", [None, 4.0])
def test_run(spark, folder, epsilon):
    settings = constrained.Settings(seed=1, concat=True, bounds={"pay": (0.0, 1000.0)}, domains={"flag": ["n", "y"], "sex": ["f", "m"]})
    weights = str(folder / "town.w") if epsilon is None else None
    out = run(spark, "town", str(folder / "town.csv"), str(folder / "town.ic"), str(folder), weights, epsilon, settings, [Target("sex", ("f",))], logs=str(folder / f"logs{epsilon}"))
    made = out["synthetic"]
    assert made.count() == 300 and made.columns == ["tid", "city", "state", "flag", "sex", "pay", "age"]
    assert {r.flag for r in made.collect()} == {"y", "n"} and dict(made.dtypes)["age"] in ("int", "double")
    told = {r.dc: r.n_vio for r in out["violations"].collect()}
    assert len(told) == 2
    if epsilon is None:
        assert told["t1&t2&EQ(t1.city,t2.city)&IQ(t1.state,t2.state)"] == 0
    assert out["classifiers"].count() == 9 and 0 <= out["marginal_2_average"].first().avg_tvd <= 1
    assert "weights" in (folder / f"logs{epsilon}" / "town.log").read_text()


def test_report_of_many_constraints_is_that_of_each(spark):
    r = random.Random(4)
    rows = [(i, r.choice([1, 2, None]), r.choice("ab"), r.choice([None, "x", "y"]), r.randint(0, 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "tid long, a int, b string, `c d` string, e int")
    texts = [f"t1&t2&EQ(t1.{x},t2.{x})&IQ(t1.{y},t2.{y})" for x in ("a", "b", "c d", "e") for y in ("a", "b", "c d", "e") if x != y]
    texts += ["t1&t2&IQ(t1.a,t2.a)&IQ(t1.c d,t2.c d)", "t1&t2&EQ(t1.e,t2.e)", "t1&GT(t1.e,1)", "t1&t2&EQ(t1.b,t2.b)&LT(t1.e,t2.e)", 't1&EQ(t1.b,"a")']
    dcs = [DenialConstraint.parse(t) for t in texts]
    got = {x.dc: (x.n_vio, x.n_pair) for x in violations.violation_report(df, dcs).collect()}
    names = ["tid", "a", "b", "c d", "e"]
    from .test_synthesis import violates

    dicts = [dict(zip(names, x)) for x in rows]
    for t, c in zip(texts, dcs):
        want = sum(violates(c, p, q) for i, p in enumerate(dicts) for q in dicts[i + 1 :]) if c.two_tuple else sum(violates(c, p, p) for p in dicts)
        assert got[str(c)] == (want, 80 * 79 // 2 if c.two_tuple else 80)


def test_known_data_sets(spark):
    assert len(datasets.targets_for("tpch_order")) == 9 and len(datasets.targets_for("br2000")) == 14 and len(datasets.targets_for("tax30k")) == 12
    assert datasets.sequence_for("tax30k_part", ["State", "AreaCode"]) == ("AreaCode", "State")
    assert datasets.sequence_for("adult", ["age"]) is None and datasets.sequence_for("other", ["age"]) is None
    order = datasets.random_sequence(list("abcdef"), 3)
    assert sorted(order) == list("abcdef") and order == datasets.random_sequence(list("fedcba"), 3) != datasets.random_sequence(list("abcdef"), 4)
    target = next(t for t in datasets.targets_for("tpch") if t.attr == "c_custkey")
    rows = spark.createDataFrame([("custkey_7",), ("custkey_110000",), ("other",), (None,)], "c_custkey string")
    assert [r[0] for r in rows.select(target.column()).collect()][:3] == [1, 0, 0]
