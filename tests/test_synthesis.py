"""The sequential synthesis against a plain sampler that looks at every earlier row."""

import itertools
import math
import operator
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.functions import privacy
from tabloom.functions.rng import keyed
from tabloom.operators import constrained, model, violations
from tabloom.operators.constrained import Settings
from tabloom.operators.tally import BUFFER, Tally
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse
TEST = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def violates(c, one, two):
    """Plainly: do rows one and two (as t1 and t2) violate?"""
    side = lambda o: o.value if not o.side else (one if o.side == 1 else two)[o.value]
    pairs = [(side(p.left), p.op, side(p.right)) for p in c.predicates]
    return all(a is not None and b is not None and TEST[op](a, b) for a, op, b in pairs)


def slow_load(dcs, weights, seen, row):
    total = 0.0
    for c, w in zip(dcs, weights):
        total += w * (sum(violates(c, r, row) for r in seen) if c.two_tuple else violates(c, row, row))
    return total


# the three shapes of soft constraints with several orders, and what else the format allows
SHAPES = [
    "t1&t2&EQ(t1.g,t2.g)&LT(t1.x,t2.x)&GT(t1.v,t2.v)",
    "t1&t2&IQ(t1.s,t2.s)&LTE(t1.g,t2.g)&GTE(t1.v,t2.v)",
    "t1&t2&LTE(t1.v,t2.v)&LT(t1.x,t2.x)&IQ(t1.s,t2.s)&LT(t1.y,t2.y)",
    "t1&t2&EQ(t1.g,t2.g)&IQ(t1.v,t2.v)",
    "t1&t2&EQ(t1.v,t2.v)&IQ(t1.s,t2.s)&IQ(t1.g,t2.g)",
    "t1&t2&EQ(t1.v,t2.v)&LT(t1.x,t2.x)",
    "t1&t2&IQ(t1.v,t2.v)&GT(t1.x,t2.x)&LTE(t1.y,t2.y)",
    "t1&t2&IQ(t1.v,t2.v)&IQ(t1.s,t2.s)",
    't1&t2&EQ(t1.s,"a")&EQ(t2.v,3)&LT(t1.x,t2.x)',
    "t1&t2&LT(t1.v,t2.x)&GTE(t2.v,t1.y)",
    "t1&t2&EQ(t1.g,t2.v)&IQ(t1.v,t2.g)",
    "t1&t2&LT(t1.x,t2.v)&LTE(t1.y,t2.v)",
    't1&EQ(t1.v,2)&EQ(t1.s,"b")',
    "t1&GT(t1.v,t1.x)",
    "t1&t2&EQ(t1.v,4)",
    "t1&t2&LT(t1.s,t2.s)&EQ(t1.v,t2.v)",
]


@pytest.mark.parametrize("text", SHAPES)
def test_tally(text):
    r, c = random.Random(3), dc(text)
    tally, seen, values = Tally(c, "v"), [], [0, 1, 2, 3, 4, 5]
    for i in range(3 * BUFFER + 40):
        row = {"g": r.randint(0, 4), "s": r.choice(["a", "b", "c", None]), "x": r.randint(0, 30), "y": r.random() * 9, "v": r.choice(values)}
        if i % 40 == 0:
            want = [sum(violates(c, o, {**row, "v": v}) for o in seen) if c.two_tuple else violates(c, {**row, "v": v}, {**row, "v": v}) for v in values]
            assert tally.violations(row, values).tolist() == want
        tally.add(row, row["v"])
        seen.append(row)
        if i % 7 == 0:  # rows leave, too
            old = seen.pop(r.randrange(len(seen)))
            tally.add(old, old["v"], -1)


def slow_fill(syn, cells, parent, target, dcs, weights, keys, settings):
    """syn: list of dicts; cells: parent -> [(p, value)] best first."""
    groups, out = defaultdict(list), {}
    for row in sorted(syn, key=lambda r: r["tid"]):
        seen, tid = groups[tuple(row[k] for k in keys)], row["tid"]
        for found in (cells[row[parent]], cells["all"]):
            values, p = [v for _, v in found], np.array([q for q, _ in found])
            q = p * np.array([math.exp(-min(slow_load(dcs, weights, seen, {**row, target: v}), 700.0)) for v in values])
            if q.sum() > 1e-300:
                break
        else:
            values, q = [v for _, v in cells[row[parent]]], np.array([q for q, _ in cells[row[parent]]])
        if tid == min(r["tid"] for r in syn) or any(c.is_fd for c in dcs):
            value = values[int(np.argmax(q))]
        else:
            cdf = np.cumsum(q) / q.sum()
            value = values[min(int(np.searchsorted(cdf, keyed(settings.seed, f"fill.{target}.pick", tid), "right")), len(values) - 1)]
        out[tid] = value
        seen.append({**row, target: value})
    return out


def tables(spark, n=400):
    r = random.Random(9)
    rows = [(i, r.randint(0, 3), r.choice("abc"), r.randint(0, 40), r.random() * 9, min(5, int(r.expovariate(0.6)))) for i in range(n)]
    return spark.createDataFrame(rows, "tid long, g int, s string, x int, y double, v int")


@pytest.mark.parametrize("k", range(len(SHAPES) - 2))
def test_fill_is_the_plain_sampler(spark, k):
    true = tables(spark)
    dcs, weights, settings = [dc(SHAPES[k]), dc(SHAPES[(k + 5) % len(SHAPES)])], [0.05, 1000.0], Settings(seed=4)
    syn = true.drop("v")
    got = {r.tid: r.v for r in constrained.fill_attribute(syn, true, "v", dcs, weights, settings, parents=("g",)).collect()}
    counts = Counter((r.g, r.v) for r in true.collect())
    cells = {g: sorted(((n / sum(m for (h, _), m in counts.items() if h == g), v) for (h, v), n in counts.items() if h == g), reverse=True) for g in range(4)}
    cells["all"] = sorted(((n / 400, v) for v, n in Counter(r.v for r in true.collect()).items()), reverse=True)
    keys = constrained.sequence_keys(dcs, "v")
    assert got == slow_fill([r.asDict() for r in syn.collect()], cells, "g", "v", dcs, weights, keys, settings)


def test_hard_dependency_is_the_sequence(spark):
    true = tables(spark)
    fd, syn = dc("t1&t2&EQ(t1.g,t2.g)&IQ(t1.s,t2.s)"), true.select("tid", "g")
    by_join = constrained.fill_attribute(syn, true, "s", [fd], [1000.0], Settings(seed=4))
    by_row = constrained.fill_attribute(syn, true, "s", [fd, fd, dc('t1&EQ(t1.s,"z")')], [1000.0, 1000.0, 1.0], Settings(seed=4), parents=("g",))
    assert "MapInArrow" not in by_join._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, by_row.collect()))


@pytest.mark.parametrize("sampler", ["default", "ar", "mcmc"])
def test_hard_constraints_of_every_kind_hold(spark, sampler):
    true = tables(spark, 600)
    rules = ['t1&EQ(t1.s,"a")', 't1&t2&EQ(t1.s,"b")&EQ(t2.s,"b")&EQ(t1.g,t2.g)', "t1&t2&EQ(t1.g,t2.g)&LT(t1.x,t2.x)&GT(t1.v,t2.v)"]
    dcs = [dc(t) for t in rules]
    for target, use in (("s", dcs[:2]), ("v", dcs[2:])):
        made = constrained.fill_attribute(true.drop(target), true, target, use, [1000.0] * len(use), Settings(seed=1, sampler=sampler))
        rows = sorted((r.asDict() for r in made.collect()), key=lambda r: r["tid"])
        assert len(rows) == 600
        if target == "s":
            assert not any(r["s"] == "a" for r in rows)
            assert max(Counter(r["g"] for r in rows if r["s"] == "b").values(), default=0) <= 1
        elif sampler == "default":
            # in the order of tid with few values the least violating is taken where none is clean
            assert violations.count_violations(made, use[0]).first()[0] < violations.count_violations(true, use[0]).first()[0] / 4


def test_every_value_can_be_drawn(spark):
    true = spark.createDataFrame([(i, i % 40, 0) for i in range(4000)], "tid long, a int, b int")
    for dcs in ([], [dc("t1&t2&EQ(t1.b,t2.b)&LT(t1.a,t2.a)")]):
        made = constrained.fill_attribute(true.select("tid", "b"), true, "a", dcs, [0.0] * len(dcs), Settings(seed=2))
        found = Counter(r.a for r in made.collect())
        assert len(found) == 40 and max(found.values()) < 200
    paged = constrained.fill_attribute(true.select("tid", "b"), true, "a", dcs, [0.0], Settings(seed=2, page=20))
    assert len({r.a for r in paged.collect()}) == 20


@pytest.mark.parametrize("sampler", ["default", "ar"])
@pytest.mark.parametrize("text, weight", [("t1&GT(t1.a,1000)", 1000.0), ("t1&t2&EQ(t1.b,t2.b)&EQ(t1.a,t2.a)", 0.0001), ("t1&t2&EQ(t1.b,t2.b)&GT(t1.a,t2.x)", 1000.0), ("t1&t2&EQ(t1.c,t2.c)&LT(t1.a,t2.x)", 1000.0)])
def test_rules_that_say_nothing_leave_the_shares_alone(spark, text, weight, sampler):
    """A rule that nothing violates, or of no weight, on rows by themselves, keys of two rows, or many."""
    true = spark.createDataFrame([(i, i % 40, i // 2, -1, i % 3) for i in range(4000)], "tid long, a int, b int, x int, c int")
    made = constrained.fill_attribute(true.drop("a"), true, "a", [dc(text)], [weight], Settings(seed=2, sampler=sampler), parents=())
    found = Counter(r.a for r in made.collect())
    assert sum(found.values()) == 4000 and len(found) == 40 and 50 < min(found.values()) and max(found.values()) < 160


def test_refused_draws_follow_the_law_of_what_is_accepted(spark):
    """A value in 2000 is allowed: 300 draws seldom meet it, and it must be taken all the same."""
    true = spark.createDataFrame([(i, int(i == 0), i % 2) for i in range(2000)], "tid long, a int, b int")
    rule = dc("t1&EQ(t1.a,0)")
    made = constrained.fill_attribute(true.drop("a"), true, "a", [rule], [1000.0], Settings(seed=2, sampler="ar"), parents=())
    assert {r.a for r in made.collect()} == {1}


def test_rows_carry_no_domain(spark):
    """Bytes that are shuffled don't grow with the domain times the rows."""
    for size in (50, 5000):
        true = spark.range(20_000).selectExpr("id AS tid", f"CAST(id % {size} AS INT) AS a", "CAST(id % 1000 AS INT) AS b")
        made = constrained.fill_attribute(true.drop("a"), true, "a", [dc("t1&t2&EQ(t1.b,t2.b)&EQ(t1.a,t2.a)")], [0.5], Settings(seed=2), parents=())
        fields = made._jdf.queryExecution().optimizedPlan().toString()
        assert "array" not in fields and "collect_list" not in fields
        assert made.groupBy("a").count().count() > size * 0.9


def test_sequences_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        test_fill_is_the_plain_sampler(spark, 0)
        test_fill_is_the_plain_sampler(spark, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mcmc_redraws_given_all_rows(spark):
    """A rule that forbids equal values of neighbours in g: redrawn cells keep it."""
    true = spark.createDataFrame([(i, i // 4, i % 9) for i in range(400)], "tid long, g int, v int")
    rule = dc("t1&t2&EQ(t1.g,t2.g)&EQ(t1.v,t2.v)")
    made = constrained.fill_attribute(true.select("tid", "g"), true.withColumn("g", true.g * 0), "v", [rule], [1000.0], Settings(seed=3, sampler="mcmc", steps=2.5), parents=())
    assert made.count() == 400 and violations.count_violations(made, rule).first()[0] == 0
    plain = constrained.fill_attribute(true.select("tid", "g"), true, "v", [rule], [1000.0], Settings(seed=3), parents=())
    assert sorted(map(tuple, made.collect())) != sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("k", [0, 3, 6, 9])
def test_mcmc_is_the_plain_gibbs_sampler(spark, k):
    """Every turn, row by row in the order of tid, against all other rows of the key."""
    true = tables(spark, 150)
    dcs, weights, settings = [dc(SHAPES[k]), dc(SHAPES[12])], [0.3, 0.5], Settings(seed=4, sampler="mcmc", steps=1.4)
    syn = true.drop("v")
    start = {r.tid: r.v for r in constrained.fill_attribute(syn, true, "v", dcs, weights, Settings(seed=4), parents=("g",)).collect()}
    got = {r.tid: r.v for r in constrained.fill_attribute(syn, true, "v", dcs, weights, settings, parents=("g",)).collect()}
    counts = Counter((r.g, r.v) for r in true.collect())
    cells = {g: sorted(((n / sum(m for (h, _), m in counts.items() if h == g), v) for (h, v), n in counts.items() if h == g), reverse=True) for g in range(4)}
    rows = {r.tid: {**r.asDict(), "v": start[r.tid]} for r in syn.collect()}
    keys = constrained.sequence_keys(dcs, "v")
    for turn in range(2):
        for tid in sorted(rows):
            if turn and keyed(4, "mcmc.v", tid) >= settings.steps - 1:
                continue
            row = rows[tid]
            others = [r for t, r in rows.items() if t != tid and all(r[c] == row[c] for c in keys)]
            values, p = [v for _, v in cells[row["g"]]], np.array([q for q, _ in cells[row["g"]]])
            q = p * np.array([math.exp(-min(slow_load(dcs, weights, others, {**row, "v": v}), 700.0)) for v in values])
            if any(c.is_fd for c in dcs):
                row["v"] = values[int(np.argmax(q))]
            else:
                cdf = np.cumsum(q) / q.sum()
                row["v"] = values[min(int(np.searchsorted(cdf, keyed(4, f"mcmc.v.{turn}.pick", tid), "right")), len(values) - 1)]
    assert got == {t: r["v"] for t, r in rows.items()}
    assert k == 3 or got != start  # a dependency's best values stay the best


# --- privacy


def test_noise_reaches_every_release(spark):
    true = tables(spark)
    for target, kind in (("s", model.ConditionalHistogram), ("x", model.ConditionalNormal)):
        bounds = {"bounds": (0.0, 40.0)} if kind is model.ConditionalNormal else {}
        fits = [{tuple(r[: -1 if kind is model.ConditionalNormal else 2]) for r in kind(target, ("g",), sigma, seed=1, domains={"g": [0, 1, 2, 3, 77]}, **bounds).fit(true).collect()} for sigma in (1.0, 50.0)]
        assert not fits[0] & fits[1] or kind is model.ConditionalHistogram
        assert all(any(r[0] == 77 for r in f) for f in fits)  # empty cells of the given domain are released, too
    p = [{(r.g, r.val): r.p for r in model.ConditionalHistogram("s", ("g",), sigma, 0.0, 1).fit(true).collect()} for sigma in (0.0, 1.0, 50.0)]
    assert all(a[k] != b[k] for a, b in itertools.combinations(p, 2) for k in a)
    assert len({model.most_informative(true, "v", ["g", "s", "x"], 1e3, seed, sizes={"v": 6, "g": 4, "s": 3, "x": 41}) for seed in range(12)}) > 1


def test_private_run_tells_what_it_spent(spark):
    true = tables(spark)
    made, spent = constrained.synthesize_private(true, [dc("t1&t2&EQ(t1.g,t2.g)&IQ(t1.s,t2.s)")], [1000.0], ["g", "s", "x", "y"], 2.0)
    assert made.count() == 400 and spent.releases == 7 and 1.9 < spent.epsilon <= 2.0 and spent.delta == 1e-4
    assert math.isclose(privacy.composed_epsilon([(1.0, spent.multiplier, 7)], 1e-4), spent.epsilon)
    looser, _ = constrained.private_settings(400, 4, 8.0, 1e-4)
    tighter, _ = constrained.private_settings(400, 4, 0.5, 1e-4)
    assert tighter.sigma_first > looser.sigma_first and tighter.sigma_model > looser.sigma_model and tighter.sigma_choice > looser.sigma_choice


def test_accountant():
    """One Gaussian release: the conversion from Renyi orders is close to the exact epsilon of the Gaussian mechanism."""
    phi = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
    for z, delta in ((1.0, 1e-5), (4.0, 1e-5), (20.0, 1e-6)):
        eps = privacy.composed_epsilon([(1.0, z, 1)], delta)
        exact = lambda e: phi(1 / (2 * z) - e * z) - math.exp(e) * phi(-1 / (2 * z) - e * z)  # noqa: B023, E731
        assert exact(eps) <= delta and exact(eps * 0.7) > delta
    assert privacy.delta_for(32561) == 1e-6 and privacy.delta_for(400) == 1e-4
    assert math.isclose(privacy.gaussian_sigma(0.1, 1e-6), math.sqrt(2 * 2 * math.log(1.25e6)) / 0.1)
    assert math.isclose(privacy.gaussian_sigma(0.4, 1e-6, 1.0) * 0.4, math.sqrt(2 * math.log(1.25e6)))
    small, big = (privacy.training_epsilon(32561, 23, 1.1, k, 15, 1e-6) for k in (100, 1600))
    assert 0 < small < big < privacy.total_epsilon(32561, 23, 1.1, 1600, 15, 1e-6, [50.0])
