"""The model of all earlier attributes: likelihood, privacy, use in synthesis."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tabloom.functions import privacy
from tabloom.operators import constrained, logistic, model, violations
from tabloom.operators.constrained import Settings
from tabloom.operators.logistic import ConditionalLogistic, Fitted
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse


@pytest.fixture(scope="module")
def halves(spark):
    """A target that two attributes and a number decide together, none of them alone."""
    r = random.Random(7)
    rows = []
    for i in range(6000):
        a, b, x = r.randint(0, 5), r.choice("pqrs"), r.random() * 10
        z = [0.8 * a - x / 3, 1.5 * "pqrs".index(b), x / 2 - 0.5 * a, 1.0]
        p = np.exp(np.array(z) - max(z))
        rows.append((i, a, b, x, "uvwz"[int(np.searchsorted(np.cumsum(p / p.sum()), r.random()))]))
    both = spark.createDataFrame(rows, "tid long, a int, b string, x double, t string").repartition(4).cache()
    return both.filter("tid % 3 > 0"), both.filter("tid % 3 = 0")


BOUNDS = {"x": (0.0, 10.0)}


def one_parent(train, held, parent):
    m = model.ConditionalHistogram("t", (parent,), alpha=0.5)
    p = {(getattr(r, parent), r.val): r.p for r in m.fit(train).collect()}
    rows = held.collect()
    return sum(math.log(p.get((getattr(r, parent), r.t), 1e-3)) for r in rows) / len(rows)


def test_better_than_any_one_parent(halves):
    train, held = halves
    m = ConditionalLogistic("t", ("a", "b", "x"), bounds=BOUNDS)
    fitted = m.fit(train)
    assert fitted.values == ["z", "w", "v", "u"] and np.allclose(fitted.shares(np.array([[0, 512, 1024]])).sum(), 1)
    best = max(one_parent(train, held, c) for c in ("a", "b"))
    assert logistic.log_likelihood(held, m, fitted) > best + 0.1
    again = m.fit(train.repartition(7))
    assert np.allclose(again.weights, fitted.weights, atol=1e-6)


def test_gradient_is_that_of_the_likelihood_and_is_clipped(halves):
    train, _ = halves
    m = ConditionalLogistic("t", ("a", "b", "x"), bounds=BOUNDS, clip=1e9)
    labels = {v: k for k, v in enumerate(["z", "w", "v", "u"])}
    rows = train.limit(300).select("t", m.features(dict(train.dtypes)).alias("f")).collect()
    r = np.random.default_rng(1)
    now = Fitted(["z", "w", "v", "u"], r.normal(0, 0.1, (3 * logistic.SLOTS + 1, 4)))
    data = train.sparkSession.createDataFrame([(labels[x.t], list(x.f)) for x in rows], "y int, f array<int>")
    loss = lambda w: -sum(math.log(Fitted(now.values, w).shares(np.array([x.f]))[0, labels[x.t]]) for x in rows)
    got = m._gradient(data, now, m.clip)
    at = rows[0].f[0]
    for place in ((at, 0), (at, 2), (-1, 3), (rows[5].f[1], 1)):
        moved = now.weights.copy()
        moved[place] += 1e-5
        assert got[place] == pytest.approx((loss(moved) - loss(now.weights)) / 1e-5, rel=1e-3, abs=1e-3)
    # exchanging one row moves the clipped sums by no more than twice the clip
    tight = ConditionalLogistic("t", ("a", "b", "x"), bounds=BOUNDS, clip=0.5)
    other = train.sparkSession.createDataFrame([(0, [1, 600, 1030])] + [(labels[x.t], list(x.f)) for x in rows[1:]], "y int, f array<int>")
    assert 0.1 < np.linalg.norm(tight._gradient(data, now, tight.clip) - tight._gradient(other, now, tight.clip)) <= 1.0 + 1e-9


def test_noise_and_bounds(halves):
    train, held = halves
    fits = [ConditionalLogistic("t", ("a", "b", "x"), bounds=BOUNDS, sigma=s, seed=3, steps=8).fit(train).weights for s in (0.0, 5.0, 500.0)]
    assert np.abs(fits[0] - fits[1]).max() > 1e-3 and np.abs(fits[2]).max() > np.abs(fits[0]).max()
    assert ConditionalLogistic("t", (), bounds=BOUNDS).fit(train) is None
    assert ConditionalLogistic("tid", ("a", "b", "x"), bounds=BOUNDS).fit(train) is None or logistic.MOST_WEIGHTS > 4000 * (3 * logistic.SLOTS + 1)
    assert "q" in ConditionalLogistic("t", ("a",), steps=1, domains={"t": ["q", "u", "v", "w", "z"]}).fit(train).values


def test_synthesis_with_it(spark, halves):
    train, _ = halves
    rule = dc("t1&t2&EQ(t1.b,t2.b)&IQ(t1.a,t2.a)&EQ(t1.t,t2.t)")
    settings = Settings(seed=5, model="logistic", bounds=BOUNDS, sequence=("b", "a", "x", "t"))
    columns = ["a", "b", "x", "t"]
    made = constrained.synthesize(train, [], [], columns, 3000, settings)
    rows = made.collect()
    assert len(rows) == 3000
    refilled = constrained.fill_attribute(train.drop("t"), train, "t", [], [], settings).collect()
    for c in ("a", "b"):  # both decide the target, and both are still seen in it
        want, got = (Counter((getattr(r, c), r.t) for r in x) for x in (train.collect(), refilled))
        assert sum(abs(want[k] - got[k]) for k in want | got) / 2 / sum(want.values()) < 0.06
    again = constrained.synthesize(train.repartition(3), [], [], columns, 3000, settings).collect()
    assert sum(a == b for a, b in zip(sorted((r.tid, r.b, r.a) for r in rows), sorted((r.tid, r.b, r.a) for r in again))) > 2950
    ruled = constrained.fill_attribute(made.drop("t").limit(400), train, "t", [rule], [0.5], settings)
    free = constrained.fill_attribute(made.drop("t").limit(400), train, "t", [rule], [0.0], settings)
    assert ruled.columns == ["tid", "a", "b", "x", "t"] and ruled.count() == 400
    assert violations.count_violations(ruled, rule).first()[0] < violations.count_violations(free, rule).first()[0]


def test_private_run_counts_every_step(spark, halves):
    train, _ = halves
    settings = Settings(seed=5, model="logistic", model_steps=4, bounds=BOUNDS, domains={"a": range(6), "b": list("pqrs"), "t": list("uvwz")})
    made, spent = constrained.synthesize_private(train, [], [], ["a", "b", "t"], 3.0, settings=settings)
    assert spent.releases == 1 + 4 * 2 and spent.epsilon <= 3.0
    assert math.isclose(privacy.composed_epsilon([(1.0, spent.multiplier, spent.releases)], spent.delta), spent.epsilon)
    noisy, _ = constrained.private_settings(100, 3, 3.0, 1e-4, settings)
    assert noisy.sigma_gradient == pytest.approx(2 * spent.multiplier, rel=0.3) and made.count() == train.count()
