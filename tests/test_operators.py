"""Profiles, marginals, draws, fills, synthesis and learning."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.functions import privacy, rng
from tabloom.operators import constrained, dependency, evaluate, learning, marginals, model, profile, sampling, transform, violations
from tabloom.plans import datasets
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, f"k{i % 5}", f"v{i % 5 % 2}", "abc"[i % 3], float(i % 17)) for i in range(200)], "tid long, k string, v string, c string, x double")


def test_uniforms_do_not_depend_on_partitions(df):
    u = rng.uniform(1, "s", F.col("tid"))
    values = [dict(map(tuple, df.repartition(n).select("tid", u).collect())) for n in (1, 4, 16)]
    assert values[0] == values[1] == values[2]
    assert values[0][7] == constrained.keyed(1, "s", 7)
    z = [r[0] for r in df.select(rng.normal(1, "n", F.col("tid"))).collect()]
    assert abs(sum(z) / 200) < 0.25 and 0.8 < math.sqrt(sum(x * x for x in z) / 200) < 1.2


def test_privacy():
    assert privacy.delta_for(30000) == pytest.approx(1e-6)
    # sampled Gaussian: a published example (MNIST: q 0.01, sigma 4, 10000 steps, delta 1e-5) is about 1.25
    assert 1.0 < privacy.composed_epsilon([(0.01, 4.0, 10000)], 1e-5) < 1.35
    assert privacy.composed_epsilon([(1.0, 1.0, 1)], 1e-5) > privacy.composed_epsilon([(1.0, 2.0, 1)], 1e-5)
    assert privacy.rdp(1.0, 2.0, 8) == pytest.approx(1.0) and privacy.rdp(0.0, 1.0, 4) == 0
    assert privacy.rdp(0.5, 2.0, 8) < privacy.rdp(1.0, 2.0, 8)
    assert privacy.gaussian_sigma(0.1, 1e-6) == pytest.approx(math.sqrt(2 * 2 * math.log(1.25e6)) / 0.1)
    assert privacy.total_epsilon(1000, 10, 1.1, 100, 5, 1e-5, [5.0]) > privacy.training_epsilon(1000, 10, 1.1, 100, 5, 1e-5)


def test_distances(df):
    same = marginals.marginal_report(df, df, ["k", "c", "x"], 2).collect()
    assert len(same) == 3 and all(r.tvd == 0 for r in same)
    other = df.withColumn("k", F.lit("never"))
    assert {r.attrs: r.tvd for r in marginals.marginal_report(df, other, ["k", "c"], 1).collect()} == {"k": 1.0, "c": 0.0}
    with pytest.raises(ValueError):
        transform.stacked(df, df.drop("k"))


def test_bins(spark):
    x = spark.createDataFrame([(0.0,), (0.5,), (16.0,), (15.99,)], "x double")
    assert [r[0] for r in x.select(transform.binned(F.col("x"), 0, 16, 16)).collect()] == [0, 0, 16, 15]
    assert [r[0] for r in x.select(transform.cut(F.col("x"), 0, 16, 16)).collect()] == [0, 0, 15, 15]
    assert {r[0] for r in x.select(transform.binned(F.col("x"), 3, 3, 16)).collect()} == {0}


def test_draws(spark, df):
    dist = sampling.distribution(sampling.noisy_histogram(df, "c"))
    large = sampling.distribution(sampling.noisy_histogram(df, "x"), in_one=4)
    assert [tuple(round(v, 9) for v in r) for r in large.orderBy("value").collect()] == [tuple(round(v, 9) for v in r) for r in sampling.distribution(sampling.noisy_histogram(df, "x")).orderBy("value").collect()]
    assert sorted(map(tuple, sampling.ranked(df.select("tid"), each=30).collect())) == [(i, i) for i in range(200)]
    rows = spark.range(3000).withColumnRenamed("id", "tid")
    for n in (1, 7):
        drawn = sampling.draw(rows.repartition(n), dist, "c", 1, "t")
        counts = Counter(r.c for r in drawn.collect())
        assert sum(counts.values()) == 3000 and all(abs(v - 1000) < 120 for v in counts.values())
    clipped = sampling.noisy_histogram(df, "k", 9.0, 3).collect()
    assert min(r.noisy for r in clipped) >= 0 and len({round(r.noisy - r.n, 3) for r in clipped}) > 2
    assert sampling.subsample(df, 50, 1).count() == 50 and sampling.subsample(df, 500, 1).count() == 200
    assert sampling.upsample(df, 321, 1).count() == 321
    owned = sampling.owner_draw(df.select("tid", "v"), df, "k", "v", 1)
    assert owned.join(df.select("k", F.col("v").alias("true_")).distinct(), "k").filter("v <> true_").count() == 0


def test_generalise_and_restore(df):
    rare = transform.generalised(df, "c", {"k": "ok"}, "k", 14)
    assert rare.filter(F.col("k").endswith("_ok")).count() > 0 and rare.count() == 200
    back = transform.restored(rare, df, "c", "k", "ok")
    assert back.filter(F.col("k").endswith("_ok")).count() == 0 and back.count() == 200
    joined = transform.concatenated(df, ["k", "c"], "kc")
    assert transform.split_again(joined, "kc", ["k", "c"]).select(*df.columns).exceptAll(df).count() == 0


def test_fills(df):
    first = dependency.first_of_key(df, ["k"], "c")
    assert violations.count_violations(first, dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.c,t2.c)")).first()[0] == 0
    assert dict(first.select("k", "c").distinct().collect()) == {f"k{i}": "abc"[i % 3] for i in range(5)}
    assert violations.count_violations(dependency.repaired(df, ["k"], "c"), dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.c,t2.c)")).first()[0] == 0
    rows = df.withColumn("drawn", rng.uniform(1, "d", F.col("tid"))).withColumn("again", rng.uniform(1, "a", F.col("tid")))
    rate = dependency.monotone_fill(rows, ["k"], "x", "drawn", "again", 0.0, 1.0, "rate")
    assert violations.count_violations(rate, dc("t1&t2&EQ(t1.k,t2.k)&GT(t1.x,t2.x)&LT(t1.rate,t2.rate)"), mode="ordered").first()[0] == 0


@pytest.mark.parametrize("sampler", ["default", "ar", "mcmc"])
def test_synthesis(df, sampler):
    dcs = [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)"), dc("t1&t2&EQ(t1.v,t2.v)&EQ(t1.c,t2.c)")]
    settings = constrained.Settings(seed=2, sampler=sampler, bins={"x": 10})
    made = constrained.synthesize(df, dcs, [1000.0, 0.001], ["k", "v", "c", "x"], 150, settings)
    rows = made.collect()
    assert len(rows) == 150 and made.columns == ["tid", "k", "v", "c", "x"] and {r.tid for r in rows} == set(range(150))
    assert violations.count_violations(made, dcs[0]).first()[0] == 0
    assert all(0 <= r.x <= 16 for r in rows)
    again = constrained.synthesize(df.repartition(7), dcs, [1000.0, 0.001], ["k", "v", "c", "x"], 150, settings)
    assert sorted((r.tid, r.k, r.v, r.c) for r in rows) == sorted((r.tid, r.k, r.v, r.c) for r in again.collect())


def test_order_constraint_in_synthesis(df):
    c = dc("t1&t2&EQ(t1.k,t2.k)&LT(t1.c,t2.c)")
    start = df.select("tid", "k").limit(60)
    made = constrained.fill_attribute(start, df, "c", [c], [1000.0], constrained.Settings(seed=1))
    assert violations.count_violations(made, c).first()[0] == 0
    with pytest.raises(ValueError):
        constrained.synthesize(df, [c], [], ["k", "c"])


def test_model(df):
    m = model.ConditionalHistogram("v", ("k",))
    assert {r.k: r.candidates[0].val for r in m.candidates(m.fit(df)).collect()} == {f"k{i}": f"v{i % 2}" for i in range(5)}
    assert model.most_informative(df, "v", ["c", "k"]) == "k" and model.most_informative(df, "v", []) is None


def test_weights(df):
    dcs = [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)"), dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.c,t2.c)")]
    w = learning.learn_weights(df, dcs, 10, 50)
    assert w[0] == 0 and w[1] > 0
    assert learning.learn_weights(df, dcs, 10, 50, mode="likelihood")[0] > learning.learn_weights(df, dcs, 10, 50, mode="likelihood")[1]


def test_reports(df):
    syn = df.withColumn("tid", F.col("tid") + 1000)
    out = evaluate.evaluate(df, syn, [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")], ["k", "v", "c"])
    assert out["violations"].first().n_vio == 0 and out["marginal_2_average"].first().avg_tvd == 0
    report = evaluate.classifier_report(df, syn, [evaluate.Target("v", ("v1",)), evaluate.Target("x", None, 100, 200)], ("tree", "logistic"))
    by = {(r.attr, r.model): r for r in report.collect()}
    assert by["v", "tree"].accuracy == 1.0 and by["x", "tree"].recall == 0.0
    assert evaluate.mean_over_models(report).count() == 2
    assert datasets.bins_for("adult_concat") == {"fnlwgt": 100, "capital-gain": 100, "capital-loss": 100}


def test_profile(df):
    assert profile.domains(df) == {"tid": 200, "k": 5, "v": 2, "c": 3, "x": 17}
    assert profile.attribute_sequence(df, [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")], ["c", "x", "k", "v"]) == ["k", "v", "c", "x"]
    assert profile.uniqueness(df, ["k"]).first() == (200, 5)


def test_monotone_fill_streams_its_keys(spark):
    """No key's rows are gathered in a task, and a row without a number neither binds others nor is bound."""
    rows = spark.createDataFrame([(1, "a", None, 0.9, 0.5), (2, "a", 2.0, 0.95, 0.5), (3, "a", 1.0, 0.97, 0.5), (4, "b", 1.0, 0.99, 0.5), (5, None, 1.0, 0.2, 0.5)], "tid long, k string, x double, drawn double, again double")
    made = dependency.monotone_fill(rows, ["k"], "x", "drawn", "again", 0.0, 1.0, "rate")
    assert {r.tid: r.rate for r in made.collect()} == {1: 0.9, 2: 0.95, 3: 0.475, 4: 0.99, 5: 0.2}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
