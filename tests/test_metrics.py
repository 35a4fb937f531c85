"""Classifier metrics against their definitions, and draws that have no SQL."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import evaluate, flows, sampling, transform
from tabloom.operators.constrained import Settings
from tabloom.plans.constraint import DenialConstraint


def test_areas_and_ratios(spark):
    r = random.Random(2)
    rows = [(float(y), round(min(1.0, max(0.0, r.gauss(0.35 + 0.25 * y, 0.2))), 2)) for y in r.choices([0, 1], [3, 1], k=400)]
    scored = spark.createDataFrame([(y, float(p >= 0.5), p) for y, p in rows], "label double, prediction double, p double").repartition(3)
    got = evaluate.metrics(scored)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    tp, fp = sum(p >= 0.5 for p in pos), sum(p >= 0.5 for p in neg)
    assert got["precision"] == pytest.approx(tp / (tp + fp)) and got["recall"] == pytest.approx(tp / len(pos))
    assert got["accuracy"] == pytest.approx((tp + len(neg) - fp) / 400) and got["f1"] == pytest.approx(2 * tp / (2 * tp + fp + len(pos) - tp))
    # the share of pairs that are in order, ties counting half
    pairs = np.array(pos)[:, None] - np.array(neg)[None, :]
    assert got["auroc"] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=1e-6)
    # precision over recall, point by point, straight lines between
    curve = [(0.0, None)]
    for t in sorted({p for _, p in rows}, reverse=True):
        a, b = sum(p >= t for p in pos), sum(p >= t for p in neg)
        curve.append((a / len(pos), a / (a + b)))
    curve[0] = (0.0, curve[1][1])
    assert got["auprc"] == pytest.approx(sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(curve, curve[1:])), abs=0.01)
    report = spark.createDataFrame([("a", "m", *[0.5] * 6), ("a", "n", *[1.0] * 6)], "attr string, model string, accuracy double, precision double, recall double, f1 double, auroc double, auprc double")
    assert tuple(evaluate.mean_over_models(report).first()) == ("a", *[0.75] * 6)


def test_one_class_only(spark):
    got = evaluate.metrics(spark.createDataFrame([(1.0, 1.0, 0.9), (1.0, 0.0, 0.2)], "label double, prediction double, p double"))
    assert got["auroc"] == got["auprc"] == 0.0 and got["recall"] == 0.5 and got["precision"] == 1.0


def test_mixture_has_the_moments_of_the_table(spark):
    r = random.Random(6)
    data = [r.gauss(-20, 2) if r.random() < 0.3 else r.gauss(15, 4) for _ in range(3000)]
    true = spark.createDataFrame([(x,) for x in data], "x double").repartition(3)
    made = [v.x for v in sampling.gaussian_mixture(true, "x", spark.range(4000).withColumnRenamed("id", "tid"), seed=1).collect()]
    assert len(made) == 4000
    assert abs(np.mean(made) - np.mean(data)) < 1.5 and abs(np.std(made) / np.std(data) - 1) < 0.08
    assert abs(np.mean(np.array(made) < -5) - np.mean(np.array(data) < -5)) < 0.05


def test_binary_flow_keeps_the_joint_shares(spark):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        a = r.random() < 0.3
        b = a if r.random() < 0.9 else not a
        rows.append((i, "yes" if a else "no", int(b), r.choice("uvw")))
    true = spark.createDataFrame(rows, "tid long, a string, b int, c string")
    rule = DenialConstraint.parse("t1&t2&EQ(t1.c,t2.c)&IQ(t1.a,t2.a)&EQ(t1.b,t2.b)")
    made, weights = flows.binary_flow(true, [rule], ["a", "b", "c"], ["a", "b"], Settings(seed=3))
    assert made.columns == ["tid", "a", "b", "c"] and made.count() == 1500 and len(weights) == 1
    want, got = (Counter((x.a, x.b) for x in t.collect()) for t in (true, made))
    assert all(abs(want[k] - got[k]) < 120 for k in want | got)


def test_stacked_tables_must_agree(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    with pytest.raises(ValueError):
        transform.stacked(a, a.withColumn("more", F.lit(1)))
    assert transform.stacked(a, a.select("s", "n")).filter("is_synthetic").count() == 1
