"""What private releases promise, on neighbouring tables, and their laws."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import constrained, learning, model, sampling
from tabloom.operators.violations import violation_matrix
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse


def test_values_that_do_not_occur_are_released_too(spark):
    true = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "tid long, a int, b int")
    seen = set()
    for seed in range(3):
        settings = constrained.Settings(seed=seed, sigma_first=1e4, domains={"a": list(range(7))}, sequence=("a", "b"))
        seen |= {r.a for r in constrained.synthesize(true, [], [], ["a", "b"], 400, settings).collect()}
    assert seen == set(range(7))
    # a value outside the public domain is not told
    assert {r.value for r in sampling.noisy_histogram(true, "a", 1.0, 1, domain=[0, 9]).collect()} == {0, 9}


def test_sensitivity_of_the_violation_matrix(spark):
    """Exchange one row in every way that a small table allows: the matrix never moves further, and one row can move it by more than the number of rows."""
    dcs = [dc("t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)"), dc("t1&t2&EQ(t1.a,t2.a)&LTE(t1.b,t2.b)"), dc("t1&t2&LTE(t1.a,t2.a)")]
    n, most = 12, 0.0
    r = random.Random(4)
    for turn in range(4):
        base = [(i, 1 if turn == 0 else r.randint(0, 2), r.randint(0, 1)) for i in range(n)]
        other = [(0, 9, 0), *base[1:]]
        found = []
        for rows in (base, other):
            matrix = violation_matrix(spark.createDataFrame(rows, "tid long, a int, b int"), dcs)
            found.append(np.array([x.n for x in matrix.orderBy("dc", "tid").collect()], float))
        most = max(most, float(np.linalg.norm(found[0] - found[1])))
    assert n < most <= learning.matrix_sensitivity(n, len(dcs))
    assert learning.matrix_sigma(100, 4, 1.0, 1e-5) == pytest.approx(2 * learning.matrix_sigma(100, 1, 1.0, 1e-5))


def test_information_of_neighbours(spark):
    """A row that brings a value of its own moves the information by no more than the stated sensitivity, if sizes are public."""
    base = [(i, i % 2, i % 5) for i in range(40)]
    sizes = {"a": 50, "t": 60}
    tables = [base, [(0, 77, 99), *base[1:]], [(0, 0, 4), *base[1:]]]
    g = [model.information(spark.createDataFrame(x, "tid long, a int, t int"), "t", ["a"], sizes=sizes).first().g for x in tables]
    assert max(abs(x - g[0]) for x in g) <= model.information_sensitivity(40)
    with pytest.raises(ValueError):
        model.most_informative(spark.createDataFrame(base, "tid long, a int, t int"), "t", ["a"], sigma=1.0)


def test_sparse_histogram_has_the_law_of_noising_every_cell(spark):
    true = spark.createDataFrame([(i % 5, "xy"[i % 2]) for i in range(200)] + [(99, "x"), (1, "?")], "a int, b string")
    domains, sigma, least = {"a": range(0, 4000, 1), "b": ["x", "y", "z"]}, 3.0, 6.0
    passes = 0.5 * math.erfc(least / sigma / math.sqrt(2))
    counts = Counter((r.a, r.b) for r in true.collect() if r.b in "xyz")
    risen, values = [], []
    for seed in range(6):
        got = sampling.sparse_private_histogram(true, domains, sigma, least, seed).collect()
        assert len({(r.a, r.b) for r in got}) == len(got) and all(r.noisy >= least and 0 <= r.a < 4000 and r.b in "xyz" for r in got)
        assert {(a, b) for (a, b), n in counts.items() if n == 20} <= {(r.a, r.b) for r in got}
        risen.append(sum((r.a, r.b) not in counts for r in got))
        values += [r.noisy / sigma for r in got if (r.a, r.b) not in counts]
        cells = {(r.a, r.b) for r in got if (r.a, r.b) not in counts}
        assert len({b for _, b in cells}) == 3 and max(a for a, _ in cells) > 3000 and min(a for a, _ in cells) < 1000
    empty = 12_000 - len(counts)
    assert abs(sum(risen) - 6 * empty * passes) < 5 * math.sqrt(6 * empty * passes)
    assert len(set(risen)) > 1
    # mean of a normal above its bound: density over tail
    want = math.exp(-((least / sigma) ** 2) / 2) / math.sqrt(2 * math.pi) / passes
    assert abs(sum(values) / len(values) - want) < 0.05


def test_sparse_histogram_of_a_million_million_cells(spark):
    true = spark.range(3000).select((F.col("id") * 7919 % 1_000_000).cast("int").alias("a"), (F.col("id") % 1000).cast("int").alias("b"))
    got = sampling.sparse_private_histogram(true, {"a": range(1_000_000), "b": range(0, 1_000_000)}, 2.0, 11.0, 3)
    n = got.count()
    assert abs(n - 1e12 * 0.5 * math.erfc(5.5 / math.sqrt(2))) < 1500 and got.select("a", "b").distinct().count() == n
    with pytest.raises(ValueError):
        sampling.sparse_private_histogram(true, {"a": range(1 << 40), "b": range(1 << 40)}, 2.0, 11.0)


def test_permutation(spark):
    got = [r[0] for r in spark.range(256).select(sampling.permuted(F.col("id"), 4, 9)).collect()]
    assert sorted(got) == list(range(256)) and got != sorted(got)


def test_skipping_is_poisson_sampling(spark):
    steps, rows, rate = 300, 500, 0.06
    got = learning.skip_batches(spark, steps, rate, rows, 5).collect()
    assert len({(r.step, r.rank) for r in got}) == len(got) and all(0 <= r.rank < rows for r in got)
    by_step, by_rank = Counter(r.step for r in got), Counter(r.rank for r in got)
    n = steps * rows * rate
    assert abs(len(got) - n) < 5 * math.sqrt(n)
    spread = sum((by_step[s] - rows * rate) ** 2 for s in range(steps)) / steps
    assert 0.7 < spread / (rows * rate * (1 - rate)) < 1.35
    assert max(by_rank.values()) < 45 and min(by_rank[k] for k in range(rows)) > 2
    assert learning.skip_batches(spark, 2, 1.0, 5).count() == 10 and learning.skip_batches(spark, 2, 0.0, 5).count() == 0


def test_weights_by_skipping_follow_the_closed_form(spark):
    df = spark.createDataFrame([(i, i % 5, i % 3) for i in range(300)], "tid long, k int, c int")
    matrix = violation_matrix(df, [dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.c,t2.c)"), dc("t1&t2&EQ(t1.k,t2.k)&IQ(t1.k,t2.k)")]).cache()
    w = {r.dc: r.weight for r in learning.closed_form_skipping(matrix, 200, 30, 300).collect()}
    expected = sum(learning.learning_rate(s, 200, 1e-4) for s in range(200)) * 0.1 * sum(r.n for r in matrix.filter("dc = 0").collect())
    assert w[1] == 0 and abs(w[0] / expected - 1) < 0.05
