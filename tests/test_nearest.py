"""As-of bounds among earlier rows, in one block and in many."""

import random

import numpy as np
import pytest

from tabloom.operators import dependency, dominance


def expected(rows):
    out, seen = [], {}
    for tid, k, x, v in sorted(rows):
        known = seen.setdefault(k, [])
        low = [(y, -t, w) for t, y, w in known if x is not None and y <= x]
        high = [(y, t, w) for t, y, w in known if x is not None and y >= x]
        out.append((tid, max(low)[2] if low else None, min(high)[2] if high else None))
        if x is not None:
            known.append((tid, x, v))
    return out


@pytest.mark.parametrize("block_rows", [20, 150, 10**6])
@pytest.mark.parametrize("kind", ["double", "string"])
def test_bounds(spark, block_rows, kind):
    r = random.Random(block_rows)
    tids = r.sample(range(5000), 700)
    value = lambda: None if r.random() < 0.05 else (r.randint(0, 60) / 2 if kind == "double" else f"v{r.randint(0, 60):02d}")
    rows = [(t, r.choice(["hot", "hot", "hot", "b", None]), value(), r.random()) for t in tids]
    df = spark.createDataFrame(rows, f"tid long, `k-y` string, x {kind}, v double").repartition(3)
    got = dependency.nearest_earlier(df, ["k-y"], "x", "v", block_rows=block_rows)
    assert got.columns == ["tid", "k-y", "x", "v", "below", "above"]
    assert sorted((g.tid, g.below, g.above) for g in got.collect()) == expected(rows)


def test_empty(spark):
    assert dependency.nearest_earlier(spark.createDataFrame([], "tid long, k int, x double, v double"), ["k"], "x", "v").count() == 0


def test_last_before():
    r = np.random.default_rng(5)
    for high in (4, 60, 10**6):
        p, q = ([r.integers(0, high, n) for _ in range(2)] for n in (300, 250))
        found = dominance.last_before(p, q)
        for k, f in enumerate(found):
            ok = (p[0] < q[0][k]) & (p[1] < q[1][k])
            assert (f == -1) == (not ok.any()) and (f < 0 or (ok[f] and p[1][f] == p[1][ok].max()))
