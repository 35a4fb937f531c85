"""Blocks of guessed values against the draws of one row after another."""

import numpy as np
import pyarrow as pa
import pytest

from tabloom.operators.constrained import BlockSequencer, Sequencer, Settings, sequence_keys
from tabloom.operators.tally import Counts
from tabloom.plans.constraint import DenialConstraint

dc = DenialConstraint.parse
KEPT = pa.schema([("tid", pa.int64()), ("g", pa.int64()), ("s", pa.string()), ("v", pa.string())])


def batches(rows, keys, turn=None, size=700):
    """What a task is given: shares by s, shares of the domain, rows by keys and tid."""
    r = np.random.default_rng(5)
    told = [(0, s, v, float(p)) for s in "abc" for v, p in zip("pqrtu", r.dirichlet(np.ones(5)))] + [(1, None, v, 0.2) for v in "pqrtu"]
    made = [{"tid": i, "g": int(r.integers(3)), "s": [*"abcd", None][r.integers(5)], "v": "pqrtu"[r.integers(5)]} for i in range(rows)]
    made = sorted(made, key=lambda x: ([str(x[k]) for k in keys], x["tid"]))
    if turn is not None:
        again = {x["tid"]: bool(r.integers(2)) for x in made}
        made = [{**x, "again_": again[x["tid"]], "phase_": k} for k in (0, 1) for x in made if k == 0 or again[x["tid"]]]
        made = sorted(made, key=lambda x: ([str(x[k]) for k in keys], x["phase_"], x["tid"]))
    fields = [("kind_", pa.int32()), ("k0_", pa.string()), ("val_", pa.string()), ("p_", pa.float64()), *[f for f in KEPT if f.name != "v" or turn is not None]]
    schema = pa.schema([*fields, *([("phase_", pa.int32()), ("again_", pa.bool_())] if turn is not None else [])])
    every = [{"kind_": k, "k0_": s, "val_": v, "p_": p} for k, s, v, p in told] + [{"kind_": 2, "k0_": x["s"], **x} for x in made]
    return [pa.RecordBatch.from_pylist([{c: x.get(c) for c in schema.names} for x in every[a : a + size]], schema=schema) for a in range(0, len(every), size)]


SHAPES = [
    (["t1&t2&EQ(t1.g,t2.g)&IQ(t1.v,t2.v)"], [0.02]),
    (["t1&t2&EQ(t1.g,t2.g)&EQ(t1.v,t2.v)&EQ(t1.s,t2.s)"], [0.5]),
    (["t1&t2&EQ(t1.v,t2.v)&EQ(t1.g,t2.g)&IQ(t1.s,t2.s)", "t1&t2&EQ(t1.v,t2.v)&EQ(t1.g,t2.g)"], [0.01, 0.003]),
    (["t1&t2&IQ(t1.v,t2.v)&IQ(t1.s,t2.s)"], [1000.0]),
]


@pytest.mark.parametrize("sampler, turn, page", [("default", None, 0), ("default", None, 2), ("ar", None, 0), ("mcmc", 0, 0)])
@pytest.mark.parametrize("texts, weights", SHAPES)
def test_blocks_as_rows(texts, weights, sampler, turn, page):
    dcs = [dc(t) for t in texts]
    assert all(Counts.fits(c, "v") for c in dcs)
    out, keys = [], sequence_keys(dcs, "v")
    for kind in (Sequencer, BlockSequencer):
        work = kind("v", dcs, weights, Settings(seed=2, sampler=sampler, page=page), False, 0, 1)
        out.append(pa.Table.from_batches(list(work.stream(iter(batches(2000, keys, turn)), keys, KEPT.names, KEPT, turn)), KEPT).to_pylist())
    assert out[0] == out[1]


def test_blocks_are_few():
    """Long sequences are worked out by thousands of rows, not by rows."""
    calls = []

    class Counted(BlockSequencer):
        def chosen(self, load, rows, stream):
            calls.append(len(rows))
            return super().chosen(load, rows, stream)

    work = Counted("v", [dc(SHAPES[0][0][0])], [0.5], Settings(seed=2), False, 0, 1)
    assert sum(b.num_rows for b in work.stream(iter(batches(30_000, ["g"], None, 10_000)), ["g"], KEPT.names, KEPT)) == 30_000
    assert len(calls) < 300


def test_other_constraints_stay_with_rows():
    assert not any(Counts.fits(dc(t), "v") for t in ("t1&t2&EQ(t1.g,t2.g)&LT(t1.v,t2.v)", "t1&t2&EQ(t1.g,t2.v)", "t1&t2&EQ(t1.v,4)", "t1&EQ(t1.v,2)", "t1&t2&EQ(t1.v,t2.v)&IQ(t1.v,t2.v)"))
