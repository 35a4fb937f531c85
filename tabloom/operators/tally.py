"""How many rows seen so far violate a constraint together with a new row, for each value the new row might take.

Used inside tasks by the sequential part of the synthesis; a tally holds the rows of one sequence. Seen rows are t1, the new
row is t2. Rows that agree on the = predicates are found by key; <> predicates are counted by inclusion and exclusion over the
subsets that agree; one or two order predicates are counted by searching sorted runs that double in size. So adding and asking
cost a constant or a few logarithms of the rows seen. Only three or more order predicates compare all seen rows of a key.

A comparison with null never holds. Predicates of one side (constants included) are tested as the row is added or asked for.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd

from tabloom.plans.constraint import DenialConstraint, Predicate

_TEST = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_FLIP = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: Points that are compared outright before they are sorted.
BUFFER = 256


def missing(value: object) -> bool:
    return value is None or value != value


def _array(values: Sequence) -> np.ndarray:
    """Numbers as such, anything else as objects."""
    kinds = {type(v) for v in values}
    if kinds <= {int, bool, np.int64, np.int32}:
        return np.array(values, np.int64)
    if all(issubclass(k, (int, float, np.number)) for k in kinds):
        return np.array(values, np.float64)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _below(points: np.ndarray, asked: np.ndarray, op: str) -> np.ndarray:
    """How many of the sorted points are op each asked value."""
    if op[0] == "<":
        return np.searchsorted(points, asked, "right" if op == "<=" else "left")
    return len(points) - np.searchsorted(points, asked, "left" if op == ">=" else "right")


class _Run:
    """A sorted run of points (a power of two of them); for two dimensions also sorted by the second within halves, quarters, ..."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None):
        order = np.argsort(x, kind="stable")
        self.x, self.levels = x[order], []
        if y is not None:
            y, size = y[order], 1
            while size <= len(y):
                self.levels.append(np.sort(y.reshape(-1, size), axis=1).ravel())
                size *= 2

    def points(self) -> tuple[np.ndarray, np.ndarray | None]:
        return self.x, self.levels[0] if self.levels else None

    def count(self, x, asked: np.ndarray, ops: Sequence[str]) -> np.ndarray:
        """Points op x in the first dimension (one value) and op each asked in the second; with one dimension, op each asked."""
        if not self.levels:
            return _below(self.x, asked, ops[0])
        upto = int(np.searchsorted(self.x, x, "right" if ops[0] in ("<=", ">") else "left"))
        # a suffix is cut into aligned pieces like a prefix
        a, b = (0, upto) if ops[0][0] == "<" else (upto, len(self.x))
        out = np.zeros(len(asked), np.int64)
        while a < b:
            level = min((a & -a).bit_length() - 1 if a else len(self.levels) - 1, (b - a).bit_length() - 1)
            out += _below(self.levels[level][a : a + (1 << level)], asked, ops[1])
            a += 1 << level
        return out


class Points:
    """Points of one or two dimensions that come one by one."""

    def __init__(self, ops: Sequence[str]):
        self.ops, self.buffer, self.runs = tuple(ops), [], []

    def add(self, point: tuple) -> None:
        self.buffer.append(point)
        if len(self.buffer) < BUFFER:
            return
        x = _array([p[0] for p in self.buffer])
        y = _array([p[1] for p in self.buffer]) if len(self.ops) == 2 else None
        self.buffer = []
        run = _Run(x, y)
        while self.runs and len(self.runs[-1].x) == len(run.x):
            (x, y), (u, v) = self.runs.pop().points(), run.points()
            run = _Run(np.concatenate([x, u]), None if y is None else np.concatenate([y, v]))
        self.runs.append(run)

    def count(self, x, asked: np.ndarray) -> np.ndarray:
        out = np.zeros(len(asked), np.int64)
        for run in self.runs:
            out += run.count(x, asked, self.ops)
        if self.buffer:
            recent = self.buffer
            if len(self.ops) == 2:
                test = _TEST[self.ops[0]]
                recent = [p[1:] for p in recent if test(p[0], x)]
            if recent:
                known = _array([p[0] for p in recent])
                out += _TEST[self.ops[-1]](known[:, None], asked[None, :]).astype(bool).sum(0)
        return out


class Compared:
    """Points of three or more dimensions: all are compared."""

    def __init__(self, ops: Sequence[str]):
        self.ops, self.points = tuple(ops), []

    def add(self, point: tuple) -> None:
        self.points.append(point)

    def count(self, asked: Sequence[tuple]) -> np.ndarray:
        columns = [_array(c) for c in zip(*self.points)]
        out = np.zeros(len(asked), np.int64)
        for k, q in enumerate(asked):
            ok = np.ones(len(self.points), bool)
            for c, op, v in zip(columns, self.ops, q):
                ok &= _TEST[op](c, v).astype(bool)
            out[k] = ok.sum()
        return out


class Tally:
    """Violations of one constraint with the rows seen."""

    def __init__(self, dc: DenialConstraint, target: str):
        self.target, self.lone = target, not dc.two_tuple
        self.first, self.second, pairs = [], [], []
        for p in dc.predicates:
            sides = {o.side for o in (p.left, p.right)} - {0}
            if sides == {1, 2}:
                a, b = (p.left, p.right) if p.left.side == 1 else (p.right, p.left)
                pairs.append((str(a.value), p.op if p.left.side == 1 else _FLIP[p.op], str(b.value)))
            else:
                (self.second if self.lone or sides == {2} else self.first).append(p)
        self.nulls1 = {a for a, _, _ in pairs} | {str(o.value) for p in self.first for o in (p.left, p.right) if o.side}
        self.nulls2 = {b for _, _, b in pairs if b != target}
        equal, unequal = [p for p in pairs if p[1] == "="], [p for p in pairs if p[1] == "<>"]
        # where the target is asked for it comes last, so that all its values are searched at once
        orders = sorted((p for p in pairs if p[1] not in ("=", "<>")), key=lambda p: p[2] == target)
        self.dims, self.ops = orders, [op for _, op, _ in orders]
        self.free_dims = sum(b == target for _, _, b in orders)
        self.parts = []
        for k in range(len(unequal) + 1):
            for s in itertools.combinations(unequal, k):
                keys = equal + list(s)
                fixed, free = [p for p in keys if p[2] != target], [p for p in keys if p[2] == target]
                self.parts.append(((-1) ** k, fixed, free, {}))

    def _holds(self, p: Predicate, row: Mapping, value) -> bool:
        sides = [(value if o.value == self.target else row[str(o.value)]) if o.side else o.value for o in (p.left, p.right)]
        return not any(map(missing, sides)) and bool(_TEST[p.op](*sides))

    def add(self, row: Mapping, value, n: int = 1) -> None:
        """A row seen n times more (or -1: once less)."""
        at = lambda a: value if a == self.target else row[a]
        if self.lone or any(missing(at(a)) for a in self.nulls1) or not all(self._holds(p, row, value) for p in self.first):
            return
        point = tuple(at(a) for a, _, _ in self.dims)
        for _, fixed, free, groups in self.parts:
            inner = groups.setdefault(tuple(at(a) for a, _, _ in fixed), {})
            key = tuple(at(a) for a, _, _ in free)
            if not self.dims:
                inner[key] = inner.get(key, 0) + n
                continue
            if key not in inner:
                make = Points if len(self.dims) <= 2 else Compared
                inner[key] = (make(self.ops), make(self.ops))
            inner[key][n < 0].add(point)

    def _held(self, held, row: Mapping, values: Sequence) -> np.ndarray:
        """What the points of one group hold against each value."""
        fixed = [row[b] for _, _, b in self.dims[: len(self.dims) - self.free_dims]]
        out = np.zeros(len(values), np.int64)
        for sign, points in zip((1, -1), held):
            if isinstance(points, Compared):
                if points.points:
                    out += sign * points.count([(*fixed, *[v] * self.free_dims) for v in values])
            elif self.free_dims == 2:
                out += sign * np.array([points.count(v, _array([v]))[0] for v in values], np.int64)
            elif self.free_dims == 1:
                out += sign * points.count(fixed[0] if fixed else None, _array(values))
            else:
                out += sign * int(points.count(fixed[0], _array([fixed[-1]]))[0])
        return out

    def violations(self, row: Mapping, values: Sequence) -> np.ndarray:
        """For each value of the target, the rows seen that violate together with the row."""
        out = np.zeros(len(values), np.int64)
        if any(missing(row[b]) for b in self.nulls2):
            return out
        if self.lone:
            return np.array([all(self._holds(p, row, v) for p in self.second) for v in values], np.int64)
        for sign, fixed, free, groups in self.parts:
            inner = groups.get(tuple(row[b] for _, _, b in fixed))
            if not inner:
                continue
            if not free:
                out += sign * (self._held(inner[()], row, values) if self.dims else inner[()])
            elif not self.dims:
                n = len(free)
                out += [sign * inner.get((v,) * n, 0) for v in values]
            else:
                for k, v in enumerate(values):
                    held = inner.get((v,) * len(free))
                    if held is not None:
                        out[k] += sign * self._held(held, row, [v])[0]
        if self.second:
            out *= np.array([all(self._holds(p, row, v) for p in self.second) for v in values])
        return out


class Counts:
    """Violations of a constraint of = and <> for many rows at once: those with the rows before a block, and those with earlier rows of the block, whose values are guesses.

    A batch of rows is told by `begin`, its blocks by `block`; `accept` adds rows for good, and `end` forgets what other sequences hold."""

    @staticmethod
    def fits(dc: DenialConstraint, target: str) -> bool:
        equal, unequal = set(dc.of("=")), set(dc.of("<>"))
        return dc.symmetric and dc.two_tuple and not equal & unequal and target in equal | unequal

    def __init__(self, dc: DenialConstraint, target: str, width: int):
        equal, unequal = sorted(set(dc.of("=")) - {target}), sorted(set(dc.of("<>")) - {target})
        self.used, self.width, self.agrees = equal + unequal, width, target in dc.of("=")
        self.parts = [((-1) ** k, (*equal, *some)) for k in range(len(unequal) + 1) for some in itertools.combinations(unequal, k)]
        self.held: list[dict] = [{} for _ in self.parts]

    def begin(self, columns: Mapping[str, np.ndarray], rows: int) -> None:
        codes = {a: pd.factorize(columns[a])[0] for a in self.used}
        whole = np.ones(rows, bool)
        for code in codes.values():
            whole &= code >= 0
        self.groups = []
        for (_, fixed), held in zip(self.parts, self.held):
            at = np.zeros(rows, np.int64)
            for a in fixed:
                at = at * (int(codes[a].max(initial=0)) + 1) + np.maximum(codes[a], 0)
                at = np.unique(at, return_inverse=True)[1]
            at[~whole] = -1
            some, first = np.unique(at, return_index=True)
            first = first[some >= 0]
            known = np.full(int(at.max(initial=-1)) + 1, -1, np.int64)
            known[some[some >= 0]] = np.arange(len(first))
            gid = np.where(at >= 0, known[at] if len(known) else at, -1)
            names = [tuple(columns[a][i] for a in fixed) for i in first]
            base = np.zeros((len(names), self.width), np.int64)
            for i, name in enumerate(names):
                if name in held:
                    base[i] = held[name]
            self.groups.append((gid, names, base))

    def block(self, a: int, b: int) -> None:
        self.at, self.sorted = (a, b), []
        for gid, _, _ in self.groups:
            order = np.argsort(gid[a:b], kind="stable")
            order = order[np.searchsorted(gid[a:b][order], 0) :]
            own = gid[a:b][order]
            self.sorted.append((order, own, np.searchsorted(own, own, "left")))

    def violations(self, moved: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """For each row of the block and each value. `moved`: by how much each row changes the number of rows of each value; `before`: what it changes before its own value is asked for."""
        out = np.zeros(moved.shape, np.int64)
        for (sign, _), (_, _, base), (order, own, start) in zip(self.parts, self.groups, self.sorted):
            if not len(order):
                continue
            step = moved[order]
            run = np.cumsum(step, axis=0) - step
            run += base[own] - run[start]
            if before is not None:
                run += before[order]
            out[order] += sign * (run if self.agrees else run.sum(1, keepdims=True) - run)
        return out

    def accept(self, moved: np.ndarray, rows: int) -> None:
        a = self.at[0]
        for gid, _, base in self.groups:
            at = np.flatnonzero(gid[a : a + rows] >= 0)
            np.add.at(base, gid[a : a + rows][at], moved[:rows][at])

    def end(self, keys: Sequence[str], last: tuple | None) -> None:
        """`last`: values of the keys in the last row; None if all rows are of the sequence that was held."""
        for i, ((_, fixed), (_, names, base)) in enumerate(zip(self.parts, self.groups)):
            known = {**self.held[i], **dict(zip(names, base))}
            if last is not None and keys:
                at = [fixed.index(k) for k in keys]
                known = {n: c for n, c in known.items() if tuple(n[j] for j in at) == last}
            self.held[i] = known
