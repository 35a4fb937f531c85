"""Constraint-aware filling of one attribute after another.

Rows are filled in the order of tid: a row's candidates are reweighted by what they would violate together with earlier
rows (the earlier row as t1, the candidate as t2), times exp(-weight). Rows interact only through two-tuple constraints that
become complete at the target; where all of these compare a common, already generated attribute for equality, rows of
different values never meet, so each value is a sequence of its own and the sequences run in parallel. Only where no such attribute
exists is the whole table one sequence. A sequence is streamed, sorted by tid: a task keeps tallies (order predicates: the values they compare), never rows;
each turn of the mcmc sampler is a pass of its own over the filled rows. Rows carry no candidates: before its rows a task is told the shares of the combinations of parents among them.

Where rows don't interact nothing is sequential: draws are joins on the model, the target of one hard dependency is
its key's best value, and a number in a dependency is its model's mean. Every constraint acts: also those of one tuple, of constants and between different attributes. Candidates
are all that the model gives, unless ``page`` asks for pages of the most likely values; where they all violate, the whole domain.

Three samplers: ``default`` draws from the reweighted candidates, or takes the best one if the target is in a
dependency, and for the first row of the table (not of each sequence); ``ar`` draws a candidate and accepts it with probability exp(-load); ``mcmc`` redraws, after the default pass, a share
of the cells in the order of tid, each given all other rows as they then are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.functions import privacy, rng
from tabloom.functions.rng import keyed
from tabloom.operators import dependency, logistic, sampling, transform
from tabloom.operators.model import ConditionalHistogram, ConditionalNormal, information_sensitivity, most_informative
from tabloom.operators.profile import attribute_roles, attribute_sequence, domains
from tabloom.operators.tally import Counts, Tally
from tabloom.plans import sequence as seq
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.shared import checkpoint
from tabloom.sources.store import Store, content

#: Candidates of a numeric attribute in one attempt, and attempts.
DRAWS, TRIES, AR_TRIES = 20, 3, 300
#: A load beyond this leaves nothing of a probability.
HARD_LOAD = 700.0
#: Rows of a block whose values are guessed at once, cells (rows by values of the target), guesses; values beyond which rows are taken one by one. Below every number that is drawn.
BLOCK, BLOCK_CELLS, GUESSES, WIDE, LEAST = 8192, 1 << 18, 16, 4096, 0.5 / 4503599627370496.0


@dataclass(frozen=True)
class Settings:
    seed: int = 0
    sampler: str = "default"
    #: Share of the cells that the mcmc sampler redraws.
    steps: float = 0.1
    #: Noise of the first attribute's counts, of each model's counts or sums, and of the choice of parents.
    sigma_first: float = 0.0
    sigma_model: float = 0.0
    sigma_choice: float = 0.0
    alpha: float = 0.0
    sequence: tuple[str, ...] | None = None
    bins: Mapping[str, int] = field(default_factory=dict)
    #: Candidates looked at in one of TRIES attempts, most likely first; 0: all that the model gives at once.
    page: int = 0
    #: Generate all attributes of at most two values that no constraint holds as one, then split it again.
    concat: bool = False
    #: What an attribute of few values is drawn from, unless dependencies decide it: the "histogram" given its best parent, or the "logistic" model of all earlier attributes.
    model: str = "histogram"
    #: Passes over the table that train a logistic model, and noise of each one's gradient.
    model_steps: int = 25
    sigma_gradient: float = 0.0
    #: Public domains and bounds; what is not given is taken from the table, and counts as public.
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)


def sequence_keys(dcs: Sequence[DenialConstraint], target: str) -> list[str]:
    """Attributes that all two-tuple constraints compare for equality, without the target."""
    common = [set(dc.of("=")) - {target} for dc in dcs if dc.two_tuple]
    return sorted(set.intersection(*common)) if common else []


class Sequencer:
    """The sequential part: runs inside a task over rows sorted by key and tid."""

    def __init__(self, target: str, dcs: Sequence[DenialConstraint], weights: Sequence[float], settings: Settings, numeric: bool, first: int | None, parents: int = 0):
        self.target, self.dcs, self.weights, self.settings, self.numeric, self.first = target, list(dcs), list(weights), settings, numeric, first
        self.greedy = any(dc.is_fd for dc in dcs)
        self.parents, self.shares, self.sorted, self.model = [f"k{i}_" for i in range(parents)], {}, {}, None

    def learn(self, told: pa.RecordBatch) -> None:
        """Shares of values, for the parents that this task's rows have and for the whole domain (kind 1)."""
        columns = [told.column(c).to_pylist() for c in ("kind_", "val_", "p_", *self.parents)]
        for kind, value, p, *key in zip(*columns):
            self.shares.setdefault(None if kind else tuple(key), []).append((p, value))

    def candidates(self, key: tuple | None) -> tuple[list, np.ndarray]:
        """(values, shares), best first; the whole domain for None and for parents that the model doesn't know."""
        if key not in self.sorted:
            found = sorted(self.shares.get(key, ()), reverse=True)
            if key is not None and not found:
                return self.candidates(None)
            if key is not None and self.settings.page:
                found = found[: self.settings.page * TRIES]
            self.sorted[key] = [v for _, v in found], np.array([p for p, _ in found], float)
        return self.sorted[key]

    def given(self, row: Mapping) -> tuple[list, np.ndarray]:
        if self.model is not None:
            p = self.model.value.shares(np.asarray(row["f_"], np.int64)[None, :])[0]
            order = np.argsort(-p, kind="stable")
            return [self.model.value.values[k] for k in order], p[order]
        return self.candidates(tuple(None if row[k] != row[k] else row[k] for k in self.parents))

    def load(self, seen: Sequence[Tally], row: Mapping, values: Sequence) -> np.ndarray:
        """Weighted violations of each candidate value with the rows seen."""
        total = np.zeros(len(values))
        for tally, w in zip(seen, self.weights):
            total += w * tally.violations(row, values)
        return total

    def pages(self, row: Mapping, tid: int, stream: str) -> Iterator[tuple[list, np.ndarray]]:
        """Candidates (values, probabilities), attempt by attempt."""
        seed, one = self.settings.seed, self.settings.sampler == "ar"
        if self.numeric:
            size = 1 if one else DRAWS
            for attempt in range(AR_TRIES if one else TRIES):
                u = [keyed(seed, f"{stream}.{attempt}.{k}.{h}", tid) for k in range(size) for h in "uv"]
                z = [math.sqrt(-2 * math.log(u[2 * k])) * math.cos(2 * math.pi * u[2 * k + 1]) for k in range(size)]
                spread = (row["sigma_"] or 1e-9) * (attempt + 1)
                p = np.exp(-0.5 * np.array(z) ** 2) / spread
                yield [min(max(row["mu_"] + spread * a, row["lo_"]), row["hi_"]) for a in z], p / p.sum()
            return
        values, p = self.given(row)
        size = self.settings.page or len(values)
        for a in range(0, min(len(values), size * TRIES), size):
            yield values[a : a + size], p[a : a + size]
        yield self.candidates(None)

    def choose(self, seen: Sequence[Tally], row: Mapping, tid: int, stream: str, first: bool = False):
        """A value for one cell. If no candidate the model gives is clean, the whole domain is tried; if that has none either, the
        first page's unweighted shares decide."""
        if self.settings.sampler == "ar" and not self.numeric:
            return self.accept(seen, row, tid, stream)
        fallback = None
        for attempt, (values, p) in enumerate(self.pages(row, tid, stream)):
            fallback = fallback or (values, p)
            load = self.load(seen, row, values)
            if self.settings.sampler == "ar":
                if keyed(self.settings.seed, f"{stream}.accept{attempt}", tid) < math.exp(-min(load[0], HARD_LOAD)):
                    return values[0]
                continue
            q = p * np.exp(-np.minimum(load, HARD_LOAD))
            if q.sum() > 1e-300:
                return self.pick(values, q, tid, stream, first)
        return self.pick(*fallback, tid, stream, first)

    def accept(self, seen: Sequence[Tally], row: Mapping, tid: int, stream: str):
        """Draw and accept with probability exp(-load); each value's load is worked out once. What is accepted in the end has probability p * exp(-load), up to a factor: after
        AR_TRIES refusals it is drawn from that, first among the model's values, then in the whole domain; if nothing can be accepted, from the model's shares."""
        values, p = self.given(row)
        cdf, loads = np.cumsum(p) / np.sum(p), {}
        for attempt in range(AR_TRIES):
            k = min(int(np.searchsorted(cdf, keyed(self.settings.seed, f"{stream}.ar{attempt}", tid), "right")), len(values) - 1)
            if k not in loads:
                loads[k] = math.exp(-min(self.load(seen, row, [values[k]])[0], HARD_LOAD))
            if keyed(self.settings.seed, f"{stream}.accept{attempt}", tid) < loads[k]:
                return values[k]
        for some, share in (values, p), self.candidates(None):
            q = share * np.exp(-np.minimum(self.load(seen, row, some), HARD_LOAD))
            if q.sum() > 1e-300:
                return self.drawn(some, q, tid, stream)
        return self.drawn(values, p, tid, stream)

    def pick(self, values: list, q: np.ndarray, tid: int, stream: str, first: bool):
        if self.greedy or first:
            return values[int(np.argmax(q))]
        return self.drawn(values, q, tid, stream)

    def drawn(self, values: list, q: np.ndarray, tid: int, stream: str):
        cdf = np.cumsum(q) / q.sum()
        return values[min(int(np.searchsorted(cdf, keyed(self.settings.seed, f"{stream}.pick", tid), "right")), len(values) - 1)]

    def stream(self, batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str], kept: pa.Schema, turn: int | None = None) -> Iterator[pa.RecordBatch]:
        """What the task is told of the model, then rows sorted by keys and tid, filled; a sequence starts where the keys change.

        In a `turn` of the mcmc sampler rows are filled already: of each sequence all rows come first, for the tallies, then once more those that are drawn again, in the order of tid,
        each given all other rows as they then are."""
        made, key, seen = "float64" if self.numeric else "object", None, []

        def frame(rows: list[Mapping], like: pd.DataFrame) -> pa.RecordBatch:
            out = {c: pd.Series([r[c] for r in rows], dtype=like[c].dtype) for c in names if c != self.target}
            whole = pd.DataFrame({**out, self.target: pd.Series([r[self.target] for r in rows], dtype=made)})[list(names)]
            return pa.RecordBatch.from_pandas(whole, schema=kept, preserve_index=False)

        for batch in batches:
            if not self.numeric:
                told = batch.column("kind_").to_numpy() < 2
                if told.any():
                    self.learn(batch.filter(pa.array(told)))
                batch = batch.filter(pa.array(~told))
            if not batch.num_rows:
                continue
            pdf = batch.to_pandas()
            out = []
            for row in pdf.to_dict("records"):
                at = tuple(row[k] for k in keys)
                if at != key or not seen:
                    key, seen = at, [Tally(dc, self.target) for dc in self.dcs]
                if turn is None:
                    row[self.target] = self.choose(seen, row, row["tid"], f"fill.{self.target}", row["tid"] == self.first)
                elif row["phase_"]:
                    for tally in seen:
                        tally.add(row, row[self.target], -1)
                    row[self.target] = self.choose(seen, row, row["tid"], f"mcmc.{self.target}.{turn}")
                for tally in seen:
                    tally.add(row, row[self.target])
                if turn is None or row["phase_"] or not row["again_"]:
                    out.append(row)
            yield frame(out, pdf)


class BlockSequencer(Sequencer):
    """The same draws for constraints of = and <> only, many rows at once.

    A row's value depends on earlier rows by counts alone. So the values of a block of rows are guessed, what each row would then draw is worked out for all of them at once, and that is the
    next guess. A row before the first one that changed had its true earlier rows, and so has that one; once none changes, all are what they are one after another. Blocks grow while few guesses suffice and
    shrink else."""

    def learn(self, told: pa.RecordBatch) -> None:
        super().learn(told)
        self.values = list(dict.fromkeys(v for some in self.shares.values() for _, v in some))
        self.index, self.lists, self.counts = {v: i for i, v in enumerate(self.values)}, {}, None

    def listed(self, key: tuple | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pages of candidates (places of values, shares) as `pages` gives them."""
        if key not in self.lists:
            values, p = self.candidates(key)
            at, size = np.array([self.index[v] for v in values], np.int64), (self.settings.sampler != "ar" and self.settings.page) or len(values)
            pages = [(at[a : a + size], p[a : a + size]) for a in range(0, min(len(at), size * TRIES), size)]
            self.lists[key] = [(at, p)] if key is None else pages + self.listed(None)
        return self.lists[key]

    def uniforms(self, stream: str, rows: np.ndarray) -> np.ndarray:
        """Numbers of these rows of the batch, each worked out once."""
        known = self.drawn_.setdefault(stream, np.full(len(self.tids), np.nan))
        for i in rows[np.isnan(known[rows])]:
            known[i] = keyed(self.settings.seed, stream, self.tids[i])
        return known[rows]

    def _by_page(self, rows: np.ndarray, page: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions in `rows`, places of values, shares), together those whose page is of one length."""
        lists = [pages[page] if page < len(pages) else None for pages in self.given_]
        sizes = np.array([-1 if x is None else len(x[0]) for x in lists])[self.parent_[rows]]
        for size in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == size)
            used, which = np.unique(self.parent_[rows[at]], return_inverse=True)
            yield at, np.array([lists[k][0] for k in used])[which], np.array([lists[k][1] for k in used])[which]

    def _picked(self, places: np.ndarray, q: np.ndarray, rows: np.ndarray, stream: str, best: bool) -> np.ndarray:
        lead = np.full(len(rows), best and self.greedy) | (best & (self.leads_[rows]))
        k = np.argmax(q, axis=1)
        if not lead.all():
            rest = np.flatnonzero(~lead)
            cdf = np.cumsum(q[rest], axis=1) / q[rest].sum(1)[:, None]
            k[rest] = np.minimum((cdf <= self.uniforms(f"{stream}.pick", rows[rest])[:, None]).sum(1), q.shape[1] - 1)
        return places[np.arange(len(rows)), k]

    def chosen(self, load: np.ndarray, rows: np.ndarray, stream: str) -> np.ndarray:
        """Places of the values that these rows draw, as `choose`."""
        out, one = np.full(len(rows), -1, np.int64), self.settings.sampler == "ar"
        if one and len(rows):
            self.accepted(load, rows, stream, out)
        for page in range(max(map(len, self.given_))):
            open_ = np.flatnonzero(out < 0)
            for at, places, p in self._by_page(rows[open_], page):
                at = open_[at]
                q = p * np.exp(-np.minimum(np.take_along_axis(load[at], places, 1), HARD_LOAD))
                some = q.sum(1) > 1e-300
                out[at[some]] = self._picked(places[some], q[some], rows[at[some]], stream, not one)
        open_ = np.flatnonzero(out < 0)
        for at, places, p in self._by_page(rows[open_], 0):
            out[open_[at]] = self._picked(places, p, rows[open_[at]], stream, not one)
        return out

    def accepted(self, load: np.ndarray, rows: np.ndarray, stream: str, out: np.ndarray) -> None:
        """Fills in what is drawn and accepted; rows that refuse all are left."""
        for at, places, p in self._by_page(rows, 0):
            chance, cdf = np.exp(-np.minimum(np.take_along_axis(load[at], places, 1), HARD_LOAD)), np.cumsum(p, axis=1) / p.sum(1)[:, None]
            open_ = np.flatnonzero(chance.max(1) > LEAST)  # else each number that is drawn refuses
            for attempt in range(AR_TRIES):
                if not len(open_):
                    break
                of = rows[at[open_]]
                k = np.minimum((cdf[open_] <= self.uniforms(f"{stream}.ar{attempt}", of)[:, None]).sum(1), p.shape[1] - 1)
                yes = self.uniforms(f"{stream}.accept{attempt}", of) < chance[open_, k]
                out[at[open_[yes]]] = places[open_[yes], k[yes]]
                open_ = open_[~yes]

    def settle(self, a: int, b: int, asks: np.ndarray, old: np.ndarray | None, value: np.ndarray, stream: str) -> int:
        """Values of rows a to b of the batch, as far as they are sure; returns how many."""
        size, wide = b - a, len(self.values)
        line, rows = np.arange(size), a + np.flatnonzero(asks[a:b])
        before = None
        if old is not None:
            before = np.zeros((size, wide), np.int64)
            before[rows - a, old[rows]] = -1
        for c in self.counts:
            c.block(a, b)
        guess, moved, sure = (None if old is None else old[a:b].copy()), None, 0
        for turn in range(GUESSES):
            moved = np.zeros((size, wide), np.int64) if before is None else before.copy()
            if guess is not None:
                moved[line, guess] += 1
            load = np.zeros((size, wide))
            for c, w in zip(self.counts, self.weights):
                load += w * c.violations(moved, before)
            now = np.zeros(size, np.int64) if old is None else old[a:b].copy()
            now[rows - a] = self.chosen(load[rows - a], rows, stream)
            if guess is not None:
                other = np.flatnonzero(now != guess)
                sure = int(other[0]) + 1 if len(other) else size
            else:
                sure = 1
            guess = now
            if sure == size:
                break
        value[a : a + sure] = guess[:sure]
        moved = np.zeros((size, wide), np.int64) if before is None else before
        moved[line, guess] += 1
        for c in self.counts:
            c.accept(moved, sure)
        self.size = min(BLOCK, self.size * 2) if sure == size and turn < GUESSES // 2 else max(8, self.size // 2) if sure < size else self.size
        return sure

    def stream(self, batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str], kept: pa.Schema, turn: int | None = None) -> Iterator[pa.RecordBatch]:
        held, self.size = None, 64
        for batch in batches:
            told = batch.column("kind_").to_numpy() < 2
            if told.any():
                self.learn(batch.filter(pa.array(told)))
            batch = batch.filter(pa.array(~told))
            if not batch.num_rows:
                continue
            size = batch.num_rows
            if self.counts is None:
                self.counts = [Counts(dc, self.target, len(self.values)) for dc in self.dcs]
            columns = {c: batch.column(c).to_pandas().to_numpy() for c in {*keys, *self.parents, *(a for c in self.counts for a in c.used)}}
            self.tids, self.drawn_ = batch.column("tid").to_pylist(), {}
            parent = np.zeros(size, np.int64)
            for k in self.parents:
                code = pd.factorize(columns[k])[0] + 1
                parent = np.unique(parent * (int(code.max()) + 1) + code, return_inverse=True)[1]
            _, first, self.parent_ = np.unique(parent, return_index=True, return_inverse=True)
            self.given_ = [self.listed(tuple(None if columns[k][i] is None or columns[k][i] != columns[k][i] else columns[k][i] for k in self.parents)) for i in first]
            self.leads_ = (batch.column("tid").to_numpy() == self.first) if turn is None else np.zeros(size, bool)
            asks, old, stream = np.ones(size, bool), None, f"fill.{self.target}"
            if turn is not None:
                asks, stream = batch.column("phase_").to_numpy() == 1, f"mcmc.{self.target}.{turn}"
                old = np.array([self.index[v] for v in batch.column(self.target).to_pylist()], np.int64)
            for c in self.counts:
                c.begin(columns, size)
            value, at, most = np.zeros(size, np.int64), 0, max(8, BLOCK_CELLS // len(self.values))
            while at < size:
                at += self.settle(at, min(size, at + self.size, at + most), asks, old, value, stream)
            ends = [tuple(columns[k][i] for k in keys) for i in (0, -1)]
            for c in self.counts:
                c.end(keys, None if held == ends[0] == ends[1] else ends[1])
            held = ends[1]
            made = pa.array([self.values[k] for k in value], kept.field(self.target).type)
            out = pa.RecordBatch.from_arrays([made if c == self.target else batch.column(c).cast(kept.field(c).type) for c in names], schema=kept)
            yield out if turn is None else out.filter(pa.array(asks | ~batch.column("again_").to_numpy(zero_copy_only=False)))


def _parents_of(true: DataFrame, target: str, done: Sequence[str], dcs: Sequence[DenialConstraint], settings: Settings, bounds: tuple[float, float] | None) -> tuple[str, ...]:
    """What decides the target by a dependency, else the attribute that tells most about it (not a fraction: it has no repeated values)."""
    kinds = dict(true.dtypes)
    done = [c for c in done if kinds.get(c) not in ("double", "float")]
    fds = [a for dc in dcs if dc.is_fd and dc.plain and target in dc.of("<>") for a in dc.of("=")]
    sizes = None
    if settings.sigma_choice and done and not fds:  # of the public domains; what isn't given counts as public
        known = domains(true, [c for c in [*done, target] if c not in settings.domains])
        sizes = known | {c: len(settings.domains[c]) for c in [*done, target] if c in settings.domains}
    near = None if fds else most_informative(true, target, done, settings.sigma_choice, settings.seed, bounds, sizes)
    return tuple(dict.fromkeys(fds)) or ((near,) if near else ())


def _learner(true: DataFrame, target: str, done: Sequence[str], dcs: Sequence[DenialConstraint], settings: Settings) -> logistic.ConditionalLogistic | None:
    """The model of all earlier attributes, if it is asked for and no dependency decides the target."""
    if settings.model != "logistic" or not done or any(dc.is_fd and target in dc.of("<>") for dc in dcs):
        return None
    kinds = dict(true.dtypes)
    bounds = {c: _bounds(true, c, settings) or (0.0, 0.0) for c in done if kinds[c] in ("double", "float")}
    return logistic.ConditionalLogistic(target, tuple(done), steps=settings.model_steps, sigma=settings.sigma_gradient, seed=settings.seed, domains=settings.domains, bounds=bounds)


def _one_hard_dependency(dcs: Sequence[DenialConstraint], weights: Sequence[float], target: str, parents: Sequence[str]) -> bool:
    """All that acts is hard and says that the parents decide the target: then the first row's choice, the best of its key, is everyone's."""
    return bool(dcs) and all(w >= HARD_LOAD and dc.is_fd and dc.plain and dc.of("<>") == (target,) and set(dc.of("=")) == set(parents) for dc, w in zip(dcs, weights))


def _bounds(true: DataFrame, target: str, settings: Settings) -> tuple[float, float] | None:
    if target in settings.bounds:
        return settings.bounds[target]
    x = F.col(f"`{target}`").cast("double")
    found = true.agg(F.min(x), F.max(x)).first()
    return None if found[0] is None else (found[0], found[1])


def fill_attribute(syn: DataFrame, true: DataFrame, target: str, dcs: Sequence[DenialConstraint], weights: Sequence[float], settings: Settings, numeric: bool = False, parents: Sequence[str] | None = None) -> DataFrame:
    """`syn` (with tid) with one more column, drawn given the attributes it has.

    `dcs` are those that become complete at the target. Without any, draws are joins and nothing is sequential."""
    done = [c for c in syn.columns if c != "tid"]
    lo, hi = (_bounds(true, target, settings) or (0.0, 0.0)) if numeric else (None, None)
    learner = None if numeric or parents is not None else _learner(true, target, done, dcs, settings)
    fitted = learner.fit(true) if learner else None
    if fitted is not None:
        parents = ()  # none is chosen
    parents = tuple(_parents_of(true, target, done, dcs, settings, (lo, hi) if numeric else None) if parents is None else parents)
    named, stream = [F.col(f"`{c}`") for c in syn.columns], f"fill.{target}"
    keys_of = [F.col(f"`{c}`").alias(f"k{i}_") for i, c in enumerate(parents)]
    if numeric:
        model = lambda by: ConditionalNormal(target, by, settings.sigma_model, settings.seed, settings.domains, (lo, hi)).fit(true)
        found = model(parents).select(*keys_of, F.col("mu").alias("mu_"), F.col("sigma").alias("sigma_"))

        def with_model(base: DataFrame) -> DataFrame:
            rows = base.join(found, _same(parents), "left").drop(*[f"k{i}_" for i in range(len(parents))])
            if len(parents) > 1:  # combinations that never occur
                whole = model(()).select(F.col("mu").alias("amu_"), F.col("sigma").alias("asd_"))
                rows = rows.join(F.broadcast(whole)).withColumns({"mu_": F.coalesce("mu_", "amu_"), "sigma_": F.coalesce("sigma_", "asd_")}).drop("amu_", "asd_")
            return rows

        rows = with_model(syn)
        depends = any(dc.is_fd for dc in dcs)  # a number in a dependency takes the mean
        if not dcs or depends:
            x = F.col("mu_") if depends else F.col("mu_") + F.col("sigma_") * rng.normal(settings.seed, stream, F.col("tid"))
            return rows.select(*named, F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))).alias(target))
    else:
        model = ConditionalHistogram(target, parents, settings.sigma_model, settings.alpha, settings.seed, settings.domains)
        plain = replace(model, parents=())
        # all values of one parent occur with some value of the target, unless noise clips them all
        rare = len(parents) > 1 or settings.sigma_model > 0
        if settings.sampler != "ar" and _one_hard_dependency(dcs, weights, target, parents):
            found = model.best(model.fit(true)).select(*keys_of, F.col("val").alias("v_"))
            rows = syn.join(found, _same(parents), "left")
            if rare:
                rows = rows.join(F.broadcast(plain.best(plain.fit(true)).select(F.col("val").alias("a_")))).withColumn("v_", F.coalesce("v_", "a_"))
            return rows.select(*named, F.col("v_").alias(target))
        if fitted is not None:
            f = learner.features(dict(syn.dtypes))
            if not dcs:
                return logistic.drawn(syn, f, rng.uniform(settings.seed, f"{stream}.pick", F.col("tid")), fitted, target, dict(true.dtypes)[target]).select(*named, F.col(f"`{target}`"))
            syn = syn.withColumn("f_", f)
        cells = checkpoint(model.fit(true))
        if not dcs:
            rows = sampling.conditional_draw(syn, cells, parents, target, settings.seed, f"{stream}.pick")
            if rare:
                rows = sampling.draw(rows, sampling.distribution(plain.fit(true), "val", "p"), "a_", settings.seed, f"{stream}.pick")
                rows = rows.withColumn(target, F.coalesce(F.col(f"`{target}`"), F.col("a_")))
            return rows.select(*named, F.col(f"`{target}`"))
    columns = [c for c in syn.columns if c == "tid" or c in done]
    types = ", ".join(f"`{c}` {t}" for c, t in syn.dtypes if c in columns) + f", `{target}` {'double' if numeric else dict(true.dtypes)[target]}"
    keys, names, kept = sequence_keys(dcs, target), [*columns, target], to_arrow_schema(StructType.fromDDL(types))
    counted = not numeric and fitted is None and all(Counts.fits(dc, target) for dc in dcs) and cells.select("val").distinct().limit(WIDE + 1).count() <= WIDE
    work = (BlockSequencer if counted else Sequencer)(target, dcs, weights, settings, numeric, syn.agg(F.min("tid")).first()[0], len(parents))
    if fitted is not None:
        work.model = syn.sparkSession.sparkContext.broadcast(fitted)
    alone = not any(dc.two_tuple for dc in dcs)  # each row is a sequence of its own
    if alone:
        keys = ["tid"]
    by = [F.col(f"`{k}`") for k in keys]
    # the number is given, so that adaptive execution does not merge partitions that are small but slow
    parts = int(syn.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    # rows of equal parents go together if nothing else says where they go, a few salts apart
    near = [F.xxhash64(*[F.col(f"`{c}`") for c in parents], F.pmod("tid", F.lit(SALTS)))] if alone else [F.xxhash64(*by)]

    def streamed(base: DataFrame, turn: int | None = None) -> DataFrame:
        order = [*by, *(["phase_"] if turn is not None else []), "tid"]
        if numeric:
            rows = with_model(base).withColumns({"lo_": F.lit(float(lo)), "hi_": F.lit(float(hi))})
            rows = rows if alone else rows.repartition(parts, *by).sortWithinPartitions(*order)
        else:
            rows = _with_model(base, F.pmod(*near, F.lit(parts)).cast("int") if keys else F.lit(0), parts, parents, cells, whole, dict(true.dtypes)[target])
            rows = rows.repartitionById(parts, "part_").sortWithinPartitions("kind_", *order)
        return rows.mapInArrow(lambda batches: work.stream(batches, keys, names, kept, turn), types)

    whole = None if numeric else plain.fit(true)
    out = streamed(syn)
    sure = int(settings.steps) if settings.sampler == "mcmc" else 0
    for turn in range(sure + (settings.sampler == "mcmc" and settings.steps > sure)):
        # the last turn redraws a share of the cells
        again = F.lit(True) if turn < sure else rng.uniform(settings.seed, f"mcmc.{target}", F.col("tid")) < F.lit(settings.steps - sure)
        base = checkpoint(out).withColumn("again_", again)
        if fitted is not None:
            base = base.withColumn("f_", f)
        out = streamed(base.withColumn("phase_", F.explode(F.when(F.col("again_"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))), turn)
    return out


#: Where rows go by their parents, the partitions that share a combination of parents.
SALTS = 16


def _with_model(syn: DataFrame, part: F.Column, parts: int, parents: Sequence[str], cells: DataFrame, whole: DataFrame, kind: str) -> DataFrame:
    """Rows (kind 2) and, for each of their partitions, the shares that they need: those of the parents' combinations that it holds (kind 0), and of the whole domain (kind 1).

    So a row carries its own values only, whatever the size of the domain."""
    named, ks = [F.col(f"`{c}`") for c in syn.columns], [f"k{i}_" for i in range(len(parents))]
    none = [F.lit(None).cast(t).alias(c) for c, t in syn.dtypes]
    rows = syn.select(part.alias("part_"), F.lit(2).alias("kind_"), *[F.col(f"`{c}`").alias(k) for c, k in zip(parents, ks)], F.lit(None).cast(kind).alias("val_"), F.lit(None).cast("double").alias("p_"), *named)
    asked = rows.select("part_", *[F.col(k).alias(f"a{k}") for k in ks]).distinct()
    on = F.lit(True)
    for c, k in zip(parents, ks):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"a{k}"))
    shares = cells.filter("p > 0")
    if parents:
        told = asked.join(shares, on).select("part_", F.lit(0).alias("kind_"), *[F.col(f"a{k}").alias(k) for k in ks], F.col("val").alias("val_"), F.col("p").alias("p_"), *none)
    else:
        told = shares.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_"), F.lit(0).alias("kind_"), F.col("val").alias("val_"), F.col("p").alias("p_"), *none)
    lacking = [F.lit(None).cast(dict(rows.dtypes)[k]).alias(k) for k in ks]
    every = whole.filter("p > 0").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_"), F.lit(1).alias("kind_"), *lacking, F.col("val").alias("val_"), F.col("p").alias("p_"), *none)
    return rows.unionByName(told).unionByName(every)


def _same(parents: Sequence[str]):
    on = F.lit(True)
    for i, c in enumerate(parents):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"k{i}_"))
    return on


def hard_dependency(syn: DataFrame, true: DataFrame, target: str, keys: Sequence[str], settings: Settings) -> DataFrame:
    """Set-based filling for one hard dependency keys -> target: each key takes the draw of its first row."""
    drawn = fill_attribute(syn, true, target, [], [], settings, parents=tuple(keys))
    return dependency.first_of_key(drawn, keys, target)


def synthesize(true: DataFrame, dcs: Sequence[DenialConstraint], weights: Sequence[float], columns: Sequence[str], n: int | None = None, settings: Settings = Settings(), start: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    """A synthetic table (tid and `columns`) of n rows, attribute by attribute in a constraint-aware order.

    With `start` (tid and the first attributes) it continues from there. Each attribute is checkpointed, so plans stay short; with a `store` it is kept there under all that decides it
    (contents of the tables, constraints, weights, settings, attributes so far), so that the same run, started again, goes on at the attribute at which it was ended."""
    if len(weights) != len(dcs):
        raise ValueError("one weight for each constraint")
    true = checkpoint(true.select(*[F.col(f"`{c}`") for c in columns]).na.drop())
    roles = attribute_roles(true, dcs, columns)
    numeric = [c for c in columns if roles[c] == "numeric"]
    order = list(settings.sequence or seq.start_categorical(attribute_sequence(true, dcs, columns, settings.bins), numeric))
    small = []
    if settings.concat and start is None:
        sizes, held = domains(true, columns), {a for dc in dcs for a in dc.attributes}
        small = [c for c in order[1:] if sizes[c] <= 2 and c not in held]
    if len(small) > 1:
        kinds, joint = dict(true.dtypes), "_".join(small)
        true = checkpoint(transform.concatenated(true, small, joint))
        order = [joint if c == small[-1] else c for c in order if c not in small[:-1]]
        numeric = [c for c in numeric if c not in small]
    known = {"true": content(true), "columns": columns, "dcs": [str(dc) for dc in dcs], "weights": list(weights), "settings": repr(settings), "order": order, "start": None if start is None else content(start)} if store else {}

    def kept(upto: str, make: Callable[[], DataFrame]) -> DataFrame:
        return store.get(known | {"n": n, "upto": upto}, make) if store else checkpoint(make())

    if start is None:
        n = true.count() if n is None else n
        first = lambda: sampling.first_attribute(true.sparkSession, true, order[0], n, settings.sigma_first, settings.seed, settings.domains.get(order[0])).select("tid", order[0])
        syn = kept(order[0], first) if store else first()
    else:
        syn = start
        order = [c for c in syn.columns if c != "tid"] + [c for c in order if c not in syn.columns]
    for target in order:
        if target in syn.columns:
            continue
        use = seq.relevant(dcs, [c for c in syn.columns if c != "tid"], target)
        syn = kept(target, lambda: fill_attribute(syn, true, target, [dcs[i] for i in use], [weights[i] for i in use], settings, target in numeric))  # noqa: B023
    if len(small) > 1:
        syn = transform.split_again(syn, joint, small).withColumns({c: F.col(f"`{c}`").try_cast(kinds[c]) for c in small})
    return syn.select("tid", *[F.col(f"`{c}`") for c in columns])


@dataclass(frozen=True)
class Release:
    """What a private run spent."""

    epsilon: float
    delta: float
    #: Noise multiplier (noise over sensitivity) of every release, and their number.
    multiplier: float
    releases: int


def private_settings(rows: int, columns: int, epsilon: float, delta: float, settings: Settings = Settings()) -> tuple[Settings, Release]:
    """Noise for a run of `columns` attributes that spends at most (epsilon, delta), rows being exchanged.

    Released are the first attribute's counts and, for each further attribute, the choice of its parent and its model, or each step of a logistic model's training. All get
    the same multiple of their sensitivity, the least that the accountant allows. The number of rows, the domains, the bounds, and
    with them roles and order, are public."""
    releases = 1 + max(2, settings.model_steps if settings.model == "logistic" else 0) * (columns - 1)
    multiplier = privacy.multiplier_for(epsilon, delta, releases)
    # a row leaves one cell and enters another; it changes a count, a sum and a sum of squares by one at most, each twice
    noisy = replace(
        settings,
        sigma_first=multiplier * math.sqrt(2),
        sigma_model=multiplier * math.sqrt(6),
        sigma_gradient=multiplier * 2 * logistic.ConditionalLogistic.clip,
        sigma_choice=multiplier * math.sqrt(columns - 1 or 1) * information_sensitivity(rows),
    )
    return noisy, Release(privacy.composed_epsilon([(1.0, multiplier, releases)], delta), delta, multiplier, releases)


def synthesize_private(true: DataFrame, dcs: Sequence[DenialConstraint], weights: Sequence[float], columns: Sequence[str], epsilon: float, delta: float | None = None, settings: Settings = Settings(), store: Store | None = None) -> tuple[DataFrame, Release]:
    """A table as `synthesize` makes it, all of whose models are noisy, and what that spent."""
    rows = true.select(*[F.col(f"`{c}`") for c in columns]).na.drop().count()
    noisy, spent = private_settings(rows, len(columns), epsilon, privacy.delta_for(rows) if delta is None else delta, settings)
    return synthesize(true, dcs, weights, columns, rows, noisy, store=store), spent
