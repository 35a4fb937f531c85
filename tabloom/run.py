"""A whole run: a table, its constraints and weights in; a synthetic table and its reports out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions import privacy
from tabloom.operators import constrained, evaluate, learning
from tabloom.operators.constrained import Settings
from tabloom.plans import datasets
from tabloom.sources import files, tables
from tabloom.sources.store import Store


def run(
    spark: SparkSession,
    name: str,
    data: str,
    constraints: str,
    out: str,
    weights: str | None = None,
    epsilon: float | None = None,
    settings: Settings = Settings(),
    targets: Sequence[evaluate.Target] | None = None,
    random_order: bool = False,
    logs: str | None = None,
    resume: str | None = None,
) -> dict[str, DataFrame]:
    """Synthesize the table at `data` (CSV or Parquet) and report on it. Returns the table as ``synthetic`` and the reports by name.

    What is known about the data set of this name (bins, order, targets) is used unless given. Without a weight file, weights are
    learnt from the violations; with `epsilon`, half of it goes to them and the run is private. The table is written below
    `out`, in a folder whose name tells the settings; the log goes to `logs` (on the driver).
    With `resume`, a folder that all executors share, attributes are kept there, and a run that was ended goes on at its attribute."""
    log, started = (files.report_log(logs, name) if logs else None), time.time()

    def say(text: str, *values: object) -> None:
        if log:
            log.info(text, *values)

    true = tables.with_tid(tables.read_csv(spark, data) if data.endswith(".csv") else tables.read_parquet(spark, data))
    columns = [c for c in true.columns if c != "tid"]
    true = true.na.drop()
    dcs = files.read_constraints(constraints)
    settings = replace(settings, bins=settings.bins or datasets.bins_for(name))
    if settings.sequence is None:
        known = datasets.random_sequence(columns, settings.seed) if random_order else datasets.sequence_for(name, columns)
        settings = replace(settings, sequence=known)
    n = true.count()
    delta = privacy.delta_for(n)
    if weights:
        found = files.read_weights(weights, len(dcs))
    else:
        sigma = learning.matrix_sigma(n, len(dcs), epsilon / 2, delta / 2) if epsilon else 0.0
        found = files.toggled(learning.learn_weights(true, dcs, 100, min(128, n), sigma=sigma, seed=settings.seed))
    say("%s: %d rows, %d attributes, weights %s", name, n, len(columns), found)
    store = Store(spark, resume) if resume else None
    if epsilon is None:
        made = constrained.synthesize(true, dcs, found, columns, n, settings, store=store)
    else:
        share = 1.0 if weights else 0.5
        made, spent = constrained.synthesize_private(true, dcs, found, columns, epsilon * share, delta * share, settings, store)
        say("%s: spent %s", name, spent)
    path = f"{out}/{tables.output_name(name, epsilon, {'sampler': settings.sampler, 'rand': random_order, 'seed': settings.seed})}"
    tables.save_table(made, path, columns=["tid", *columns])
    made = tables.read_parquet(spark, path)
    say("%s: written to %s after %.0f s", name, path, time.time() - started)
    reports = evaluate.evaluate(true, made, dcs, columns, datasets.targets_for(name) if targets is None else targets)
    if log:
        for kind, report in reports.items():
            for row in report.limit(50).collect():
                say("%s: %s %s", name, kind, tuple(row))
    return {"synthetic": made, **reports}
