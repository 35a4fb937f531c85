"""Constraint files, weight files, run reports and model caches: small files, read and written on the driver."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from tabloom.plans.constraint import DenialConstraint, from_discovery, parse_all

HARD = 1000.0


def read_constraints(path: str) -> list[DenialConstraint]:
    return parse_all(Path(path).read_text().splitlines())


def write_constraints(path: str, dcs: Sequence[DenialConstraint]) -> None:
    Path(path).write_text("".join(f"{dc}\n" for dc in dcs))


def import_discovered(path: str) -> list[DenialConstraint]:
    return [from_discovery(x) for x in Path(path).read_text().splitlines() if x.strip()]


def parse_weights(text: str, expected: int | None = None) -> list[float]:
    """The numbers below the line ``++``; what is above is a free header."""
    lines = text.splitlines()
    below = lines[lines.index("++") + 1 :] if "++" in lines else lines
    out = [float(x) for x in below if x.strip()]
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} weights for {expected} constraints")
    return out


def read_weights(path: str, expected: int | None = None) -> list[float]:
    return parse_weights(Path(path).read_text(), expected)


def write_weights(path: str, weights: Sequence[float], header: dict[str, object] | None = None) -> None:
    head = "".join(f"{k}\t{v}\n" for k, v in (header or {}).items())
    Path(path).write_text(head + "++\n" + "\n".join(repr(float(w)) for w in weights) + "\n")


def toggled(weights: Sequence[float], least: float = 1e-6) -> list[float]:
    """A constraint that the data never violate (weight near 0) becomes hard."""
    return [HARD if w < least else w for w in weights]


def report_log(folder: str, name: str = "run") -> logging.Logger:
    """A logger that writes to the folder's log file and to standard output."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"tabloom.{name}.{folder}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        for h in (logging.FileHandler(Path(folder) / f"{name}.log"), logging.StreamHandler()):
            h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
            log.addHandler(h)
    return log
