"""Roles of attributes and the order in which they are generated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from tabloom.plans.constraint import DenialConstraint

#: Integer attributes of a smaller range than this are treated as categories.
SMALL_RANGE = 200


def relevant(dcs: Sequence[DenialConstraint], done: Iterable[str], attribute: str) -> list[int]:
    """Indices of the constraints that hold `attribute` and whose other attributes are done."""
    known = set(done) | {attribute}
    return [i for i, dc in enumerate(dcs) if attribute in dc.attributes and set(dc.attributes) <= known]


def sequence(columns: Sequence[str], dcs: Sequence[DenialConstraint], domain: Mapping[str, int], bins: Mapping[str, int] | None = None) -> list[str]:
    """Dependencies by their smallest left-hand domain, each one's left then right side by domain size; then the rest by domain size.

    Ties are broken by name. Quantised numeric attributes count with their number of bins."""
    size = {c: (bins or {}).get(c, domain[c]) for c in columns}
    by_size = lambda names: sorted(names, key=lambda c: (size[c], c))
    out: list[str] = []
    fds = sorted((dc for dc in dcs if dc.is_fd), key=lambda dc: min(size[a] for a in dc.of("=")))
    for dc in fds:
        out += [a for a in [*by_size(dc.of("=")), *by_size(dc.of("<>"))] if a not in out]
    return list(dict.fromkeys(out)) + by_size(c for c in columns if c not in out)


def start_categorical(order: Sequence[str], numeric: Iterable[str]) -> list[str]:
    """The same order, but its first attribute that is not numeric moves to the front."""
    first = next((a for a in order if a not in set(numeric)), None)
    return list(order) if first is None else [first, *(a for a in order if a != first)]


def roles(kinds: Mapping[str, str], ranges: Mapping[str, tuple[float, float]], dcs: Sequence[DenialConstraint]) -> dict[str, str]:
    """'numeric' or 'categorical' for each column.

    A number is categorical if a dependency holds it and no other constraint does, or if it is a 64-bit integer whose
    range is below SMALL_RANGE. Types are not changed: order predicates keep comparing numbers."""
    in_fd = {a for dc in dcs if dc.is_fd for a in dc.attributes}
    elsewhere = {a for dc in dcs if not dc.is_fd for a in dc.attributes}
    out = {}
    for c, kind in kinds.items():
        number = kind in ("bigint", "int", "smallint", "tinyint", "double", "float")
        whole = kind in ("bigint", "int", "smallint", "tinyint")
        small = whole and c in ranges and ranges[c][0] is not None and ranges[c][1] - ranges[c][0] < SMALL_RANGE
        out[c] = "numeric" if number and not (small or (c in in_fd and c not in elsewhere)) else "categorical"
    return out
