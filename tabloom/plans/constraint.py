"""Denial constraints: conjunctions of predicates that no pair of rows (or no row) may satisfy."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operator names of the constraint format, and their SQL.
OPERATORS = {"EQ": "=", "IQ": "<>", "LT": "<", "GT": ">", "LTE": "<=", "GTE": ">="}
_NAMES = {v: k for k, v in OPERATORS.items()} | {"!=": "IQ"}
_FLIP = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
_PREDICATE = re.compile(r"(EQ|IQ|LTE|GTE|LT|GT)\((.+)\)\Z")
_SIDE = re.compile(r"(t[12])\.(.+)\Z")


@dataclass(frozen=True)
class Operand:
    """An attribute of tuple 1 or 2, or (side 0) a constant."""

    side: int
    value: str | float | int

    @staticmethod
    def parse(text: str) -> Operand:
        text = text.strip()
        if m := _SIDE.match(text):
            return Operand(int(m[1][1]), m[2])
        if text[:1] in "\"'":
            return Operand(0, text[1:-1])
        number = float(text)
        return Operand(0, int(number) if number.is_integer() and "." not in text else number)

    def column(self, left: str, right: str) -> Column:
        if not self.side:
            return F.lit(self.value)
        return F.col(f"{left if self.side == 1 else right}.`{self.value}`")

    def sql(self, left: str, right: str) -> str:
        if self.side:
            name = str(self.value).replace('"', '""')
            return f'{left if self.side == 1 else right}."{name}"'
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return repr(self.value)

    def __str__(self) -> str:
        return f"t{self.side}.{self.value}" if self.side else (f'"{self.value}"' if isinstance(self.value, str) else str(self.value))


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Operand
    right: Operand

    @property
    def same_attribute(self) -> str | None:
        """The attribute, if this compares one attribute of both tuples."""
        if {self.left.side, self.right.side} == {1, 2} and self.left.value == self.right.value:
            return str(self.left.value)
        return None

    @property
    def oriented(self) -> str:
        """The operator with tuple 1 on the left."""
        return self.op if self.left.side != 2 else _FLIP[self.op]

    def column(self, left: str, right: str) -> Column:
        a, b = self.left.column(left, right), self.right.column(left, right)
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[self.op]

    def sql(self, left: str, right: str) -> str:
        return f"{self.left.sql(left, right)} {self.op} {self.right.sql(left, right)}"

    def __str__(self) -> str:
        return f"{_NAMES[self.op]}({self.left},{self.right})"


@dataclass(frozen=True)
class DenialConstraint:
    predicates: tuple[Predicate, ...]

    @staticmethod
    def parse(text: str) -> DenialConstraint:
        """From ``t1&t2&OP(t1.a,t2.a)&...``; one-tuple constraints and constants are allowed."""
        found = []
        for part in text.strip().split("&"):
            if part in ("t1", "t2"):
                continue
            m = _PREDICATE.match(part)
            if not m:
                raise ValueError(f"not a predicate: {part!r}")
            sides = m[2].split(",")
            if len(sides) != 2:
                raise ValueError(f"a predicate has two operands: {part!r}")
            found.append(Predicate(OPERATORS[m[1]], *map(Operand.parse, sides)))
        if not found:
            raise ValueError("a constraint has at least one predicate")
        return DenialConstraint(tuple(found))

    @property
    def two_tuple(self) -> bool:
        return any(2 in (p.left.side, p.right.side) for p in self.predicates)

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(str(o.value) for p in self.predicates for o in (p.left, p.right) if o.side))

    @property
    def is_fd(self) -> bool:
        """Flagged as a dependency: its operators are = and <>, both present."""
        return {p.op for p in self.predicates} == {"=", "<>"}

    def of(self, *ops: str) -> tuple[str, ...]:
        """Attributes compared with themselves by one of `ops` (tuple 1 on the left)."""
        return tuple(p.same_attribute for p in self.predicates if p.same_attribute and p.oriented in ops)

    @property
    def orders(self) -> tuple[tuple[str, str], ...]:
        return tuple((p.same_attribute, p.oriented) for p in self.predicates if p.same_attribute and p.oriented in ("<", ">", "<=", ">="))

    @property
    def plain(self) -> bool:
        """Every predicate compares one attribute of both tuples."""
        return all(p.same_attribute for p in self.predicates)

    @property
    def symmetric(self) -> bool:
        return self.plain and not self.orders

    def sql(self, left: str = "t1", right: str = "t2") -> str:
        return " AND ".join(p.sql(left, right) for p in self.predicates)

    def column(self, left: str = "t1", right: str = "t2") -> Column:
        out = self.predicates[0].column(left, right)
        for p in self.predicates[1:]:
            out = out & p.column(left, right)
        return out

    def __str__(self) -> str:
        return "&".join((["t1", "t2"] if self.two_tuple else ["t1"]) + [str(p) for p in self.predicates])


def from_discovery(line: str) -> DenialConstraint:
    """From a discovery tool's line: ``t0.a!=t1.a and t0.b<t1.b``."""
    found = []
    for term in line.strip().split(" and "):
        m = re.match(r"(t[01]\..+?)(<=|>=|!=|=|<|>)(t[01]\..+)\Z", term.strip())
        if not m:
            raise ValueError(f"not a term: {term!r}")
        sides = [Operand.parse(f"t{int(x[1]) + 1}{x[2:]}") for x in (m[1], m[3])]
        found.append(Predicate("<>" if m[2] == "!=" else m[2], *sides))
    return DenialConstraint(tuple(found))


def shape(dc: DenialConstraint) -> str:
    """Which strategy counts its violations: one_tuple, counts (no order), grouped_order, order_only or theta."""
    if not dc.two_tuple:
        return "one_tuple"
    if not dc.plain:
        return "theta"
    if not dc.orders:
        return "counts"
    return "grouped_order" if dc.of("=") else "order_only"


def parse_all(lines: Iterable[str]) -> list[DenialConstraint]:
    return [DenialConstraint.parse(x) for x in lines if x.strip()]
