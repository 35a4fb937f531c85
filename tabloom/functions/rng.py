"""Random numbers keyed by row, equal for every partitioning and in any engine that has MD5.

A public seed makes runs repeatable, which tests need; noise that must protect privacy needs a secret seed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, key: Column) -> Column:
    """Uniform in (0, 1) from the first 52 bits of MD5('seed|stream|key'), all that a double holds."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def keyed(seed: int, stream: str, key: object) -> float:
    """The same in Python."""
    return (int(hashlib.md5(f"{seed}|{stream}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0


def uniform_sql(seed: int, stream: str, key: str) -> str:
    """The same in DuckDB."""
    return f"((CAST(('0x' || substr(md5('{seed}|{stream}|' || CAST({key} AS VARCHAR)), 1, 13))::UBIGINT AS DOUBLE) + 0.5) / 4503599627370496::DOUBLE)"


def normal(seed: int, stream: str, key: Column) -> Column:
    """Standard normal (Box-Muller)."""
    u, v = uniform(seed, stream + ".u", key), uniform(seed, stream + ".v", key)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def normal_sql(seed: int, stream: str, key: str) -> str:
    u, v = uniform_sql(seed, stream + ".u", key), uniform_sql(seed, stream + ".v", key)
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos(2.0::DOUBLE * pi() * {v}))"


def laplace(seed: int, stream: str, key: Column, scale: float) -> Column:
    """Laplace of the given scale (inverse distribution function)."""
    u = uniform(seed, stream, key) - F.lit(0.5)
    return F.lit(-scale) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def laplace_sql(seed: int, stream: str, key: str, scale: float) -> str:
    u = f"({uniform_sql(seed, stream, key)} - 0.5)"
    return f"({-scale!r}::DOUBLE * sign({u}) * ln(1.0 - 2.0 * abs({u})))"
