"""Noise scales and the privacy accountant: Renyi differential privacy of the subsampled Gaussian mechanism.

From the published analyses: Mironov, Talwar and Zhang (2019) for integer orders of the sampled Gaussian mechanism, and
Canonne, Kamath and Steinke (2020) for the conversion to (epsilon, delta).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

ORDERS = tuple(range(2, 65)) + (72, 80, 96, 128, 160, 192, 256, 384, 512)


def delta_for(rows: int) -> float:
    """10 to the minus (number of digits of the row count, plus one)."""
    return 10.0 ** -(len(str(rows)) + 1)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = math.sqrt(2)) -> float:
    """Classical Gaussian mechanism; a histogram changes by one in two cells, hence the default sensitivity."""
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def laplace_scale(epsilon: float, sensitivity: float = 1.0) -> float:
    return sensitivity / epsilon


def _log_add(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def rdp(q: float, sigma: float, order: int) -> float:
    """Renyi divergence of one step: sampling rate q, noise multiplier sigma, integer order."""
    if q == 0:
        return 0.0
    if sigma == 0:
        return math.inf
    if q == 1:
        return order / (2 * sigma**2)
    total = -math.inf
    for k in range(order + 1):
        binomial = math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1)
        total = _log_add(total, binomial + k * math.log(q) + (order - k) * math.log1p(-q) + (k * k - k) / (2 * sigma**2))
    return max(0.0, total / (order - 1))


def composed_epsilon(steps: Iterable[tuple[float, float, int]], delta: float) -> float:
    """Epsilon of a composition of (sampling rate, noise multiplier, repetitions)."""
    steps = list(steps)
    best = math.inf
    for order in ORDERS:
        total = sum(n * rdp(q, sigma, order) for q, sigma, n in steps)
        best = min(best, total + math.log1p(-1 / order) - (math.log(delta) + math.log(order)) / (order - 1))
    return max(0.0, best)


def training_epsilon(rows: int, batch: int, sigma: float, iterations: int, columns: int, delta: float) -> float:
    """Epsilon of training one model for each attribute but the first."""
    return composed_epsilon([(batch / rows, sigma, iterations * (columns - 1))], delta)


def total_epsilon(rows: int, batch: int, sigma: float, iterations: int, columns: int, delta: float, release_sigmas: Iterable[float] = ()) -> float:
    """With further Gaussian releases of the whole data."""
    return composed_epsilon([(batch / rows, sigma, iterations * (columns - 1)), *((1.0, s, 1) for s in release_sigmas)], delta)


def multiplier_for(epsilon: float, delta: float, releases: int) -> float:
    """The least noise multiplier (to a thousandth) with which so many Gaussian releases of the whole data stay within (epsilon, delta)."""
    low, high = 1e-3, 1.0
    while composed_epsilon([(1.0, high, releases)], delta) > epsilon:
        low, high = high, 2 * high
        if high > 1e9:
            raise ValueError("no noise is enough for this epsilon and delta")
    while high - low > 1e-3 * high:
        middle = (low + high) / 2
        low, high = (low, middle) if composed_epsilon([(1.0, middle, releases)], delta) <= epsilon else (middle, high)
    return high
