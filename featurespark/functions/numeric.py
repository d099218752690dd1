"""Equal-width edges, the bin of a value, and bias-corrected moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Right-closed edges: the first is lowered by 0.1% of the range so that the minimum falls inside.

    A constant column is widened by 0.1% of its absolute value (0.001 around zero) on both sides.
    Edges that coincide in floating point are dropped.
    """
    if bins < 1:
        raise DataAccessError("bins must be a positive integer")
    if math.isinf(low) or math.isinf(high):
        raise DataAccessError("equal-width bins need finite values")
    constant = low == high
    if constant:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - margin, high + margin
    step = (high - low) / bins
    edges = [low + index * step for index in range(bins)] + [high]
    if not constant:
        edges[0] -= (high - low) * 0.001
    return distinct_edges(edges)


def distinct_edges(edges: Sequence[float]) -> list[float]:
    values = [float(edge) for edge in edges]
    if any(after < before for before, after in zip(values, values[1:])):
        raise DataAccessError("bin edges must not decrease")
    # Two equal edges are kept: an interval (a, a] is empty but still one interval.
    return values if len(values) == 2 else sorted(set(values))


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Zero-based right-closed interval of a value, null outside; logarithmic in the number of edges."""

    def search(first: int, last: int) -> Column:
        # Answers for values known to lie in (edges[first], edges[last]].
        if last - first == 1:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value <= F.lit(edges[middle]), search(first, middle)).otherwise(search(middle, last))

    if len(edges) < 2:
        return F.lit(None).cast("int")
    inside = (value > F.lit(edges[0])) & (value <= F.lit(edges[-1]))
    return F.when(inside, search(0, len(edges) - 1))


# Below this size a sum of powers counts as zero, as pandas does before dividing by it.
_ROUNDING_FLOOR = 1e-14


def _floored(number: float) -> float:
    return 0.0 if abs(number) < _ROUNDING_FLOOR else number


def sample_std(n: int, m2: float) -> float:
    return math.sqrt(m2 / (n - 1)) if n > 1 else 0.0


def sample_skewness(n: int, m2: float, m3: float) -> float:
    """Bias-corrected skewness from sums of centred powers; zero for up to two values and for constants."""
    m2, m3 = _floored(m2), _floored(m3)
    if n <= 2 or m2 == 0:
        return 0.0
    return n * math.sqrt(n - 1) / (n - 2) * m3 / m2**1.5


def sample_kurtosis(n: int, m2: float, m4: float) -> float:
    """Bias-corrected excess kurtosis from sums of centred powers; zero for up to three values and for constants."""
    if n <= 3:
        return 0.0
    below = _floored((n - 2) * (n - 3) * m2**2)
    if below == 0:
        return 0.0
    above = _floored(n * (n + 1) * (n - 1) * m4)
    return above / below - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
