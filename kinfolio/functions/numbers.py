"""Closed forms: intervals, tests, correctness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null without observations."""
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    centre, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre - width) / (1 + z * z / n)), F.when(n > 0, (centre + width) / (1 + z * z / n))


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), margin))))


def signed_margin(label: Column, margin: Column) -> Column:
    return F.when(label == 1, margin).otherwise(-margin)


def correctness(signed: Column, *, tie: float = 0.5) -> Column:
    """1, 0, and ``tie`` for a margin of 0 (0.5 or 1 by convention)."""
    return F.when(signed > 0, 1.0).when(signed < 0, 0.0).otherwise(F.lit(tie))


def prefix_size(n: int | Column, fraction: Column) -> Column:
    """Rows seen at a fraction, half to even."""
    return F.bround((n if isinstance(n, Column) else F.lit(n)) * fraction, 0).cast("int")


def event_time(processed: Column, position: Column, n: Column) -> Column:
    return processed / n - (position + 0.5) / n


def event_bin(time: Column, edges: tuple[float, ...] = (-0.8, -0.4, -0.1, 0.1, 0.4, 0.8)) -> Column:
    """The left-closed bin of a time, which is clipped into the edges."""
    t = F.least(F.lit(edges[-1] - 1e-6), F.greatest(F.lit(edges[0] + 1e-6), time))
    out = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        out = F.when(t >= e, i).otherwise(out)
    return out


def mcnemar_exact(first_only: int, second_only: int) -> float:
    """Two-sided exact binomial p of two discordant counts."""
    n, k = first_only + second_only, min(first_only, second_only)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance
