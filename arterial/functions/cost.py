"""Link cost and objective terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA, BETA = 0.15, 4.0
#: Flows below this are set to zero after a shift.
SNAP = 1e-8


def _load(x: Column, capacity: Column) -> Column:
    """Flow over capacity; null where there is no capacity."""
    return F.when(capacity > 0, x / capacity)


def bpr(t0: Column, x: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Travel time t0 (1 + alpha (x / capacity)^beta); t0 without capacity."""
    return t0 * (1 + alpha * F.coalesce(F.pow(_load(x, capacity), F.lit(beta)), F.lit(0.0)))


def bpr_derivative(t0: Column, x: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Slope of the travel time; 0 without flow or capacity."""
    slope = t0 * alpha * beta * F.pow(_load(x, capacity), F.lit(beta - 1)) / F.when(capacity > 0, capacity)
    return F.when((x > 0) & (capacity > 0), slope).otherwise(F.lit(0.0))


def marginal_cost(t0: Column, x: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Cost that one more unit brings to all: the gradient of total time."""
    return bpr(t0, x, capacity, alpha * (1 + beta), beta)


def beckmann_term(t0: Column, x: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Integral of the travel time from 0 to x."""
    return x * bpr(t0, x, capacity, alpha / (beta + 1), beta)


def total_time_term(t0: Column, x: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return x * bpr(t0, x, capacity, alpha, beta)


def reduced_cost(cost: Column, dist_u: Column, dist_v: Column) -> Column:
    return cost + dist_u - dist_v


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def snap(x: Column, eps: float = SNAP) -> Column:
    return F.when(x < eps, F.lit(0.0)).otherwise(x)


def relative_change(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (F.abs(a) + 1)


def entropy_term(v: Column) -> Column:
    """v log10 v, 0 where v is not positive."""
    return F.when(v > 0, v * F.log10(F.when(v > 0, v))).otherwise(F.lit(0.0))
