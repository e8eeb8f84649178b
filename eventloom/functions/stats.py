"""Special functions for the small scorecards at the end of experiment jobs.

Everything that is plain arithmetic is a Column; only tail probabilities and searches run as pandas
functions, on one row per (flag, goal, arm).
"""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054
P_FLOOR, BISECTIONS = 1e-12, 60    # fixed values of the always-valid p-value


def z_crit(alpha: float) -> float:
    """Two-sided normal critical value."""
    return Z95 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)


def z_at(p: float) -> float:
    return NormalDist().inv_cdf(p)


def round_to(x: Column, places: int) -> Column:
    """Half away from zero."""
    p = 10.0 ** places
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|)."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) in closed form for a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    for i in range(1, (df + 1) // 2):
        total += math.exp(-h + (i - 0.5) * math.log(h) - math.lgamma(i + 0.5))
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else chi_square_tail(a, int(d)) for a, d in zip(x, df)])


def rho_squared(alpha: float, n_tune: float) -> float:
    a = -2 * math.log(alpha)
    return (a + math.log(a + 1)) / n_tune


def width_factor(n: float, alpha: float, n_tune: float) -> float:
    """Multiplier on the standard error of an always-valid interval."""
    u = n * rho_squared(alpha, n_tune)
    return math.sqrt(2 * (u + 1) / u * math.log(math.sqrt(u + 1) / alpha)) if u > 0 else math.inf


def width_factor_col(n: Column, alpha: float, n_tune: Column) -> Column:
    a = -2 * math.log(alpha)
    u = n * F.lit(a + math.log(a + 1)) / n_tune
    return F.sqrt(2 * (u + 1) / u * F.log(F.sqrt(u + 1) / F.lit(alpha)))


def _always_valid(diff: float, se: float, n: float, n_tune: float) -> float:
    d = abs(diff)
    if not (n > 0 and n_tune > 0 and se > 0 and d > 0):
        return 1.0
    if se * width_factor(n, P_FLOOR, n_tune) <= d:
        return P_FLOOR
    lo, hi = math.log(P_FLOOR), 0.0
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        # at mid = 0 the tuning term vanishes and the interval is unbounded
        if mid >= 0 or se * width_factor(n, math.exp(mid), n_tune) > d:
            lo = mid
        else:
            hi = mid
    p = math.exp((lo + hi) / 2)
    return 1.0 if p >= 1 - 1e-9 else max(p, P_FLOOR)


@F.pandas_udf(DoubleType())
def always_valid_p(diff: pd.Series, se: pd.Series, n: pd.Series, n_tune: pd.Series) -> pd.Series:
    """Smallest alpha at which the confidence sequence excludes zero."""
    return pd.Series([_always_valid(*r) if all(x is not None and x == x for x in r) else 1.0 for r in zip(diff, se, n, n_tune)])


# ---- intervals as Columns ----------------------------------------------------------------------
def wilson(c: Column, n: Column, z) -> tuple[Column, Column]:
    """Wilson bounds in percent, one decimal; zero without trials."""
    z = z if isinstance(z, Column) else F.lit(float(z))
    p, z2 = c / n, z * z
    den = 1 + z2 / n
    mid = (p + z2 / (2 * n)) / den
    half = z / den * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    lo = F.when(n > 0, round_to(F.greatest(F.lit(0.0), mid - half) * 100, 1)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, round_to(F.least(F.lit(1.0), mid + half) * 100, 1)).otherwise(F.lit(0.0))
    return lo, hi


def lift_reason(ct: Column, nt: Column, cc: Column, nc: Column) -> Column:
    """Why a relative interval cannot be given; 'ok' when it can."""
    p2 = cc / nc
    se = F.sqrt(p2 * (1 - p2) / nc)
    return (F.when((nt <= 0) | (nc <= 0), "no_sample").when((ct <= 0) & (cc <= 0), "no_conversions").when(ct <= 0, "test_zero")
            .when(cc <= 0, "control_zero").when((ct >= nt) | (cc >= nc), "saturated").when((se <= 0) | (p2 < 10 * se), "control_near_zero").otherwise("ok"))


def lift(ct: Column, nt: Column, cc: Column, nc: Column, z) -> tuple[Column, Column, Column]:
    """(lo, point, hi) percent of the relative lift on the log-ratio scale; use where lift_reason is 'ok'."""
    z = z if isinstance(z, Column) else F.lit(float(z))
    p1, p2 = ct / nt, cc / nc
    lr = F.log(p1 / p2)
    se = F.sqrt((1 - p1) / (p1 * nt) + (1 - p2) / (p2 * nc))
    return (round_to((F.exp(lr - z * se) - 1) * 100, 1), round_to((p1 / p2 - 1) * 100, 1), round_to((F.exp(lr + z * se) - 1) * 100, 1))


def diff(ct: Column, nt: Column, cc: Column, nc: Column, z) -> tuple[Column, Column, Column]:
    """(lo, point, hi) percentage points: Newcombe's hybrid-score interval from the rounded Wilson bounds."""
    p1, p2 = ct / nt, cc / nc
    l1, u1 = (x / 100 for x in wilson(ct, nt, z))
    l2, u2 = (x / 100 for x in wilson(cc, nc, z))
    lo = (p1 - p2) - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    hi = (p1 - p2) + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return round_to(lo * 100, 1), round_to((p1 - p2) * 100, 1), round_to(hi * 100, 1)


def pooled_z(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """|z| of the pooled two-proportion test; NULL where it is undefined."""
    pool = (c1 + c2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), F.abs(c1 / n1 - c2 / n2) / se)
