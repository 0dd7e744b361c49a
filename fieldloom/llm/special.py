"""Exact tails of the binomial and the beta law as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series after a shift of 8: relative error below 1e-12."""
    y = x + 8.0
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k): the sum downwards from k, whose terms fall where k < n p; 1 where k >= n p.

    Ten standard deviations below k the terms are below the precision of doubles, so the sum ends there at any n.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_term = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] * (kd - j + 1) / (nd - kd + j) * F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    terms = F.least(k.cast("long"), F.ceil(10 * F.sqrt(nd * p)) + 100).cast("int")
    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), zero, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).when(kd >= nd * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_term) * total))


def beta_below(a: Column, b: Column, x: float) -> Column:
    """P(Beta(a, b) < x) of a, b > 0: the series in x from the mean's far side, all of whose terms are positive and fall; it ends where they are below the precision of doubles."""

    def far(a: Column, b: Column, x: float) -> Column:
        log_front = log_gamma(a + b + 1) - F.log(a + b) - log_gamma(a + 1) - log_gamma(b + 1) + F.log(b) + a * math.log(x) + b * math.log1p(-x)
        zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def step(acc: Column, i: Column) -> Column:
            t = acc["t"] * (a + b + i - 1) / (a + i) * F.lit(x)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        terms = F.ceil(10 * F.sqrt((a + b) / (1 - x))).cast("int") + math.ceil(45 / -math.log(x))
        return F.exp(log_front) * F.aggregate(F.sequence(F.lit(1), terms), zero, step, lambda acc: acc["s"])

    return F.when(a >= (a + b) * x, far(a, b, x)).otherwise(1 - far(b, a, 1 - x))
