"""Statistical expressions built from native aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .scalar import bounded, col


def complete_pair(x, y) -> tuple[Column, Column]:
    """Both columns, NULL wherever either of them is."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def safe_corr(x, y, over: Window | None = None) -> Column:
    """Pearson correlation of the complete pairs; NULL when a side is constant."""
    a, b = complete_pair(x, y)
    cov, sa, sb = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    if over is not None:
        cov, sa, sb = cov.over(over), sa.over(over), sb.over(over)
    return F.try_divide(cov, sa * sb)


def t_two_sided_p(t, df) -> Column:
    """P(|T| >= |t|) for a Student t with a whole number of degrees of freedom.

    The finite trigonometric series: with a = atan(|t| / sqrt(df)) the central
    probability is a sum of df/2 terms whose ratio is (k-1)/k * cos^2(a).
    """
    t, df = F.abs(col(t)), col(df).cast("int")
    angle = F.atan(t / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(angle), F.lit(2.0))
    odd = (df % 2) == 1

    def series(first: Column, start: int, last: Column) -> Column:
        steps = F.when(last >= start, F.sequence(F.lit(start), last, F.lit(2))).otherwise(
            F.array().cast("array<int>")
        )
        folded = F.aggregate(
            steps,
            F.struct(first.alias("term"), first.alias("total")),
            lambda acc, k: F.struct(
                (acc["term"] * cos2 * (k - 1) / k).alias("term"),
                (acc["total"] + acc["term"] * cos2 * (k - 1) / k).alias("total"),
            ),
        )
        return folded["total"]

    even_mass = F.sin(angle) * series(F.lit(1.0), 2, df - 2)
    odd_tail = F.when(df > 1, F.sin(angle) * series(F.cos(angle), 3, df - 2)).otherwise(F.lit(0.0))
    odd_mass = (angle + odd_tail) * (2.0 / math.pi)
    p = 1.0 - F.when(odd, odd_mass).otherwise(even_mass)
    return F.when(t.isNotNull() & (df >= 1), bounded(p, 0.0, 1.0))


def slope_p_value(r, n) -> Column:
    """Two-sided p of a one-regressor slope from its correlation and sample size."""
    r, n = col(r), col(n)
    t = F.try_divide(F.abs(r) * F.sqrt((n - 2).cast("double")), F.sqrt(F.greatest(1.0 - r * r, F.lit(0.0))))
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(F.abs(r) >= 1.0, F.lit(0.0))
        .otherwise(t_two_sided_p(t, n - 2))
    )
