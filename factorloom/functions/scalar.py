"""Row-level expressions: arithmetic, conditionals, safe division (no window, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
STEP = 8193.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """Cast to double with NaN turned into NULL, so that averages and ranks skip it."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c), c)


def constant(value: float) -> Column:
    return F.lit(float(value))


def add(a, b) -> Column:
    return col(a) + col(b)


def sub(a, b) -> Column:
    return col(a) - col(b)


def mul(a, b) -> Column:
    return col(a) * col(b)


def div(a, b) -> Column:
    """a / b with the divisor kept at least 1e-10 away from zero; b = 0 gives NULL."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / (F.greatest(F.abs(b), F.lit(TINY)) * F.signum(b)))


def maximum(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def holds(cond) -> Column:
    """A condition where NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def where(a, b, cond=None) -> Column:
    a, b = col(a), col(b)
    test = (a > b) if cond is None else (col(cond) > 0)
    return F.when(holds(test), a).otherwise(b)


def absolute(x) -> Column:
    return F.abs(col(x))


def sign(x) -> Column:
    return F.signum(col(x))


def log(x) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(TINY))))


def clip(x, lo: float = -3.0, hi: float = 3.0) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -50.0, 50.0)))


def piecewise(x, threshold: float = 0.0) -> Column:
    return F.coalesce((col(x) > float(threshold)).cast("double"), F.lit(0.0))


def power(x, exponent: float = 2.0) -> Column:
    raised = F.pow(clip(x, -1e10, 1e10), F.lit(float(exponent)))
    return F.when(~F.isnan(raised), raised)


def sqrt(x) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def where_condition(x, cond) -> Column:
    return F.when(col(cond) > 0, col(x))


def sample_weight(x, weight) -> Column:
    return col(x) * F.abs(col(weight))


def ratio(a, b) -> Column:
    """Plain quotient that is NULL on a zero divisor (ANSI mode would fail the job)."""
    return F.try_divide(col(a), col(b))


def bounded(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def steady(x) -> Column:
    """``x`` with 40 significant bits (12 digits): quotients that differ by rounding alone become equal before they are ranked.

    Adding and taking off 2**13 x drops the last bits by plain double arithmetic, the same on every engine.
    """
    x = col(x).cast("double")
    far = x * STEP
    return F.when(F.abs(x) < 1e300, far - (far - x)).otherwise(x)


def rounded(x, digits: int = 6) -> Column:
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)
