"""Numeric helpers: clipping and half-even decimal rounding.

``rint_round(x, n)`` is ``rint(x * 10**n) / 10**n``: round half to even on
the scaled binary value, which is how NumPy rounds ``Series.round(n)``.
Spark's ``round`` (half-up) and ``bround`` (half-even on the shortest decimal
string) both differ from it on some inputs, e.g. 1.015.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """``c`` within bounds; NULL and NaN stay what they are (``least`` and
    ``greatest`` alone would skip a NULL and take NaN for the largest value)."""
    out = c
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(out)


def rint_round(c: Column, digits: int = 0) -> Column:
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)
