"""Text helpers: missing-value spellings and the recommended-action text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbscope import schema as S


def normalize_missing(c: Column) -> Column:
    """Map the usual CSV spellings of "missing" (``''``, ``NA``, ``None``,
    ``nan`` ...) to NULL, as a CSV reader with default NA handling would."""
    return F.when(c.isin(S.NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def recommended_action(junction_fraction: Column, busy_hour_fraction: Column,
                       persistence_ratio: Column, growth_rate: Column) -> Column:
    """Up to four rule texts joined by ``"; "``, else the default text.

    ``concat_ws`` skips the NULLs produced by rules that do not fire.
    """
    joined = F.concat_ws(
        "; ",
        F.when(junction_fraction >= S.ACTION_JUNCTION_MIN, F.lit(S.ACTION_JUNCTION)),
        F.when(busy_hour_fraction >= S.ACTION_BUSY_MIN, F.lit(S.ACTION_BUSY)),
        F.when(persistence_ratio >= S.ACTION_CHRONIC_MIN, F.lit(S.ACTION_CHRONIC)),
        F.when(growth_rate > S.ACTION_EMERGING_ABOVE, F.lit(S.ACTION_EMERGING)),
    )
    return F.when(joined == "", F.lit(S.ACTION_DEFAULT)).otherwise(joined)
