"""Lenient UTC timestamp parsing and the fixed UTC -> IST shift.

Text with an explicit zone (``Z``/``z``, ``UTC``, ``GMT``, ``+00``, ``+0530``,
``+05:30`` ...) is read as that instant; text without a zone is read as UTC
wall-clock time; anything that is not ISO-8601-like (e.g. ``2024/01/01``)
is NULL and the row is later dropped. The IST value is a
``TIMESTAMP_NTZ`` computed from epoch microseconds, so hour, weekday and
date never depend on ``spark.sql.session.timeZone``. Each row is parsed on
its own (no format inferred from the first value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbscope.functions.tags import strip_ws
from curbscope.schema import IST_OFFSET_MICROS

_ZONED = r"(?i)\d:\d{2}(:\d{2}(\.\d*)?)?\s*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$"
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_epoch_micros(text: Column) -> Column:
    s = strip_ws(text)
    s = F.when(s.endswith("z"), F.concat(s.substr(F.lit(1), F.length(s) - 1), F.lit("Z"))) \
        .otherwise(s)
    zoned = F.unix_micros(s.try_cast("timestamp"))
    naive = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), s.try_cast("timestamp_ntz"))
    return F.when(s.rlike(_ZONED), zoned).otherwise(naive)


def ist_timestamp(text: Column) -> Column:
    """UTC text -> naive IST ``TIMESTAMP_NTZ`` (NULL when unparseable)."""
    micros = utc_epoch_micros(text) + F.lit(IST_OFFSET_MICROS)
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH_NTZ))
