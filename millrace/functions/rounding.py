"""Rounding and time arithmetic that every engine does alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column | str, digits: int = 3) -> Column:
    """Round half towards plus infinity; not-finite values become null."""
    c = F.col(x) if isinstance(x, str) else x
    k = float(10**digits)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.floor(c * k + 0.5).cast("double") / k)


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
