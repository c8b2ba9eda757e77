"""Numeric and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_OFFSET = 1e-10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def from_epoch_ms(c: Column | str) -> Column:
    return F.timestamp_millis(_col(c).cast("bigint"))


def date_parts(c: Column | str) -> dict[str, Column]:
    """hour, day of month, weekday (Monday = 0) and month of a timestamp."""
    ts = _col(c)
    return {"hour": F.hour(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "month": F.month(ts)}


def offset_log(c: Column | str, offset: float = LOG_OFFSET) -> Column:
    """log(x + offset); null where the logarithm does not exist."""
    shifted = _col(c) + F.lit(float(offset))
    return F.when(shifted > 0, F.log(shifted))


def min_max(c: Column | str, low: Column, high: Column, fill: Column | float | None = None) -> Column:
    """(x - low) / (high - low); ``fill`` where the range is empty."""
    value, span = _col(c), high - low
    other = fill if isinstance(fill, Column) else F.lit(fill).cast("double")
    return F.when(value.isNull(), F.lit(None).cast("double")).when(span > 0, (value - low) / span).otherwise(other)


def rank_weight(rank: Column | str) -> Column:
    """Preference weight of a survey rank: 1 -> 1.0 ... 10 -> 0.1, otherwise 0.5."""
    r = _col(rank)
    return F.when(r.between(1, 10), (F.lit(11) - r) / F.lit(10.0)).otherwise(F.lit(0.5))


def log2_discount(rank: Column | str) -> Column:
    return F.lit(1.0) / F.log2(_col(rank) + F.lit(1.0))
