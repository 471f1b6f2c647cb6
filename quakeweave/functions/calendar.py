"""Origin times kept as six calendar numbers: validity and signed increments with full rollover.

Seconds stay doubles, as catalogs carry up to twelve decimals and a timestamp six.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeweave.functions.robust import finite

FIELDS = ("year", "month", "day", "hour", "minute", "second")


def _whole(x: Column) -> Column:
    return F.round(x).cast("int")


def _days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def valid_origin(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Whether the six numbers are a real Gregorian date and time of day."""
    numbers = (year, month, day, hour, minute)
    ok = finite(second) & (second >= 0) & (second < 60)
    for x in numbers:
        ok = ok & finite(x) & (F.abs(x - F.round(x)) < 1e-8)
    ok = ok & F.round(month).between(1, 12) & F.round(hour).between(0, 23) & F.round(minute).between(0, 59)
    return F.coalesce(ok & (F.round(day) >= 1) & (F.round(day) <= _days_in_month(F.round(year), F.round(month))), F.lit(False))


def moved_origin(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, increment: Column, decimals: int = 6) -> Column:
    """struct(FIELDS, applied): the origin time moved by increment seconds.

    An increment of zero changes nothing and needs no valid time; an invalid time stays as it is, with applied false.
    """
    ok = valid_origin(year, month, day, hour, minute, second)
    total = _whole(hour) * 3600.0 + _whole(minute) * 60.0 + second + increment
    days = F.floor(total / 86400.0)
    rest = F.round(total - days * 86400.0, decimals)
    over = F.when(rest >= 86400.0, 1).when(rest < 0.0, -1).otherwise(0)
    rest = rest - over * 86400.0
    date = F.date_add(F.make_date(_whole(year), _whole(month), _whole(day)), (days + over).cast("int"))
    h = F.floor(rest / 3600.0)
    m = F.floor((rest - h * 3600.0) / 60.0)
    moves = ok & (increment != 0.0)
    old = (year, month, day, hour, minute, second)
    new = (F.year(date), F.month(date), F.day(date), h, m, rest - h * 3600.0 - m * 60.0)
    cells = [F.when(moves, b.cast("double")).otherwise(a.cast("double")).alias(name) for name, a, b in zip(FIELDS, old, new, strict=True)]
    return F.struct(*cells, (ok | (increment == 0.0)).alias("applied"))
