"""Calendar and encoding columns: plain Column expressions, no shuffle and no Python in the row path."""
from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25
DAY_HOURS = 24


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_index(day: Column | str, hour: Column | str) -> Column:
    """Hours since 1970-01-01 00:00 of a wall-clock date and hour, independent of the session time zone."""
    return (F.unix_date(_col(day)).cast("bigint") * DAY_HOURS + _col(hour)).cast("bigint")


def weekday_sunday0(day: Column | str) -> Column:
    return (F.dayofweek(_col(day)) - 1).cast("int")


def working_day(weekday: Column | str, holiday: Column | str) -> Column:
    """1 on Monday to Friday unless it is a holiday."""
    return (_col(weekday).between(1, 5) & (_col(holiday) == 0)).cast("int")


def quarter_of_month(month: Column | str) -> Column:
    return (F.floor((_col(month) - 1) / 3) + 1).cast("int")


def calendar_columns(day: Column | str, base_year: int, holidays: Sequence[str]) -> dict[str, Column]:
    """season, yr, mnth, holiday, weekday, workingday of a date column."""
    d = _col(day)
    holiday = d.isin([F.to_date(F.lit(h)) for h in holidays]).cast("int") if holidays else F.lit(0)
    month = F.month(d)
    return {"season": quarter_of_month(month), "yr": (F.year(d) - base_year).cast("int"), "mnth": month.cast("int"),
            "holiday": holiday, "weekday": weekday_sunday0(d), "workingday": working_day(weekday_sunday0(d), holiday)}


def one_hot(c: Column | str, levels: Iterable[int], prefix: str) -> dict[str, Column]:
    """0/1 double columns for the listed levels; the level left out is the reference."""
    return {f"{prefix}{k}": (_col(c) == k).cast("double") for k in levels}


def merge_top(c: Column | str, cap: int) -> Column:
    """Ordinal category with everything above `cap` merged into it."""
    return F.least(_col(c), F.lit(cap))


def impute_fault(c: Column | str, fill: Column | float, fault: float = 0.0) -> Column:
    """Readings equal to the fault value replaced by a value learned elsewhere."""
    value = fill if isinstance(fill, Column) else F.lit(float(fill))
    return F.when(_col(c) == fault, value).otherwise(_col(c))


def linear_trend(day: Column | str, epoch: str) -> Column:
    return F.datediff(_col(day), F.lit(epoch)).cast("double")


def root_trend(day: Column | str, epoch: str) -> Column:
    return F.sqrt(linear_trend(day, epoch))


def hinges(day: Column | str, epoch: str, knots: Sequence[int]) -> dict[str, Column]:
    """Days past each knot, 0 before it."""
    return {f"hinge_{k}": F.greatest(linear_trend(day, epoch) - k, F.lit(0.0)) for k in knots}


def _harmonics(phase: Column, orders: Iterable[int], prefix: str) -> dict[str, Column]:
    out = {}
    for k in orders:
        out[f"{prefix}_s{k}"] = F.sin(phase * k)
        out[f"{prefix}_c{k}"] = F.cos(phase * k)
    return out


def year_harmonics(day: Column | str, orders: Iterable[int] = (1, 2)) -> dict[str, Column]:
    return _harmonics(F.dayofyear(_col(day)) * (2.0 * math.pi / YEAR_DAYS), orders, "doy")


def hour_harmonics(hour: Column | str, orders: Iterable[int] = range(1, 7)) -> dict[str, Column]:
    return _harmonics(_col(hour) * (2.0 * math.pi / DAY_HOURS), orders, "hour")


def day_part(hour: Column | str, starts: Sequence[tuple[int, str]]) -> Column:
    """Label of the last start that is not after the hour; `starts` ascends and begins at hour 0."""
    out = F.lit(starts[0][1])
    for start, label in starts[1:]:
        out = F.when(_col(hour) >= start, F.lit(label)).otherwise(out)
    return out


# The two day-part variants, first hour and label.
DAY_PARTS = ((0, "night"), (6, "am"), (10, "mid"), (16, "pm"), (20, "eve"))
SLOPE_PARTS = ((0, "night"), (6, "gap"), (7, "am"), (10, "mid"), (16, "pm"), (20, "eve"))


def day_type(workingday: Column | str) -> Column:
    return F.when(_col(workingday) == 1, F.lit("work")).otherwise(F.lit("off"))


def month_number(yr: Column | str, month: Column | str) -> Column:
    """Months since the first one of the table's base year."""
    return (_col(yr) * 12 + _col(month) - 1).cast("int")


def month_levels(yr: Column | str, month: Column | str, levels: Iterable[int]) -> dict[str, Column]:
    return one_hot(month_number(yr, month), levels, "ym")


def half_open_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """Index of the (edges[i], edges[i+1]] bin; null at or below the first edge and above the last.

    The edges are literal numbers, so a value on an edge is compared, not divided."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((_col(c) > edges[i]) & (_col(c) <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def closed_last_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """Index of the [edges[i], edges[i+1]) bin; the last bin also holds its upper edge."""
    out = F.lit(0)
    for i in range(1, len(edges) - 1):
        out = F.when(_col(c) >= edges[i], F.lit(i)).otherwise(out)
    return out.cast("int")
