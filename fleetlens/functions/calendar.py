"""Reporting windows and calendar spines. ``as_of`` replaces the wall clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import as_col


def positive(value, name: str) -> int:
    """The whole number asked for; what makes no sense is an error and nothing is clamped."""
    number = int(value)
    if number <= 0:
        raise ValueError(f"{name} must be positive, got {value}")
    return number


def as_timestamp(as_of: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return as_of


def ts_lit(value: dt.datetime) -> Column:
    """Timestamp literal that does not depend on the Python process time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def since_days(column: Column | str, as_of, days: int) -> Column:
    """``column >= as_of - days`` (the instant, not the day)."""
    return as_col(column) >= ts_lit(as_timestamp(as_of) - dt.timedelta(days=days))


def add_months(day: dt.date, months: int) -> dt.date:
    """Calendar month arithmetic that clips to the last day of the target month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    nxt = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (nxt - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def month_start(as_of, back: int = 0) -> dt.date:
    return add_months(as_timestamp(as_of).date().replace(day=1), -back)


def day_floor(as_of) -> dt.date:
    return as_timestamp(as_of).date()


def window_predicate(column: Column | str, as_of, *, months: int | None = None, days: int | None = None) -> Column:
    """Calendar months (the current one included) or trailing days (30 when neither is given)."""
    if months is not None:
        months = positive(months, "months")
        return as_col(column) >= F.lit(month_start(as_of, months - 1)).cast("timestamp")
    days = positive(30 if days is None else days, "days")
    return as_col(column) >= F.lit(day_floor(as_of) - dt.timedelta(days=days)).cast("timestamp")


def explode_months(df: DataFrame, as_of, months: int, name: str = "month_start") -> DataFrame:
    """One copy of each row per calendar month, oldest first."""
    months = positive(months, "months")
    starts = [month_start(as_of, back) for back in range(months - 1, -1, -1)]
    return df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in starts])))


def month_spine(spark: SparkSession, as_of, months: int) -> DataFrame:
    """Dense list of the last ``months`` calendar months."""
    return explode_months(spark.range(1).select(), as_of, months)


@dataclass(frozen=True)
class Period:
    unit: str
    count: int
    step_months: int | None
    step_days: int | None


# Reporting periods and how many of each are shown.
PERIODS = {
    "weekly": Period("week", 12, None, 7),
    "monthly": Period("month", 3, 1, None),
    "quarterly": Period("quarter", 4, 3, None),
}


def period_of(column: Column | str, period: str) -> Column:
    """Start day of the reporting period a timestamp falls in."""
    return F.date_trunc(PERIODS[period].unit, as_col(column)).cast("date")


def period_bounds(as_of, period: str) -> list[tuple[dt.date, dt.date]]:
    """(start, exclusive end) of every reported period, oldest first."""
    spec, today = PERIODS[period], day_floor(as_of)
    if spec.step_days:
        current = today - dt.timedelta(days=today.weekday())
        starts = [current - dt.timedelta(days=spec.step_days * k) for k in range(spec.count - 1, -1, -1)]
        return [(s, s + dt.timedelta(days=spec.step_days)) for s in starts]
    month = today.month - (today.month - 1) % spec.step_months
    current = today.replace(month=month, day=1)
    starts = [add_months(current, -spec.step_months * k) for k in range(spec.count - 1, -1, -1)]
    return [(s, add_months(s, spec.step_months)) for s in starts]


def period_label(start: Column, period: str) -> Column:
    if period == "weekly":
        return F.concat_ws(" – ", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if period == "monthly":
        return F.date_format(start, "MMM yyyy")
    return F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.year(start).cast("string"))


def explode_periods(df: DataFrame, as_of, period: str) -> DataFrame:
    """One copy of each row per reporting period, with bounds, label and current flag."""
    today = F.lit(day_floor(as_of))
    bounds = F.array(
        *[F.struct(F.lit(s).alias("period_start"), F.lit(e).alias("period_end")) for s, e in period_bounds(as_of, period)]
    )
    out = df.withColumn("_p", F.explode(bounds))
    start, end = F.col("_p.period_start"), F.col("_p.period_end")
    return out.select(
        *df.columns,
        start.alias("period_start"),
        end.alias("period_end"),
        period_label(start, period).alias("period_label"),
        ((start <= today) & (today < end)).alias("is_current_period"),
    )


def period_spine(spark: SparkSession, as_of, period: str = "monthly") -> DataFrame:
    return explode_periods(spark.range(1).select(), as_of, period)
