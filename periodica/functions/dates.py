"""Calendar and date-set algebra: built-in functions over ISO date strings and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}$"


def try_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none such."""
    parts = (F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (day, 2)))
    return F.when(day.isNotNull(), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(try_date(year, month, F.lit(1))))


def spine(year: Column, month: Column) -> Column:
    """All dates of a month as ISO strings."""
    first = try_date(year, month, F.lit(1))
    return F.transform(F.sequence(first, F.last_day(first)), lambda d: F.date_format(d, "yyyy-MM-dd"))


def weekends(year: Column, month: Column, names: list[str]) -> Column:
    """Dates of a month that fall on the named weekdays."""
    return F.filter(spine(year, month), lambda d: F.date_format(F.to_date(d), "EEEE").isin(*names))


def clean(dates: Column) -> Column:
    """Trimmed, in ISO shape, distinct, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(dates, lambda d: F.trim(d)), lambda d: d.rlike(ISO))))


def union(*sets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*sets)))


def unaccounted(year: Column, month: Column, *sets: Column) -> Column:
    """Dates of the month in none of the sets."""
    return F.array_except(spine(year, month), F.concat(*sets))


def outside(dates: Column, year: Column, month: Column) -> Column:
    """Dates whose month is another one; kept elsewhere, flagged here."""
    return F.filter(dates, lambda d: ~d.startswith(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"))))


def iso_or_day(value: Column, year: int, month: int) -> Column:
    """An ISO date, or a bare day number of the given month, as an ISO string; null if neither."""
    iso = F.when(value.rlike(ISO), F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd"))
    day = F.date_format(try_date(F.lit(year), F.lit(month), F.when(value.rlike(r"^\d{1,2}$"), value).try_cast("int")), "yyyy-MM-dd")
    return F.coalesce(iso, day)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMMM-yyyy")
