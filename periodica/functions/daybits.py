"""A month as 31 bits: sets of its days as whole numbers, united and compared by bit operations."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A day of the month as dates are written; what is of ISO shape and no such day counts as elsewhere.
DAY = r"^(0[1-9]|[12]\d|3[01])$"


def prefix(year: Column, month: Column) -> Column:
    """What the dates of a month begin with; null without a year or month."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"))


def within(date: Column, begins: Column) -> Column:
    """Whether an ISO date is a day of the month that ``begins`` stands for."""
    return F.coalesce(date.startswith(begins) & (F.char_length(date) == 10) & F.substring(date, 9, 2).rlike(DAY), F.lit(False))


def of_day(day: Column) -> Column:
    """The set of one day, 1 to 31."""
    return F.call_function("shiftleft", F.lit(1), day.cast("int") - 1)


def bit(date: Column) -> Column:
    return of_day(F.substring(date, 9, 2))


def bits(dates: Column, begins: Column) -> Column:
    """The set of the dates of the month; others are left out, null is the empty set."""
    one = lambda acc, x: acc.bitwiseOR(F.when(within(x, begins), bit(x)).otherwise(F.lit(0)))
    return F.coalesce(F.aggregate(dates, F.lit(0), one), F.lit(0))


def elsewhere(dates: Column, begins: Column) -> Column:
    return F.filter(F.coalesce(dates, F.array().cast("array<string>")), lambda x: ~within(x, begins))


def holds(mask: Column, date: Column, begins: Column) -> Column:
    return within(date, begins) & (mask.bitwiseAND(bit(date)) != 0)


def _members(mask: Column) -> Column:
    """(bit, day, text) of the days of a set, in order, out of a constant list."""
    month = F.expr("array(" + ", ".join(f"named_struct('bit', {1 << (k - 1)}, 'day', {k}, 'text', '{k:02}')" for k in range(1, 32)) + ")")
    return F.filter(month, lambda x: mask.bitwiseAND(x["bit"]) != 0)


def numbers(mask: Column) -> Column:
    """The days of a set, in order."""
    return F.transform(_members(mask), lambda x: x["day"])


def days(mask: Column, begins: Column) -> Column:
    """The dates of a set, in order."""
    dated = F.transform(_members(mask), lambda x: F.concat(begins, x["text"]))
    return F.when(mask == 0, F.array().cast("array<string>")).otherwise(dated)


def union(*masks: Column) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseOR(b), masks, F.lit(0))


def less(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def whole(last: Column) -> Column:
    """All days of a month of ``last`` days."""
    return (F.call_function("shiftleft", F.lit(1).cast("long"), last) - 1).cast("int")
