"""Filters of the list and search endpoints, as column expressions that reach the scan where they can."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality filters, each applied only if its value is given."""
    return functools.reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)


def period(df: DataFrame, day: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of a year or month by a range over ``day``, so that it is pushed down; a month needs its year."""
    if month is not None and year is None:
        raise ValueError("month needs a year")
    if year is None:
        return df
    low, high = (f"{year:04d}-{month:02d}-01", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01") if month else (f"{year:04d}-01-01", f"{year + 1:04d}-01-01")
    return df.where((F.col(day) >= low) & (F.col(day) < high))


def not_listed(c: str, listed: str) -> Column:
    """Not in a comma-separated list; nulls are dropped, as in SQL."""
    return ~F.col(c).isin(*(x.strip() for x in listed.split(",") if x.strip()))


def like_any(q: str, *names: str) -> Column:
    """Case-insensitive contains over any of the columns; the wildcards of ``q`` stay live."""
    return functools.reduce(operator.or_, (F.lower(n).like(f"%{q.lower()}%") for n in names))


def every_term(q: str, *names: str, most: int = 8) -> Column:
    """Each of the first ``most`` words in at least one column, wildcards taken literally."""
    terms = q.lower().split()[:most]
    return functools.reduce(operator.and_, (functools.reduce(operator.or_, (F.lower(n).contains(t) for n in names)) for t in terms), F.lit(True))


def json_flag(c: str, path: str) -> Column:
    """A boolean at a path of a JSON text; null counts as false."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.col(c)), path, "boolean"), F.lit(False))


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def records_of(records: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """Records of a key: ``unmatched::<name>`` names a person whatever the case, anything else is the person's id."""
    name = key.removeprefix("unmatched::")
    who = people.where(F.lower("c_name") == name.lower()) if name != key else people.where(F.col("c_custkey") == int(key))
    return records.join(who.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


def in_scope(path: Column, prefix: str, year: int | None = None, people: list[str] | None = None, month: str | None = None) -> Column:
    """Paths team/person/month-year/item under ``prefix``: of a year, of people, of months by prefix. A path of fewer than four
    parts never matches a filter by name."""
    part = F.split(path, "/")
    test = path.startswith(prefix)
    if year is not None:
        test &= F.regexp_extract(F.try_element_at(part, F.lit(3)), r"-(\d{4})$", 1) == str(year)
    if people is not None:
        test &= (F.size(part) >= 4) & F.try_element_at(part, F.lit(2)).isin(*people)
    if month is not None:
        test &= (F.size(part) >= 4) & F.try_element_at(part, F.lit(3)).startswith(month)
    return F.coalesce(test, F.lit(False))
