"""Joins, windows and keyed updates that the record, thread and roster queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; the planner limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page; ``order`` must end in a unique key."""
    if not 1 <= limit <= 500:
        raise ValueError("limit from 1 to 500")
    return df.orderBy(*order).offset(offset).limit(limit)


def keyed_partition(roster: DataFrame, key: str, **sets: DataFrame) -> DataFrame:
    """``roster`` with ``state``: the first of ``sets`` (one column, the key) that has the row's key, else missing."""
    state = F.lit("missing")
    for name, s in reversed(sets.items()):
        flag = f"_in_{name}"
        known = s.toDF(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        roster = roster.join(known, key, "left")
        state = F.when(F.col(flag), F.lit(name)).otherwise(state)
    return roster.withColumn("state", state).drop(*(f"_in_{n}" for n in sets))


def either_key(left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """``left`` with ``match``: the right row's id by the first key, else by the second; two joins instead of an OR.

    Right: columns id and the two keys; of several rows with a key, that of the smallest id.
    """
    by = lambda k, n: right.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(n))
    both = left.join(by(first, "_a"), first, "left").join(by(second, "_b"), second, "left")
    return both.withColumn("match", F.coalesce("_a", "_b")).drop("_a", "_b")


def previous(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Each row with ``columns`` of the row before it under its key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select("*", *(F.lag(c).over(w).alias(f"prior_{c}") for c in columns))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the newest ``value`` of ``right`` strictly before ``at``: one sort over the union, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(0)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(f"prior_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 0").drop("_v", "_side")


def since(df: DataFrame, key: str, order: str, marks: DataFrame, mark: str, before: int = 2, most: int = 40) -> DataFrame:
    """Rows from ``before`` rows ahead of the first one after the key's mark, the newest ``most`` of them."""
    rows = df.join(marks, key, "left").withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    new = F.col(mark).isNull() | (F.col(order) > F.col(mark))
    whole = Window.partitionBy(key)
    rows = rows.withColumn("_first", F.min(F.when(new, F.col("_rn"))).over(whole)).withColumn("_n", F.count("*").over(whole))
    return rows.where((F.col("_rn") >= F.col("_first") - before) & (F.col("_rn") > F.col("_n") - most)).drop("_rn", "_first", "_n")


def diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys, change (add, update, unchanged, missing) and the fields that differ; a blank new value never erases.

    Texts are trimmed, and empty ones say nothing, on both sides.
    """
    said = lambda df: F.struct(*(F.nullif(F.trim(c), F.lit("")).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in compared))
    o = old.select(*keys, said(old).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, said(new).alias("_n"), F.lit(True).alias("_in_new"))
    fields = F.filter(
        F.array(*(F.when(F.col(f"_n.{c}").isNotNull() & ~F.col(f"_n.{c}").eqNullSafe(F.col(f"_o.{c}")), F.lit(c)) for c in compared)), lambda x: x.isNotNull()
    )
    change = F.when(F.col("_in_old").isNull(), "add").when(F.col("_in_new").isNull(), "missing").when(F.size(fields) > 0, "update").otherwise("unchanged")
    both = o.join(n, keys, "full_outer")
    return both.select(*keys, change.alias("change"), F.when(change == "update", F.array_join(fields, ",")).otherwise("").alias("fields"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put over it: known values survive nulls, and ``keep`` columns stay as they were."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in cols), F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")) if c in keep else F.coalesce(f"_n_{c}", c)
    return both.select(*keys, *(pick(c).alias(c) for c in cols))


def keyed_sync(old: DataFrame, new: DataFrame, key: str, done: Column) -> DataFrame:
    """Upsert by key, then drop the rows that are absent from ``new`` unless they are ``done``."""
    absent = old.join(new.select(key), key, "left_anti").where(done)
    return absent.unionByName(new, allowMissingColumns=True)


def name_collisions(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """``stored_name``: the name, with (2), (3) ... before its suffix from the second of a folder on."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("_n", n).withColumn("stored_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), suffix))).drop("_n")


def dated_names(df: DataFrame, folder: str, name: str, taken: DataFrame, day: Column, order: str) -> DataFrame:
    """``stored_name`` that overwrites nothing: the name while it is free, then with a date, then with (2), (3) ... behind the date.

    ``taken``: folder and name of what is there, one row each.
    """
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    dated = F.concat(stem, F.lit("_"), F.date_format(day, "yyyy-MM-dd"))
    there = taken.select(F.col(folder), F.col(name).alias("_taken")).groupBy(folder).agg(F.collect_set("_taken").alias("_taken"))
    free = ~F.coalesce(F.array_contains("_taken", F.col(name)), F.lit(False))
    rows = df.join(there, folder, "left").withColumn("_n", F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - F.when(free, 1).otherwise(0))
    again = F.size(F.filter(F.coalesce("_taken", F.array().cast("array<string>")), lambda x: x.startswith(dated)))
    k = F.col("_n") + again
    rows = rows.withColumn("stored_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(dated, F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""), suffix)))
    return rows.drop("_n", "_taken")


def row_json(df: DataFrame) -> DataFrame:
    """A JSON object a row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
