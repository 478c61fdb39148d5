"""Keyed writes: syncs with a scope, cascades, back-fills, transitions, and edits with what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.operators.relational import newest


def sync_scope(old: DataFrame, new: DataFrame, key: str, scope: Column, filed: str) -> DataFrame:
    """``old`` after a sync of ``new``, which holds all rows of ``scope`` that still stand.

    Rows outside the scope stay. Rows of ``new`` take the place of theirs, but keep a known ``filed`` value. Rows of the scope
    that ``new`` lacks go, unless they are filed.
    """
    mine = old.where(scope)
    known = mine.select(F.col(key), F.col(filed).alias("_filed"))
    put = new.join(known, key, "left").withColumn(filed, F.coalesce("_filed", filed) if filed in new.columns else F.col("_filed")).drop("_filed")
    left = mine.join(new.select(key), key, "left_anti").where(F.col(filed).isNotNull())
    outside = old.where(~F.coalesce(scope, F.lit(False)))
    return outside.unionByName(left).unionByName(put.select(*old.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, state: str, events: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Parents without those of ``gone`` (one column, the key), and children with theirs un-linked, failed, and an event appended."""
    ids = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    kids = children.join(ids, key, "left")
    cut = F.coalesce("_gone", F.lit(False))
    event = F.struct(F.lit("record_deleted").alias("what"), at.alias("at"))
    none = F.array().cast(dict(children.dtypes)[events])
    new = {
        key: F.when(~cut, F.col(key)),
        state: F.when(cut, F.lit("failed")).otherwise(F.col(state)),
        events: F.when(cut, F.array_append(F.coalesce(events, none), event)).otherwise(F.col(events)),
    }
    return parents.join(ids, key, "left_anti"), kids.select(*(new.get(c, F.col(c)).alias(c) for c in children.columns))


def back_fill(df: DataFrame, source: DataFrame, on: str, column: str, value: str, fallback: str) -> DataFrame:
    """``column`` filled where it is null: from ``source`` by ``on`` (one row a key), else from ``fallback``."""
    s = source.select(on, F.col(value).alias("_v"))
    return df.join(s, on, "left").withColumn(column, F.coalesce(column, "_v", fallback)).select(*df.columns)


def insert_or_fill(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``new`` whose key is absent are inserted; of those present only a null ``column`` is filled."""
    filled = old.join(new.select(key, F.col(column).alias("_v")), key, "left").withColumn(column, F.coalesce(column, "_v")).select(*old.columns)
    return filled.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def remember(known: Column, found: Column, empty: str = "none") -> Column:
    """The map with new entries over old ones, but a marker of nothing never over a real entry."""
    real = F.map_filter(found, lambda k, v: (v != empty) | F.coalesce(F.try_element_at(known, k) == empty, F.lit(True)))
    kept = F.map_filter(known, lambda k, v: ~F.map_contains_key(real, k))
    return F.map_concat(kept, real)


def put_month(calendars: DataFrame, new: DataFrame) -> DataFrame:
    """Calendars (year, month, weekdays, holidays) with those of ``new`` in place of theirs; weekdays once each, in order."""
    n = newest(new, ["year", "month"], F.desc("at")) if "at" in new.columns else new.dropDuplicates(["year", "month"])
    n = n.select("year", "month", F.array_distinct("weekdays").alias("weekdays"), "holidays")
    return calendars.join(n.select("year", "month"), ["year", "month"], "left_anti").unionByName(n)


def reset_where(df: DataFrame, test: Column, **values) -> DataFrame:
    """Columns set to values on the rows of a test; the others stay as they are."""
    hit = F.coalesce(test, F.lit(False))
    return df.select(*(F.when(hit, F.lit(values[c]).cast(dict(df.dtypes)[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


# From which states an action may be taken, and where it leads.
MOVES = {
    "approve": (("pending", "verified"), "approved"), "verify": (("pending",), "verified"), "reject": (("pending", "verified"), "rejected"),
    "archive": (("approved", "rejected"), "archived"), "restore": (("archived",), "pending"), "ingest": (("staged",), "ingested"),
}


def moved(df: DataFrame, state: str, action: str) -> DataFrame:
    """``df`` (a row and the column ``action`` asked of it) with the new state, or ``error`` where the action may not be taken."""
    allowed = [(F.col(action) == a) & F.col(state).isin(*source) for a, (source, _) in MOVES.items()]
    target, known = F.col(state), F.lit(False)
    for test, (_, to) in zip(allowed, MOVES.values()):
        target, known = F.when(test, F.lit(to)).otherwise(target), known | F.coalesce(test, F.lit(False))
    none = F.col(action).isNull()
    error = F.when(~none & ~F.col(action).isin(*MOVES), F.concat(F.lit("unknown action "), action)).when(~none & ~known, F.concat(F.lit("can't "), action, F.lit(" what is "), F.coalesce(state, F.lit("null"))))
    return df.withColumn("error", error).withColumn(state, F.when(none, F.col(state)).otherwise(target))


def edited(df: DataFrame, column: str, action: Column, dates: Column, shape: str = r"^\d{4}-\d{2}-\d{2}$") -> DataFrame:
    """``df`` with a list of dates set, added to or cleared, and before, added, removed and rejected lists beside it."""
    before = F.coalesce(column, F.array().cast("array<string>"))
    good, bad = F.filter(dates, lambda x: x.rlike(shape)), F.filter(dates, lambda x: ~F.coalesce(x.rlike(shape), F.lit(False)))
    after = F.array_sort(F.array_distinct(F.when(action == "set", good).when(action == "add", F.concat(before, good)).when(action == "remove", F.array_except(before, good)).when(action == "clear", F.array().cast("array<string>")).otherwise(before)))
    out = df.withColumn("before", before).withColumn(column, after)
    return out.withColumn("added", F.array_except(column, "before")).withColumn("removed", F.array_except("before", column)).withColumn("rejected", bad)


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], pair: tuple[str, str] | None = None) -> DataFrame:
    """key and ``changes``, a list of (field, old, new), of rows that both have. A blank never erases; of a ``pair`` of
    references, a new one of either replaces both."""
    every = [*fields, *(c for c in pair or () if c not in fields)]
    o, n = old.select(key, F.struct(*every).alias("_o")), new.select(key, F.struct(*every).alias("_n"))
    said = lambda c: F.nullif(F.trim(F.col(f"_n.{c}").cast("string")), F.lit(""))
    was = lambda c: F.col(f"_o.{c}").cast("string")
    tests = {c: said(c).isNotNull() & ~said(c).eqNullSafe(was(c)) for c in fields}
    if pair:
        either = said(pair[0]).isNotNull() | said(pair[1]).isNotNull()
        tests |= {c: either & ~said(c).eqNullSafe(was(c)) for c in pair}
    each = F.array(*(F.when(t, F.struct(F.lit(c).alias("field"), was(c).alias("old"), said(c).alias("new"))) for c, t in tests.items()))
    return o.join(n, key).select(key, F.filter(each, lambda x: x.isNotNull()).alias("changes"))
