"""Joins with priorities, fallbacks and vetoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.operators.relational import newest


def last_wins(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """Left join with one right row per key, the first in ``order`` (give it newest first)."""
    return left.join(newest(right, [key], *order), key, "left")


def by_priority(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *rules: tuple[str, str], veto: str | None = None) -> DataFrame:
    """``left`` with ``match`` and ``rule``: the smallest id of ``right`` by the first rule (a name and a key column that both
    have) that finds one. With ``veto`` a later rule takes no row whose value in that column is known on both sides and differs.

    Rows of a key are never paired: a row of ``left`` meets the smallest id of its key, under a veto those of the rows that say nothing
    and of those that say the same.
    """
    least = lambda r, *by: r.groupBy(*by).agg(F.min(right_id).alias("_match"))
    found = left
    for n, (_, key) in enumerate(rules):
        r = right.where(F.col(key).isNotNull())
        ids = {"any": least(r, key)}
        if veto and veto != key:
            ids = {"any": least(r, key), "silent": least(r.where(F.col(veto).isNull()), key), "same": least(r.where(F.col(veto).isNotNull()), key, veto)}
        for kind, of in ids.items():
            found = found.join(of.withColumnRenamed("_match", f"_{kind}"), [key, veto] if kind == "same" else [key], "left")
        match = F.col("_any") if len(ids) == 1 else F.when(F.col(veto).isNull(), F.col("_any")).otherwise(F.least("_silent", "_same"))
        found = found.withColumn(f"_found{n}", match).drop(*(f"_{kind}" for kind in ids))
    each = [(name, F.col(f"_found{n}")) for n, (name, _) in enumerate(rules)]
    rule = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in each))
    found = found.withColumns({"match": F.coalesce(*(c for _, c in each)), "rule": rule})
    return found.select(*left.columns, "match", "rule")


def all_or_none(asked: DataFrame, known: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """group and ``value`` as a list in the order of names; null where a single name of the group is unknown."""
    hit = asked.join(known.groupBy(name).agg(F.min(value).alias(value)), name, "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    return hit.groupBy(group).agg(F.when(F.bool_and(F.col(value).isNotNull()), listed).alias(value))


def cached(items: DataFrame, cache: DataFrame, digest: str) -> DataFrame:
    """``items`` with the cached result of their digest, then the cached rows that no item has: state reused, fresh or stale."""
    joined = items.join(cache, digest, "left").withColumn("state", F.when(F.col("result").isNull(), "fresh").otherwise("reused"))
    stale = cache.join(items.select(digest), digest, "left_anti").withColumn("state", F.lit("stale"))
    return joined.unionByName(stale, allowMissingColumns=True)


def renamed(old: DataFrame, new: DataFrame, same: list[str], name: str, order: str) -> DataFrame:
    """Rows of ``new`` with ``renamed_from``: the first old row that agrees in ``same`` and is called otherwise."""
    first = old.groupBy(*same).agg(F.min(F.struct(order, name)).alias("_o"))
    return new.join(first, same, "left").withColumn("renamed_from", F.when(F.col(f"_o.{name}") != F.col(name), F.col(f"_o.{name}"))).drop("_o")


def labelled_items(labels: DataFrame, items: DataFrame, group: str, label: str, name: str, place: str) -> DataFrame:
    """``labels`` with ``item``: the place of the first item of the group that the label means. A number in the label (``item 3``) comes
    before an equal name, and that before a name inside the label or the label inside a name; case does not count."""
    low, called = F.lower(F.trim(label)), F.lower(F.trim(name))
    number = F.nullif(F.regexp_extract(low, r"\bitem[ _#-]*(\d+)\b", 1), F.lit("")).try_cast("long")
    rank = F.when(F.col(place) == number, 0).when(low == called, 1).when(low.contains(called) | called.contains(low), 2)
    pairs = labels.select(group, label).distinct().join(items.select(group, name, place), group).withColumn("_rank", rank).where("_rank is not null")
    best = pairs.groupBy(group, label).agg(F.min(F.struct("_rank", place)).alias("_b")).select(group, label, F.col(f"_b.{place}").alias("item"))
    return labels.join(best, [group, label], "left")
