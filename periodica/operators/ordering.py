"""Envelopes, capped lists, batches and ordered reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of ``df`` with ``total`` and ``has_more``; the total is one row, and the page is limited before it is joined."""
    if not 1 <= limit <= 500:
        raise ValueError("limit from 1 to 500")
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, ranked; the planner limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def capped_list(df: DataFrame, keys: list[str], value: str, k: int, order: list[Column] | None = None) -> DataFrame:
    """keys and ``value`` as a list of the first ``k``: capped before it is collected, so no list grows with the data."""
    few = first_k(df, keys, order or [F.col(value)], k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"])
    return few.groupBy(*keys).agg(listed.alias(value))


def prefer_exact(df: DataFrame, order: list[Column], exact: Column, k: int = 25) -> DataFrame:
    """The first ``k`` rows, and of these only the exact ones where there are any: the limit comes first."""
    few = df.withColumn("_exact", F.coalesce(exact, F.lit(False))).orderBy(*order).limit(k)
    any_exact = few.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_any"))
    return few.join(F.broadcast(any_exact)).where("_exact or not _any").drop("_exact", "_any")


def fixed_batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """``batch``: rows of a key numbered in ``order``, so many to a batch."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def weighted_batches(df: DataFrame, key: str, order: str, weight: str, most: int) -> DataFrame:
    """``batch``: filled in ``order`` until the next row would bring its weight over ``most``; a heavier row stands alone.

    Each key's rows are folded in one array, so a key should be a thread or folder; ``greedy.batches`` takes keys of any length.
    """
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(weight).cast("long").alias("w")))).alias("rows"))
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["held"] > 0) & (acc["held"] + x["w"] > most)
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(new, x["w"]).otherwise(acc["held"] + x["w"]).alias("held"), F.array_append(acc["out"], batch).alias("out"))

    filled = rows.select(key, F.explode(F.arrays_zip(F.col("rows"), F.aggregate("rows", zero, step)["out"].alias("batch"))).alias("r"))
    return filled.select(key, F.col(f"r.rows.{order}").alias(order), F.col("r.batch").alias("batch"))


def spans_apart(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Of each key's spans those that begin at or behind the end of the last one taken, by start and end; ``greedy.apart`` takes keys of any length."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")))).alias("rows"))
    zero = F.array().cast("array<struct<s: bigint, e: bigint>>")
    taken = F.aggregate("rows", zero, lambda acc, x: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-1)) <= x["s"], F.array_append(acc, x)).otherwise(acc))
    return rows.select(key, F.inline(taken)).toDF(key, start, end)


def segments(df: DataFrame, key: str, start: str, end: str, length: str, most: int) -> DataFrame:
    """``until``: where the next span of the key begins, or ``most`` behind this one's end, within ``length``."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return df.withColumn("until", F.coalesce(following, F.least(F.col(end) + most, F.col(length))))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``duplicate``: false for a key's first row, true for the others."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def ordered_distinct(value: Column, order: Column) -> Column:
    """Aggregate: distinct values by first appearance."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def best_evidence(kind: Column, ranks: dict[str, int], order: Column, weak: int = 1) -> Column:
    """Aggregate: the kind of the highest rank over ``weak`` (of equals the latest), and whether weak evidence was seen."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[kind], F.lit(0))
    strong = F.max(F.when(rank > weak, F.struct(rank.alias("r"), order.alias("o"), kind.alias("k"))))
    return F.struct(strong["k"].alias("best"), F.coalesce(F.bool_or(rank == weak), F.lit(False)).alias("weak"))


def replace_or_append(items: Column, key: str, new: Column) -> Column:
    """The list without the items of ``new``'s key, and ``new`` at its end."""
    return F.array_append(F.filter(items, lambda x: ~x[key].eqNullSafe(new[key])), new)
