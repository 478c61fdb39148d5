"""Greedy choices along keys of any length: spans that stand apart, and batches filled up to a weight.

Rows are put in one order, the keys one after the other, and numbered. Each row's successor, the row that would be taken next if it
were taken, is found by sorting what is asked for among the rows. A key's last successor is the first row of the next key, which is
always taken, so the choice is a single chain from the first row on. Blocks of ``BLOCK`` rows first tell for each of their rows
where the chain would leave them; the rows where it may enter a block are then linked by pointer doubling, and each block walks from
where it is entered. A task holds a block or a range of the order, whatever the size of a key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.stored import stored

BLOCK = 1 << 16


def running(df: DataFrame, order: list[Column | str], value: Column, name: str, most: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (the largest one with ``most``) up to and with each row in ``order``.

    A range sort, a pass that carries the sum along each range, and one row a range to add what lies before it. Rows of equal order are
    told apart by where they came from, so that they may be split.
    """
    columns = [c for c in df.columns if c != name]
    tied = df.select(*columns, F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias(name)).withColumn("_tie", F.monotonically_increasing_id())
    fold, join = (np.maximum, F.max) if most else (np.add, F.sum)

    def along(batches):
        held = 0
        for b in batches:
            at = b.schema.get_field_index(name)
            got = fold.accumulate(np.concatenate([[held], b.column(at).to_numpy(zero_copy_only=False).astype("int64")]))
            held = got[-1]
            yield b.set_column(at, b.schema.field(at), pa.array(got[1:], pa.int64()))

    ranged = tied.sort(*order, "_tie").drop("_tie")
    rows = stored(ranged.mapInArrow(along, ranged.schema).withColumn("_range", F.spark_partition_id()))
    ranges = rows.groupBy("_range").agg(F.max(name).alias("_last"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("_range", F.coalesce(join("_last").over(earlier), F.lit(0)).alias("_before"))
    # one row a range of the sort: of a bounded size
    whole = F.greatest(name, "_before") if most else F.col(name) + F.col("_before")
    return rows.join(F.broadcast(before), "_range").withColumn(name, whole).drop("_range", "_before")


def _asked(rows: DataFrame, key: str, value: str, limit: Column, equal: bool) -> DataFrame:
    """Rows with ``next``: how many rows come before ``limit`` in the order of (key, value), those equal to it included with ``equal``."""
    points = rows.select(key, F.col(value).alias("v"), F.lit(0 if equal else 1).alias("kind"), F.lit(None).cast("long").alias("i"))
    asked = rows.select(key, limit.alias("v"), F.lit(1 if equal else 0).alias("kind"), "i")
    counted = running(points.unionAll(asked), [key, "v", "kind"], F.col("i").isNull(), "next")
    return counted.where("i is not null").select("i", F.greatest("next", F.col("i") + 1).alias("next"))


def _taken(links: DataFrame) -> DataFrame:
    """i of the rows on the chain that begins at row 0 and goes from each row i to ``next``."""

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        first, to, n = int(rows.i.iloc[0]), rows.next.tolist(), len(rows)
        for k in range(n - 1, -1, -1):
            if to[k] < first + n:
                to[k] = to[to[k] - first]
        return pd.DataFrame({"i": rows.i, "next": to})

    block = F.floor(F.col("i") / BLOCK).alias("block")
    exits = stored(links.groupBy(block).applyInPandas(leave, "i long, next long"))
    start = links.sparkSession.range(1).select(F.col("id").alias("i"))
    doors = exits.select(F.col("next").alias("i")).union(start).distinct()
    level = stored(exits.join(doors, "i").join(doors.select(F.col("i").alias("next")).join(exits.select(F.col("i").alias("next")), "next"), "next").select("i", "next"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = stored(level.join(level.select(F.col("i").alias("next"), F.col("next").alias("far")), "next").select("i", F.col("far").alias("next")))
    entries = reduce(lambda got, jump: stored(got.union(got.join(jump, "i").select("next"))), reversed(levels), start)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        at, first, to, got = int(rows.entry.iloc[0]), int(rows.i.iloc[0]), rows.next.to_numpy(), []
        while at < first + len(rows):
            got.append(at)
            at = int(to[at - first])
        return pd.DataFrame({"i": got})

    entered = entries.select(block, F.col("i").alias("entry"))
    return links.withColumn("block", block).join(entered.hint("merge"), "block").groupBy("block").applyInPandas(walk, "i long")


def apart(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Of each key's spans those that begin at or behind the end of the last one taken, by start and end: keys of any length.

    Spans without a start or an end are left out; an empty table gives no rows.
    """
    spans = df.select(key, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).dropna(subset=[start, end])
    rows = stored(running(spans, [key, start, end], F.lit(1), "i").withColumn("i", F.col("i") - 1))
    return rows.join(_taken(_asked(rows, key, start, F.col(end), equal=False)), "i").select(key, start, end)


def batches(df: DataFrame, key: str, order: str, weight: str, most: int) -> DataFrame:
    """key, ``order`` and ``batch`` (from 0): filled in ``order`` until the next row would bring the weight over ``most``; a heavier row stands
    alone. Keys may have any length; of equal ``order`` the lighter row comes first, and a null or negative weight counts as 0.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)).alias("_w")
    placed = running(df.select(key, order, w), [key, order, "_w"], F.lit(1), "i").withColumn("i", F.col("i") - 1)
    rows = stored(running(placed, ["i"], F.col("_w"), "_sum"))
    begun = _taken(_asked(rows, key, "_sum", F.col("_sum") - F.col("_w") + most, equal=True)).withColumn("_begins", F.lit(1))
    firsts = rows.groupBy(key).agg(F.min("i").alias("i")).select("i", F.lit(True).alias("_first"))
    marked = rows.join(begun, "i", "left").join(firsts, "i", "left")
    counted = running(marked, ["i"], F.col("_begins"), "_n")
    based = running(counted, ["i"], F.when(F.col("_first"), F.col("_n")), "_base", most=True)
    return based.select(key, order, (F.col("_n") - F.col("_base")).alias("batch"))
