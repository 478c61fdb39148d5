import random

import pytest
from pyspark.sql import functions as F

from periodica.operators import greedy


def fold_spans(rows):
    out, last = [], {}
    for k, s, e in sorted((r for r in rows if None not in r[1:]), key=lambda r: (r[0] or "", r[1], r[2])):
        if s >= last.get(k, s):
            out.append((k, s, e))
            last[k] = e
    return sorted(out, key=repr)


def fold_batches(rows, most):
    out, held, batch = [], {}, {}
    for k, o, w in sorted(rows, key=lambda r: (r[0] or "", r[1], max(r[2] or 0, 0))):
        w = max(w or 0, 0)
        if k in held and held[k] + w > most:
            batch[k], held[k] = batch[k] + 1, 0
        held[k] = held.get(k, 0) + w
        out.append((k, o, batch.setdefault(k, 0)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [20, 1 << 16])
def test_equal_to_the_fold(spark, monkeypatch, block):
    """Blocks much smaller than a key, ties, repeats, spans of no length, keys that are null, weights that are zero, null or too large."""
    monkeypatch.setattr(greedy, "BLOCK", block)
    rng = random.Random(block)
    spans = [(rng.choice(["hot", "hot", "b", None]), s := rng.randrange(300), s + rng.choice([0, 1, 5, 40])) for _ in range(400)] + [("hot", 7, 9)] * 50 + [("c", None, 3), ("c", 4, None)]
    got = greedy.apart(spark.createDataFrame(spans, "k string, s long, e long").repartition(5), "k", "s", "e")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fold_spans(spans)
    weights = [(rng.choice(["hot", "hot", "b", None]), n // 2, rng.choice([0, None, 1, 3, 9, 14, -2])) for n in range(500)] + [("one", 1, 99)]
    got = greedy.batches(spark.createDataFrame(weights, "k string, o long, w long").repartition(5), "k", "o", "w", 12)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fold_batches(weights, 12)


def test_empty_tables(spark):
    assert greedy.apart(spark.createDataFrame([], "k string, s long, e long"), "k", "s", "e").count() == 0
    assert greedy.batches(spark.createDataFrame([], "k string, o long, w long"), "k", "o", "w", 5).count() == 0


def test_one_long_key(spark):
    """A single key of many blocks: every batch but the last is full, and none is over."""
    rows = spark.range(300_000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") % 5 + 1).alias("w"))
    got = greedy.batches(rows, "k", "o", "w", 30).join(rows, ["k", "o"]).groupBy("batch").agg(F.sum("w").alias("w"), F.min("o").alias("a"), F.max("o").alias("b"), F.count("*").alias("n"))
    r = got.agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.max(F.col("b") - F.col("a") + 1 - F.col("n")).alias("holes")).first()
    assert (r.n, r.least, r.most, r.holes) == (30_000, 30, 30, 0)
