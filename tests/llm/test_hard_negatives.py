import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from periodica.llm import hard_negatives as hn
from periodica.llm.common import table
from tests.llm.helpers import SF, same


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) by all pairs; rows (id, label, vector), an id once."""
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a)
        for ps, p, _ in [x for x in scored if x[2] == la][:positives]:
            ok = [(ns, i) for ns, i, lab in scored if lab != la and low * -ps <= 100 * -ns <= high * -ps]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(ok[:negatives])]
    return sorted(out)


def made(spark, n, dims, spread, seed=0, labels=3):
    g = np.random.default_rng(seed)
    rows = [(i, int(g.integers(labels)), [int(x) for x in g.integers(-spread // 4, spread, dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_is_its_sql(spark):
    same(hn.op12_hard_negatives(spark, SF), hn.ORACLE)


@pytest.mark.parametrize("spread", [3, 200, 40_000_000])  # many ties; distinct; beyond float64
def test_is_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "CANDIDATES", 37)
    rows, df = made(spark, 400, 8, spread)
    assert got(hn.mine(df.repartition(3), F.col("vec_id") % 10 == 0, block=16)) == brute(rows, 10)


def test_few_rows_and_few_labels(spark):
    rows, df = made(spark, 7, 4, 9, labels=2)
    assert got(hn.mine(df, F.col("vec_id") % 2 == 0)) == brute(rows, 2)
    alone = df.where("label = 0")
    assert got(hn.mine(alone, F.col("vec_id") % 2 == 0)) == []
    assert got(hn.mine(df, F.lit(False))) == [] and got(hn.mine(df.limit(0), F.lit(True))) == []


def test_repeated_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(hn, "CANDIDATES", 64)
    rows, df = made(spark, 120, 4, 6)
    many = df.unionAll(df).unionAll(df.where("vec_id % 5 = 0")).unionAll(df.where("vec_id = 3").crossJoin(spark.range(200)).drop("id"))
    assert got(hn.mine(many.repartition(4), F.col("vec_id") % 10 == 0)) == brute(rows, 10)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.25, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [None, 1.0]), (6, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (9, 2, [0.3, 0.29])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as rank", "'x' as row")
    whole = {r.vec_id: (r.label, list(r.vector)) for r in hn.whole_vectors(df).collect()}
    assert whole == {i: ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, lab, v in rows if i in (0, 1, 2, 9)}
    found = hn.mine(hn.whole_vectors(df), F.col("vec_id") % 50 == 0).collect()
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in found} <= {(0, 2, 1), (0, 9, 1)}


def test_vectors_of_unequal_length_and_products_no_long_holds(spark):
    assert hn.matrix(pa.array([[1, 2], [], [3]])).tolist() == [[1, 2], [0, 0], [3, 0]]
    a = np.array([[1 << 40, 1]])
    with pytest.raises(OverflowError):
        hn.scores(a, a)
    big = np.array([[1 << 30, 3]])
    assert hn.scores(big, big)[0, 0] == (1 << 60) + 9
    df = spark.createDataFrame([(0, 1, [4, 4]), (1, 1, [4]), (2, 2, [2, 1, 9])], "vec_id long, label long, vector array<long>")
    assert got(hn.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 16, 12)]


def test_real_table_in_several_blocks(spark):
    whole = hn.whole_vectors(table(spark, SF, "embeddings"))
    assert got(hn.mine(whole, F.col("vec_id") % 50 == 0, block=3)) == got(hn.mine(whole.repartition(5), F.col("vec_id") % 50 == 0))
