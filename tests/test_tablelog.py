import pytest
from pyspark.sql import functions as F

from periodica.sources import sinks
from periodica.streaming import ingest, tablelog

SCHEMA = "k long, v string, at long, gone boolean"


def rows(log, of=None):
    return {r.k: r.v for r in log.current(of).collect()}


def test_delete_rerun_crash_and_compaction(spark, tmp_path, monkeypatch):
    log = tablelog.TableLog(spark, f"file://{tmp_path}", ["k"], "at", buckets=4)
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    with pytest.raises(ValueError, match="nothing was published"):
        log.current()
    assert log.append(df(*((k, f"a{k}", 1, None) for k in range(20)), (3, "old", 0, None)), 0, F.col("gone"))
    assert log.append(df((1, "b", 5, False), (2, None, 5, True), (5, "x", 0, False)), 1, F.col("gone"))
    expected = {k: f"a{k}" for k in range(20)} | {1: "b"}
    del expected[2]
    assert rows(log) == expected
    assert not log.append(df((1, "again", 9, False)), 1) and rows(log) == expected  # the batch runs again
    with monkeypatch.context() as m:  # written, and the writer dies before it is published
        m.setattr(sinks, "_publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            log.append(df((7, "lost", 9, False)), 2)
        with pytest.raises(OSError):
            log.compact(2)
    assert rows(log) == expected
    assert log.append(df((7, "c", 9, False), (2, "late", 4, False)), 2, F.col("gone"))
    expected |= {7: "c"}
    assert rows(log) == expected  # the delete is newer than what came late
    few = log.compact(3, buckets=[0, 2])
    assert few and not log.compact(3) and rows(log) == expected
    assert [len(f) for b, f in sorted(log.live().items()) if b in (0, 2)] == [1, 1]
    assert log.vacuum() == 2 and rows(log) == expected  # the two that were never published
    assert log.compact(4) and log.vacuum() == 4 and rows(log) == expected
    assert log.append(df((2, "late again", 4, False)), 5) and rows(log) == expected
    assert log.compact(6, forget=F.col("at") < 9) and rows(log) == expected
    assert log.append(df((2, "back", 4, False)), 7) and rows(log) == expected | {2: "back"}
    with pytest.raises(ValueError, match="doesn't have"):
        log.append(spark.range(1).selectExpr("id as k", "1 as more"), 8)
    assert log.append(spark.range(50, 51).selectExpr("id as k", "null as v", "3 as at"), 8) and rows(log)[50] is None  # cast to the table's columns
    with pytest.raises(ValueError, match="other keys"):
        tablelog.TableLog(spark, f"file://{tmp_path}", ["k"], "at", buckets=8).append(df((1, "b", 5, False)), 9)


def test_reads_open_the_buckets_of_their_keys(spark, tmp_path):
    log = tablelog.TableLog(spark, f"file://{tmp_path}", ["k"], "at", buckets=8)
    log.append(spark.range(100).select(F.col("id").alias("k"), F.lit("v").alias("v"), F.lit(1).alias("at")), 0)
    of = spark.createDataFrame([(5,), (5,), (500,)], "k int")
    assert rows(log, of) == {5: "v"} and rows(log, of.limit(0)) == {}
    opened = {f.split("/")[-2] for f in log.current(of).inputFiles()}
    assert 1 <= len(opened) <= 3 and len({f.split("/")[-2] for f in log.current().inputFiles()}) == 8


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    table = lambda *r: spark.createDataFrame(list(r), "k long, v string, at long, gone boolean")
    log = tablelog.TableLog(spark, f"file://{tmp_path}/t", ["k"], "at")
    for rows_, expected in (([(1, "a", 1, False), (2, "b", 1, False)], {1: "a", 2: "b"}), ([(2, None, 2, True), (3, "c", 2, False)], {1: "a", 3: "c"})):
        table(*rows_).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = ingest.source(spark, f"file://{tmp_path}/in", table((1, "a", 1, False)))
        ingest.run(stream, f"{tmp_path}/state", each=log.sink(F.col("gone")))
        assert rows(log) == expected
