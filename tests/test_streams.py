"""Streams over several batches, run again, and with rows that come late."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from periodica.operators import ordering
from periodica.plans import tools
from periodica.streaming import ingest, state

DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def fed(spark, folder, batches, schema, make):
    """Each batch is written, then the stream runs to its end and goes on from its checkpoint; the results of each batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(ingest.source(spark, f"{folder}/in", spark.createDataFrame([], schema), 1))
        ingest.run(stream, f"{folder}/state", empty_batches=False, each=lambda df, n, k=k: df.write.mode("overwrite").parquet(f"{folder}/out/b={k * 100 + n}"))
    whole = spark.read.parquet(f"{folder}/out").collect()
    return {k: [r for r in whole if r.b // 100 == k] for k in range(len(batches))}


def test_late_or_covered(spark, tmp_path):
    schema = "thread long, id long, at timestamp, kind string"
    got = fed(spark, str(tmp_path), [[(1, 1, at(1), "message"), (1, 2, at(2), "run")], [(1, 3, at(3), "message"), (1, 4, at(1), "message"), (2, 5, at(1), "message")], [(1, 6, None, "message")]], schema, state.late_or_covered)
    assert {(r.id, r.state) for k in got for r in got[k]} == {(1, "covered"), (3, "new"), (4, "covered"), (5, "new"), (6, "covered")}


def test_new_with_context(spark, tmp_path):
    schema = "thread long, id long, at timestamp"
    got = fed(spark, str(tmp_path), [[(1, k, at(k)) for k in range(4)], [(1, 4, at(4)), (1, 2, at(2))], [(1, 1, at(1))]], schema, state.new_with_context)
    shown = {k: sorted((r.id, r.fresh) for r in got[k]) for k in got}
    assert shown == {0: [(k, True) for k in range(4)], 1: [(2, False), (3, False), (4, True)], 2: []}


def test_limits_and_counters_and_memo(spark, tmp_path):
    got = fed(spark, f"{tmp_path}/a", [[(1, 1, at(0)), (1, 2, at(0.5)), (1, 3, at(0.6))], [(1, 4, at(1.0)), (1, 5, at(1.1))]], "key long, id long, at timestamp", lambda s: state.limited(s, 2, 3600))
    assert {r.id: r.allowed for k in got for r in got[k]} == {1: True, 2: True, 3: False, 4: True, 5: False}
    got = fed(spark, f"{tmp_path}/b", [[(1, "total", 3), (1, "done", 1)], [(1, "failed", 1)], [(1, "done", 1)]], "run long, kind string, n long", state.counters)
    assert [(r.done, r.failed, r.state) for k in got for r in got[k]] == [(1, 0, "running"), (1, 1, "running"), (2, 1, "completed")]
    got = fed(spark, f"{tmp_path}/d", [[(1, "total", 3), (1, "done", 1)], [(1, "stop", 1)], [(1, "done", 1), (1, "failed", 1)], [(1, "total", 9)]], "run long, kind string, n long", state.counters)
    assert [(r.total, r.done, r.stopped, r.state) for k in got for r in got[k]] == [(3, 1, 0, "running"), (3, 1, 0, "stopping"), (3, 1, 2, "stopped"), (12, 1, 2, "stopped")]
    got = fed(spark, f"{tmp_path}/c", [[(1, at(1), "message")], [(1, at(2), "nothing")], [(1, at(3), "message")]], "thread long, at timestamp, kind string", state.memo)
    assert [r.state for k in got for r in got[k]] == ["need", "skip", "need"]


def test_keys_are_forgotten(spark, tmp_path):
    """A timer drops what a width has passed; a time to live drops what was not touched, and leaves no state."""
    left = lambda folder, name: spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").count()
    a = f"{tmp_path}/a"
    got = fed(spark, a, [[(1, 1, at(0)), (1, 2, at(0.1)), (2, 3, at(0))], [(3, 4, at(90))], [(3, 5, at(180))]], "key long, id long, at timestamp", lambda s: state.limited(s, 2, 3600, "1 hour"))
    assert {r.id: r.allowed for k in got for r in got[k]} == dict.fromkeys(range(1, 6), True)
    assert left(a, "held") <= 2  # of key 3 alone
    b, schema = f"{tmp_path}/b", "thread long, id long, at timestamp, kind string"
    slow = lambda s: state.late_or_covered(s, keep=1)
    got = fed(spark, b, [[(1, 1, at(5), "run"), (2, 2, at(5), "run")]], schema, slow)
    assert left(b, "run") == 2
    __import__("time").sleep(1.5)
    got = fed(spark, b, [[(1, 3, at(4), "message")]], schema, slow)
    assert [r.state for k in got for r in got[k]] == ["new"] and left(b, "run") == 0


def test_deltas_of_three_batches_and_a_run_again(spark, tmp_path):
    schema, table = "id long, at timestamp, v string, known string", f"{tmp_path}/table"
    batches = [[(1, at(1), "a", "k1"), (2, at(1), "b", None), (1, at(3), "c", None)], [(1, at(2), "late", None), (3, at(2), "d", None)], [(2, at(4), "e", "k2"), (3, at(2), "same time", None)]]
    write = ingest.deltas_into(table, ["id"], "at", ["known"], 4)
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), k)
    now = lambda path=table: {r.id: (r.v, r.known) for r in ingest.current(spark, path, ["id"], "at", ["known"]).collect()}
    want = {1: ("c", "k1"), 2: ("e", "k2"), 3: ("same time", None)}
    assert now() == want
    write(spark.createDataFrame(batches[1], schema), 1)
    assert now() == want
    ingest.compact(spark, table, f"{tmp_path}/compact", ["id"], "at", ["known"])
    assert now(f"{tmp_path}/compact") == want
    assert sorted(r.id for r in ingest.touched(ingest.current(spark, table, ["id"], "at"), spark.createDataFrame([(3,), (3,), (9,)], "id long"), ["id"]).collect()) == [3]


def test_cursor_and_progress(spark, tmp_path):
    df = spark.createDataFrame([(1, at(0)), (2, at(0.9)), (3, at(1))], "id long, at timestamp")
    assert ingest.since(df, "at", None).count() == 3 and ingest.since(df, "at", F.lit(at(1))).count() == 2
    seen = []
    listener = ingest.Progress(seen.append)
    spark.streams.addListener(listener)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.run(ingest.source(spark, f"{tmp_path}/in", df), f"{tmp_path}/state", path=f"{tmp_path}/out")
    for _ in range(50):
        if any(x[0] == "ended" for x in seen):
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(listener)
    assert any(x[1] == 3 for x in seen if x[0] not in ("started", "ended"))


def test_tools(spark):
    sf = "/root/testdata/sf0.001"
    for name, given in [("drop", {}), ("missing", {}), ("missing", {"year": "1997"}), ("missing", {"year": 1997, "month": 13}), ("missing", {"year": 1997, "x": 1}), ("edit", {"person": 1, "action": "set", "days": []}), ("missing", {"year": True})]:
        with pytest.raises(tools.Refused):
            tools.call(name, spark, sf, **given)
    assert tools.call("search", spark, sf, q="zzz").count() == 0
    run = tools.Stages([("double", lambda d: d.unionAll(d), True), ("broken", lambda d: d.select("nowhere"), False), ("skipped", lambda d: d, False), ("needed", lambda d: d.where("oops"), True), ("never", lambda d: 1 / 0, True)])
    assert run(spark.range(2), skip=("skipped",)).count() == 4
    assert [n for n, _ in run.notes] == ["broken", "skipped", "needed"]
    assert ordering.first_k(spark.range(5), [], [F.asc("id")], 2).count() == 2


class CountedState:
    """A handle and a state of one key: counts the round trips to the store."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_batch_of_a_key_takes_few_calls_to_the_store():
    at = lambda s: datetime.datetime.fromtimestamp(s)
    some = [
        (state._Memo(9), [[Row(kind="message", at=at(1)), Row(kind="found", at=at(2))], [Row(kind="message", at=at(3))]], 2),
        (state._Counters(9), [[Row(kind="total", n=2), Row(kind="done", n=1), Row(kind="failed", n=1)], [Row(kind="stop", n=1)]], 2),
        (state._Limit(9, 2), [[Row(id=1, at=at(1)), Row(id=2, at=at(2)), Row(id=3, at=at(3))], [Row(id=4, at=at(11)), Row(id=5, at=at(12))]], 4),
    ]
    said = []
    for processor, batches, most in some:
        store = CountedState()
        processor.init(store)
        for rows in batches:
            store.calls = 0
            said.append([tuple(r) for r in processor.handleInputRows((7,), iter(rows), None)])
            assert store.calls <= most
    assert said[:4] == [[(7, "skip")], [(7, "need")], [(7, 2, 0, 1, 1, 0, "completed")], [(7, 2, 0, 1, 1, 0, "completed")]]
    assert said[4:] == [[(7, 1, True), (7, 2, True), (7, 3, False)], [(7, 4, True), (7, 5, True)]] and store.timers == {21000}


def test_neighbouring_threads_share_a_key(spark, tmp_path):
    """Thirty-three threads and rows of none take four keys, and each has a run of its own."""
    schema = "thread long, id long, at timestamp, kind string"
    threads = [*range(-1, 32), None]
    runs = [(k, 100, at(5 + (k or 0) % 3), "run") for k in threads]
    got = fed(spark, str(tmp_path), [runs, [(k, n, at(n), "message") for k in threads for n in (5, 6, 7, 8)]], schema, state.late_or_covered)
    want = {(k, n, "new" if n > 5 + (k or 0) % 3 else "covered") for k in threads for n in (5, 6, 7, 8)}
    assert {(r.thread, r.id, r.state) for k in got for r in got[k]} == want
    held = spark.read.format("statestore").option("stateVarName", "run").load(f"{tmp_path}/state")
    assert held.select("key").distinct().count() == 4 and held.count() == len(threads)


def test_threads_of_a_key_are_forgotten_one_by_one():
    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def getListState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.calls += 1
            self.rows = rows

        def clear(self):
            self.put([])

    class Now:
        def __init__(self, s):
            self.s = s

        def getCurrentProcessingTimeInMs(self):
            return self.s * 1000

    held, late = Held(), state._Late(10)
    late.init(held)

    def batch(s, *rows):
        held.calls = 0
        said = [(r.thread, r.state) for r in late.handleInputRows((0,), (Row(block=0, thread=k, id=1, at=t, kind=kind) for k, t, kind in rows), Now(s))]
        assert held.calls <= 2
        return said

    assert batch(0, *((k, 50, "run") for k in range(16))) == [] and len(held.rows) == 16
    assert batch(6, (1, 40, "message"), (1, None, "message")) == [(1, "covered")] * 2 and len(held.rows) == 16
    assert batch(12, (1, 40, "message"), (2, 40, "message")) == [(1, "covered"), (2, "new")]
    assert [r[0] for r in held.rows] == [1]
    assert batch(30, (3, 40, "message")) == [(3, "new")] and held.rows == []
