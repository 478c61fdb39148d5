"""Keyed state in streams, by processors with value and list state: the last run of a thread, what is new in it, memos, rates, counters.

A key that no row has touched for ``keep`` seconds is forgotten, so state doesn't grow with the age of a stream: by a time to live
where any row must be judged however late it is, by an event-time timer where only a width of time matters. The rows of one key in
one batch are read together; the stream's ``maxFilesPerTrigger`` bounds a batch. Every call to the state store costs a round trip, so what is
small stands in one value, which is read and written once.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Rows = Iterator[Row]
#: State of a key is kept for a month after its last row, unless asked otherwise.
KEEP = 30 * 86400
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "ProcessingTime") -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # state of several variables needs it
    return stream.groupBy(key).transformWithState(processor, schema, "Append", time)


def _us(at: datetime.datetime | None) -> int | None:
    return None if at is None else round(at.timestamp() * 1_000_000)


def _at(us: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(us // 1_000_000).replace(microsecond=us % 1_000_000)


class _Processor(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle, self.keep * 1000)

    def open(self, handle: StatefulProcessorHandle, keep_ms: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


#: Threads of neighbouring numbers that are read together, 2 to this power: what a call to the state store costs is theirs in common.
BLOCK = 4


class _Late(_Processor):
    def open(self, handle, keep_ms):
        self.keep_ms = keep_ms
        self.runs = handle.getListState("run", "thread long, at long, touched long", keep_ms)

    def handleInputRows(self, key, rows: Rows, timerValues):
        now, messages, touched = timerValues.getCurrentProcessingTimeInMs(), [], set()
        found = {thread: (at, last) for thread, at, last in self.runs.get()}
        live = {thread: (at, last) for thread, (at, last) in found.items() if last + self.keep_ms > now}
        runs = {thread: at for thread, (at, _) in live.items()}
        for _, thread, i, at, kind in rows:
            touched.add(thread)
            if kind == "message":
                messages.append((thread, i, at))
            elif kind == "run" and at is not None:
                runs[thread] = max(at, runs.get(thread, at))
        live |= {thread: (runs[thread], now) for thread in touched if thread in runs}
        if live:
            if live != found:
                self.runs.put([(thread, at, last) for thread, (at, last) in live.items()])
        elif found:
            self.runs.clear()
        for thread, i, at in messages:
            yield Row(thread=thread, id=i, at=at, state="new" if at is not None and (thread not in runs or at > runs[thread]) else "covered")


def late_or_covered(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """thread, id, at, state: a thread's messages (kind message) after its last run (kind run) are new, others covered.

    A message of no time passes as covered, and one of a thread that never ran is new. Runs of a batch count for the messages
    of that batch by time. State: the newest run of each thread, and when a row last touched it; sixteen threads of neighbouring
    numbers are a key.
    """
    block = F.call_function("shiftright", F.col("thread"), F.lit(BLOCK))
    rows = stream.select(block.alias("block"), "thread", "id", F.unix_micros("at").alias("at"), "kind")
    out = _keyed(rows, "block", _Late(keep), "thread long, id long, at long, state string")
    return out.select("thread", "id", F.timestamp_micros("at").alias("at"), "state")


class _Context(_Processor):
    def __init__(self, keep: int, before: int, most: int):
        super().__init__(keep)
        self.before, self.most = before, most

    def open(self, handle, keep_ms):
        self.mark = handle.getValueState("mark", "at long", keep_ms)
        self.last = handle.getListState("last", "id long, at long", keep_ms)

    def handleInputRows(self, key, rows: Rows, timerValues):
        found = self.mark.get()
        mark = found[0] if found else None
        times: dict[int, int] = {}
        for r in rows:
            if r.at is not None:
                times.setdefault(r.id, _us(r.at))
        new = [(i, t) for t, i in sorted((t, i) for i, t in times.items()) if mark is None or t > mark]
        if not new:
            return
        ahead = [tuple(x) for x in self.last.get()]
        self.mark.update((new[-1][1],))
        self.last.put([*ahead, *new][-self.before :])
        for i, t, fresh in [*((i, t, False) for i, t in ahead), *((i, t, True) for i, t in new)][-self.most :]:
            yield Row(thread=key[0], id=i, at=_at(t), fresh=fresh)


def new_with_context(stream: DataFrame, before: int = 2, most: int = 40, keep: int = KEEP) -> DataFrame:
    """thread, id, at, fresh: of each thread what came since the last batch, the newest ``most`` of it with the ``before``
    messages ahead of it. Messages of no time, and those not newer than what was seen, aren't new. State: the newest time of the
    thread and its last ``before`` messages, no more."""
    return _keyed(stream, "thread", _Context(keep, before, most), "thread long, id long, at timestamp, fresh boolean")


class _Memo(_Processor):
    def open(self, handle, keep_ms):
        self.times = handle.getValueState("times", "message long, check long", keep_ms)

    def handleInputRows(self, key, rows: Rows, timerValues):
        seen = {k: v for k, v in zip(("message", "check"), self.times.get() or ()) if v is not None}
        for r in rows:
            if (at := _us(r.at)) is not None:
                kind = "message" if r.kind == "message" else "check"
                seen[kind] = max(at, seen.get(kind, at))
        if seen:
            self.times.update((seen.get("message"), seen.get("check")))
        skip = len(seen) == 2 and seen["check"] >= seen["message"]
        yield Row(thread=key[0], state="skip" if skip else "need")


def memo(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """thread, state after each batch that has rows of it: skip a thread whose check (with or without a finding) is as new as its
    newest message, else it is needed.

    Rows: thread, at, kind (message, found, nothing). State: the newest message and the newest check.
    """
    return _keyed(stream, "thread", _Memo(keep), "thread long, state string")


class _Limit(_Processor):
    def __init__(self, keep: int, most: int):
        super().__init__(keep)
        self.most = most

    def open(self, handle, keep_ms):
        self.held = handle.getValueState("held", "at array<long>")

    def _timer(self, held: list[int]) -> int | None:
        return held[-1] // 1000 + self.keep * 1000 if held else None

    def handleInputRows(self, key, rows: Rows, timerValues):
        found = self.held.get()
        held, said = list(found[0]) if found else [], []
        before = self._timer(held)
        for now, i in sorted((_us(r.at), r.id) for r in rows):
            held = [t for t in held if t > now - self.keep * 1_000_000]
            said.append((i, len(held) < self.most))
            if said[-1][1]:
                held.append(now)
        if held:
            self.held.update((held,))
        if before != self._timer(held):
            if before is not None:
                self.handle.deleteTimer(before)
            if held:
                self.handle.registerTimer(self._timer(held))
        for i, ok in said:
            yield Row(key=key[0], id=i, allowed=ok)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter(())


def limited(stream: DataFrame, most: int, width_s: int, late: str = "1 day") -> DataFrame:
    """key, id, allowed: at most ``most`` events of a key in any ``width_s`` seconds; one exactly so old is out, and refused
    ones don't count. Events over ``late`` behind the newest of earlier batches get no answer.

    State: times of the allowed ones within the width, ``most`` of them at most; a timer drops them when the width has passed.
    """
    return _keyed(stream.withWatermark("at", late), "key", _Limit(width_s, most), "key long, id long, allowed boolean", "EventTime")


class _Counters(_Processor):
    NAMES = ("total", "skipped", "done", "failed", "stopped")

    def open(self, handle, keep_ms):
        self.state = handle.getValueState("state", f"stop boolean, final string, {', '.join(f'{k} long' for k in self.NAMES)}", keep_ms)

    def handleInputRows(self, key, rows: Rows, timerValues):
        stop, final, *counts = self.state.get() or (False, None, *(0 for _ in self.NAMES))
        n = dict(zip(self.NAMES, counts))
        asked = stop
        for r in rows:
            if r.kind == "stop":
                asked = True
            else:  # a task that begins after a stop was asked for ends at once
                n["stopped" if stop and r.kind in ("done", "failed") else r.kind] += r.n
        if final is None and 0 < n["total"] <= n["skipped"] + n["done"] + n["failed"] + n["stopped"]:
            final = "stopped" if asked else "completed"
        self.state.update((asked, final, *n.values()))
        yield Row(run=key[0], **n, state=final or ("stopping" if asked else "running"))


def counters(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """run, total, skipped, done, failed, stopped, state after every batch that has rows (run, kind, n) of it.

    Rows of kind total add work to a run, also while it runs; a row of kind stop asks it to end: tasks of later batches count as
    stopped. It is final, completed or stopped, when all kinds reach the total, and stays so.
    """
    return _keyed(stream, "run", _Counters(keep), "run long, total long, skipped long, done long, failed long, stopped long, state string")
