"""A mailbox as a data source: messages in order of (time, id) after a cursor, in spans that tasks read, behind one interface for any store.

A cursor is the time and the id of a message, so messages of one time are told apart. A stream's offset is the cursor of the newest message;
a batch is all that lies between two cursors, cut into spans of ``span`` messages, and nothing in between is left out. With ``overlap``
a batch begins so many seconds earlier, for mail that arrives out of order; what it reads again is told by its id (``ingest.once``,
``ingest.deltas_into``).
"""

from __future__ import annotations

import bisect
import collections
import datetime
import functools
import json
import pathlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "message_id string, conversation_id string, sender string, subject string, received_at timestamp, body string"
PAGE, CAP, THREAD_CAP, SPAN = 50, 5000, 200, 500
#: Bytes of a file that a task reads.
RANGE = 16 << 20

#: (time in UTC, id): ordered as messages are.
Cursor = tuple[datetime.datetime, str]
BEGIN: Cursor = (datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), "")


def cursor(row: tuple) -> Cursor:
    return row[4], row[0] or ""


def written(at: Cursor) -> dict:
    return {"at": at[0].isoformat(), "id": at[1]}


def read(at: dict) -> Cursor:
    return datetime.datetime.fromisoformat(at["at"]), at["id"]


class Span(InputPartition):
    def __init__(self, after: Cursor, until: Cursor):
        self.after, self.until = after, until


class Range(Span):
    """Bytes of a file, for the messages in them between two cursors."""

    def __init__(self, after: Cursor, until: Cursor, path: str, begin: int, end: int):
        super().__init__(after, until)
        self.path, self.begin, self.end = path, begin, end


class Store(ABC):
    """Where mail comes from."""

    @abstractmethod
    def page(self, after: Cursor, until: Cursor | None, size: int) -> list[tuple]:
        """The first ``size`` rows of ``SCHEMA`` behind ``after`` and up to ``until``, oldest first; an empty page ends the list."""

    @abstractmethod
    def newest(self) -> Cursor | None:
        """The cursor of the newest message; None in an empty mailbox."""

    def messages(self, after: Cursor, until: Cursor | None, size: int) -> Iterator[tuple]:
        while rows := self.page(after, until, size):
            yield from rows
            after = cursor(rows[-1])

    def spans(self, after: Cursor, until: Cursor, size: int, span: int) -> Iterator[tuple[Cursor, Cursor]]:
        """Cursors that cut what lies between two of them into spans; one is held at a time."""
        begin, n, last = after, 0, after
        for row in self.messages(after, until, size):
            n, last = n + 1, cursor(row)
            if n == span:
                yield begin, last
                begin, n = last, 0
        if n:
            yield begin, last

    def splits(self, after: Cursor, until: Cursor, size: int, span: int) -> Iterator[Span]:
        """What tasks read of a batch, in any order; together all that lies between two cursors."""
        return (Span(*s) for s in self.spans(after, until, size, span))

    def split(self, span: Span, size: int) -> Iterator[tuple]:
        return self.messages(span.after, span.until, size)


def _row(line: bytes | str) -> tuple:
    m = json.loads(line)
    at = datetime.datetime.fromisoformat(m["received_at"])
    at = at.replace(tzinfo=datetime.UTC) if at.tzinfo is None else at.astimezone(datetime.UTC)
    return m["message_id"], m.get("conversation_id"), m.get("sender"), m.get("subject"), at, m.get("body")


@functools.lru_cache(1 << 16)
def _newest(path: str, *_) -> Cursor | None:
    """The newest cursor of a file, whose lines are read one at a time; once as long as the file is the same."""
    with open(path, "rb") as f:
        return max((cursor(_row(x)) for x in f if x.strip()), default=None)


@functools.lru_cache(4)
def _sorted(files: tuple) -> tuple[list, list]:
    """Rows and cursors of JSON files, in order; read once as long as the files are the same."""
    rows = []
    for path, *_ in files:
        with open(path, "rb") as f:
            rows += [_row(x) for x in f if x.strip()]
    rows.sort(key=cursor)
    return rows, [cursor(r) for r in rows]


class Folder(Store):
    """Files of JSON lines in a folder that all machines see: a mailbox for trials.

    Tasks of a stream read ranges of bytes of the files and hold a line at a time. Reading in order (``page``: batches, and streams with a
    ``limit``) sorts all messages in memory.
    """

    def __init__(self, path: str):
        self.path = pathlib.Path("/" + path.removeprefix("file:").lstrip("/"))

    def _files(self) -> tuple[tuple[str, int, int], ...]:
        return tuple((str(f), s.st_mtime_ns, s.st_size) for f in sorted(self.path.glob("[!._]*.json*")) for s in (f.stat(),))

    def _all(self) -> tuple[list, list]:
        return _sorted(self._files())

    def page(self, after, until, size):
        rows, at = self._all()
        first = bisect.bisect_right(at, after)
        return rows[first : min(first + size, len(at) if until is None else bisect.bisect_right(at, until))]

    def newest(self):
        return max((at for f in self._files() if (at := _newest(*f))), default=None)

    def splits(self, after, until, size, span):
        # a file without anything newer than ``after`` has nothing to read
        for f in self._files():
            if (at := _newest(*f)) and at > after:
                for begin in range(0, f[2], RANGE):
                    yield Range(after, until, f[0], begin, begin + RANGE)

    def split(self, span, size):
        with open(span.path, "rb") as f:
            if span.begin:  # a line belongs to the range in which it begins
                f.seek(span.begin - 1)
                f.readline()
            while f.tell() < span.end and (line := f.readline()):
                if line.strip() and span.after < cursor(row := _row(line)) <= span.until:
                    yield row


STORES = {"folder": Folder}


class _Reader(DataSourceReader):
    """The newest ``cap`` messages after ``since``, newest first."""

    def __init__(self, options):
        self.store = STORES[options.get("store", "folder")](options["path"])
        since = options.get("since")
        self.since = (datetime.datetime.fromisoformat(since), "\U0010ffff") if since else BEGIN
        self.size, self.cap, self.span = int(options.get("page", PAGE)), int(options.get("cap", CAP)), int(options.get("span", SPAN))
        self.overlap, self.limit = float(options.get("overlap", 0)), int(options.get("limit", 0))

    def partitions(self):
        newest = self.store.newest()
        if newest is None:
            return []
        last = collections.deque(map(cursor, self.store.messages(self.since, newest, self.size)), maxlen=self.cap + 1)
        begin = last[0] if len(last) > self.cap else self.since
        return [Span(*s) for s in self.store.spans(begin, newest, self.size, self.span)][::-1]

    def read(self, span):
        yield from reversed(list(self.store.messages(span.after, span.until, self.size)))  # ``span`` messages at most


class _Stream(_Reader, DataSourceStreamReader):
    """All messages in order. ``limit``: a batch that follows another of the same run ends after so many messages; the rest is the next one's."""

    known: Cursor | None = None

    def initialOffset(self):
        self.known = self.since
        return written(self.since)

    def latestOffset(self):
        newest = self.store.newest()
        if newest is None or (self.known and newest < self.known):
            return written(self.known or self.since)
        if self.limit and self.known:
            for k, row in enumerate(self.store.messages(self.known, newest, self.size), 1):
                if k == self.limit:
                    return written(cursor(row))
        return written(newest)

    def partitions(self, start, end):
        after, until = read(start), read(end)
        self.known = until
        if after >= until:
            return []
        if self.overlap and after > BEGIN:
            after = max(self.since, (after[0] - datetime.timedelta(seconds=self.overlap), ""))
        return list(self.store.splits(after, until, self.size, self.span))

    def read(self, span):
        yield from self.store.split(span, self.size)


class Mailbox(DataSource):
    """``spark.read.format("mailbox").option("path", ...)``; options store, since, page, span, cap, and for streams overlap and limit."""

    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def mailbox(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    spark.dataSource.register(Mailbox)
    reader = (spark.readStream if stream else spark.read).format("mailbox").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def conversation(messages: DataFrame, of: str, cap: int = THREAD_CAP) -> DataFrame:
    """All messages of one conversation, oldest first, ``cap`` at most."""
    return messages.where(F.col("conversation_id") == of).orderBy("received_at", "message_id").limit(cap)
