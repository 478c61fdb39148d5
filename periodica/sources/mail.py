"""Mail files: one row a file to one row a message, its parts, and the messages nested in it."""

from __future__ import annotations

import email
import email.policy
import email.utils
import functools
import itertools
from collections.abc import Iterable, Iterator
from email.message import EmailMessage

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 4
#: Mails that a task parses or builds at once, and bytes of parts that it gathers before it gives them away.
MAILS, HELD = 200, 8 << 20
PART = "name string, content_type string, size long, cid string, is_inline boolean, content binary"
MESSAGE = f"path string, subject string, from_ string, to string, date timestamp, body_text string, body_html string, attachments array<struct<{PART.replace(' string', ': string').replace(' long', ': long').replace(' boolean', ': boolean').replace(' binary', ': binary')}>>"
ITEM = "path string, label string, depth int, place int, content_type string, content binary"


@functools.lru_cache(4096)
def _header(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


class _Policy(email.policy.EmailPolicy):
    """Reads a header of the same name and value once: a message asks for its content type some twenty times."""

    def header_fetch_parse(self, name, value):
        return value if hasattr(value, "name") else _header(name, value)


_READ, _WRITE = _Policy(), _Policy(linesep="\r\n")


def _parts(m) -> Iterator[tuple]:
    """Leaves of a message; a message in it is one leaf."""
    if m.get_content_type() == "message/rfc822":
        inner = m.get_payload(0)
        yield m, inner.as_bytes(), m.get_filename() or f"{inner.get('Subject') or 'message'}.eml"
    elif m.is_multipart():
        for p in m.iter_parts():
            yield from _parts(p)
    else:
        yield m, m.get_payload(decode=True) or b"", m.get_filename()


def parse(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=_READ)
    out = {"subject": m.get("Subject"), "from_": m.get("From"), "to": m.get("To"), "date": None, "body_text": None, "body_html": None, "attachments": []}
    try:
        at = email.utils.parsedate_to_datetime(m["Date"]) if m["Date"] else None
        out["date"] = pd.Timestamp(at).tz_localize("UTC") if at is not None and at.tzinfo is None else at
    except (TypeError, ValueError):
        pass
    for p, content, name in ([(m, m.get_payload(0).as_bytes(), None)] if m.get_content_type() == "message/rfc822" else _parts(m)):
        kind = p.get_content_type()
        body = {"text/plain": "body_text", "text/html": "body_html"}.get(kind)
        if body and name is None and p.get_content_disposition() != "attachment":
            text = content.decode(p.get_content_charset() or "utf-8", "replace")
            out[body] = text if out[body] is None else f"{out[body]}\n{text}"
        else:
            cid = (p.get("Content-ID") or "").strip("<> ") or None
            out["attachments"].append({"name": name or "part", "content_type": kind, "size": len(content), "cid": cid, "is_inline": p.get_content_disposition() == "inline", "content": content})
    return out


def _tasks(mails: DataFrame) -> int:
    """Mails are small and take long: a number of tasks that isn't lowered to suit the bytes."""
    return int(mails.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``frames``, ``MAILS`` at a time: what is parsed or built of them is held no longer."""
    for f in frames:
        for k in range(0, len(f), MAILS):
            yield f.iloc[k : k + MAILS]


def messages(files: DataFrame) -> DataFrame:
    """One row per file (path, content). What is no mail at all gives a row without headers; a broken date is null."""

    def run(frames):
        for f in _few(frames):
            rows = [{"path": p, **parse(bytes(c or b""))} for p, c in zip(f.path, f.content)]
            yield pd.DataFrame(rows, columns=["path", "subject", "from_", "to", "date", "body_text", "body_html", "attachments"]).assign(date=lambda d: pd.to_datetime(d.date, utc=True))

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def flattened(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per leaf of every mail: bodies and attachments of the message and of those nested in it, in page order.

    ``label`` names the way to the leaf; a message nested ``depth`` deep stays one leaf.
    """

    def walk(raw: bytes, label: str, at: int):
        m = parse(raw)
        for name in ("body_text", "body_html"):
            if m[name]:
                yield f"{label}/{name}", at, "text/html" if name == "body_html" else "text/plain", m[name].encode()
        for a in m["attachments"]:
            if a["content_type"] == "message/rfc822" and at + 1 < depth:
                yield from walk(a["content"], f"{label}/{a['name']}", at + 1)
            else:
                yield f"{label}/{a['name']}", at, a["content_type"], a["content"]

    def run(frames):
        frame = functools.partial(pd.DataFrame, columns=["path", "label", "depth", "place", "content_type", "content"])
        rows, held = [], 0
        for f in frames:
            for path, content in zip(f.path, f.content):
                for k, (label, at, kind, c) in enumerate(walk(bytes(content or b""), "", 0)):
                    rows.append((path, label, at, k, kind, c))
                    held += len(c)
                    if held > HELD or len(rows) >= 10 * MAILS:
                        yield frame(rows)
                        rows, held = [], 0
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, ITEM)


def built(subject: str | None, sender: str | None, to: str | None, date: str | None, text: str | None, html: str | None) -> bytes:
    """A mail of the columns that are left of it."""
    m = EmailMessage(policy=_WRITE)
    for name, value in (("Subject", subject), ("From", sender), ("To", to), ("Date", date)):
        if value:
            m[name] = " ".join(value.split())
    m.set_content(text or "")
    if html:
        m.add_alternative(html, subtype="html")
    return m.as_bytes()


def rebuilt(mails: DataFrame) -> DataFrame:
    """id and ``content``: the native bytes where they are (column raw), else a mail built from subject, sender, to, date, text, html."""

    def run(frames):
        for f in _few(frames):
            g = f.astype(object).where(f.notna(), None)
            content = [bytes(r.raw) if r.raw is not None else built(r.subject, r.sender, r.to, r.date, r.text, r.html) for r in g.itertuples()]
            yield pd.DataFrame({"id": f.id, "content": content})

    wanted = mails.select("id", "raw", "subject", "sender", "to", "date", "text", "html")
    return wanted.repartition(_tasks(mails)).mapInPandas(run, "id long, content binary")


def bundle(mails: Iterable[bytes]) -> bytes:
    """One mail that holds others, each a message in it."""
    out = EmailMessage(policy=_WRITE)
    out.make_mixed()
    for raw in mails:
        part = EmailMessage(policy=_WRITE)
        part.set_content(email.message_from_bytes(bytes(raw), policy=_READ))
        out.attach(part)
    return out.as_bytes()


def bundled(mails: DataFrame, thread: str, order: str) -> DataFrame:
    """thread and ``content``: one mail that holds the thread's mails (column content), oldest first, each a message in it."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        give = lambda keys, contents: pa.RecordBatch.from_arrays([pa.array(keys, first.schema.field(0).type), pa.array(contents, pa.binary())], names=[thread, "content"])
        rows = itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in itertools.chain([first], batches))
        keys, contents, held = [], [], 0
        for key, of in itertools.groupby(rows, key=lambda r: r[0]):
            keys.append(key)
            contents.append(bundle(raw for _, raw in of))
            held += len(contents[-1])
            if held > HELD or len(keys) >= MAILS:
                yield give(keys, contents)
                keys, contents, held = [], [], 0
        yield give(keys, contents)

    # the mails of a thread follow one another in a task, which bundles one thread at a time
    by_thread = mails.select(thread, order, "content").repartition(_tasks(mails), thread).sortWithinPartitions(thread, F.col(order).asc_nulls_last())
    return by_thread.select(thread, "content").mapInArrow(run, f"{thread} {dict(mails.dtypes)[thread]}, content binary")


def text_items(spark, path: str, most: int = 20_000) -> DataFrame:
    """path and the first ``most`` characters of text files, bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring(F.make_valid_utf8(F.col("content").cast("string")), 1, most).alias("text"))
