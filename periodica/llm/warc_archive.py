"""Content-addressed WARC archive.

``write`` stores every distinct payload once, under its SHA-256, and keeps the exact header block of every record in a
table of its own. ``records`` joins the two and rebuilds every record byte for byte; ``export`` writes them as WARC files, in
which each record ends with two line breaks, and ``read`` parses such files by the lengths that they state.

Of records with equal payloads of ``min_revisit`` bytes or more, the one with the smallest page_id is the response and
the others are revisits of it, without a block. A digest stands for one payload only: while writing, each group of equal
digests must agree in length and in an independent hash, while rebuilding, each stored payload must have its digest, and
while reading, each block must have the digest and the length of its header; else the job fails.

Payloads are moved twice, once to meet their equals, of which a task hands on one copy, and once to meet the header of their
response. Revisits meet digests and lengths only, so no payload is copied to the many pages that share it. A payload that many pages
share, such as an empty one, holds no task up: its rows are spread over slots, and every ``PER_COPY`` records meet a copy of their own.
A task reads a file of at most ``per_file`` records, compressed, and inflates a record at a time.

Edge cases: a null html is an empty payload; a null url leaves out its header line, and line breaks in a url are
percent-encoded; rows that repeat a page_id with the same payload are responses all, each with a record id of its own; rows
without a page_id come last of their equals; an empty table gives an empty archive. Other columns of the input are ignored.
Pages carry no time, so records bear that of the writing, unless a date is given.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm.common import shared_dir, table

CRLF = "\r\n"
HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "", ""])
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = (1 << 63) - 1
#: So many records of one payload meet one copy of it while records are rebuilt.
PER_COPY = 10_000


def _record_id(page_id: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest, copy.cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return keyed.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload").cast("long"))


def _spread_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key; the rows of a key are spread over as many tasks as a shuffle has.

    Each (key, slot) that occurs meets ``few`` first, of which a key has no more than there are slots, then its own rows.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slotted = rows.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(slots)))
    met = slotted.select(key, "_slot").distinct().join(few.hint("merge"), key)
    return slotted.join(met.hint("merge"), [key, "_slot"]).drop("_slot")


def write(pages: DataFrame, path: str, min_revisit: int = 100, date: str | None = None) -> None:
    """Write ``path``/payloads, ``path``/headers and ``path``/rows, which gives each record a number of its own."""
    spark = pages.sparkSession
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    keyed = _keyed(pages)
    order = F.coalesce("page_id", F.lit(LAST))
    payloads = keyed.groupBy("digest").agg(
        F.min_by("payload", order).alias("payload"),
        F.min("n").alias("n"),
        F.max("n").alias("n_most"),
        F.min(F.xxhash64("payload")).alias("h"),
        F.max(F.xxhash64("payload")).alias("h_most"),
        F.ceil(F.count("*") / PER_COPY).alias("copies"),
    )
    same = (F.col("n") == F.col("n_most")) & (F.col("h") == F.col("h_most"))
    stored = F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    payloads.select(stored.alias("digest"), "n", "copies", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    # once written, the number of a row is the same for all that read it
    keyed.drop("payload").withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    first = rows.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "at", "page_id")).alias("first"), F.ceil(F.count("*") / PER_COPY).alias("copies"))
    rows = _spread_join(rows, first, "digest", "at")
    first_page = F.col("first.page_id")
    name = F.when(F.col("at") == F.col("first.at"), F.lit("first")).otherwise(F.col("at").cast("string"))
    revisit = (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(first_page)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), name)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(first_page, F.col("digest"), F.lit("first")))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.when(revisit, first_page.cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n") + len(HTTP)).cast("string")),
        F.lit(CRLF),
    )
    copy = F.pmod(F.xxhash64("at"), F.col("copies"))
    rows.select("digest", copy.alias("copy"), revisit.alias("revisit"), header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """digest and the exact bytes of every record; a stored payload that does not have its digest fails the job."""
    headers = spark.read.parquet(f"{path}/headers")
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
    stored = spark.read.parquet(f"{path}/payloads").select("digest", whole.alias("payload"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    responses = headers.where("not revisit").join(stored.hint("merge"), ["digest", "copy"])
    responses = responses.select("digest", F.concat(F.encode("header", "UTF-8"), F.lit(HTTP.encode()), "payload").alias("record"))
    return responses.unionAll(headers.where("revisit").select("digest", F.encode("header", "UTF-8").alias("record")))


def export(rows: DataFrame, to: str, per_file: int = 2_000) -> None:
    """Records (column record) as WARC files, compressed with gzip; a line of Spark's text writer is a record here."""
    lines = rows.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(to)


def inflated(data: bytes, step: int = 1 << 16):
    """What a gzip file of one or many members holds, in chunks."""
    view, member = memoryview(data), None
    for k in range(0, len(data), step):
        rest = view[k : k + step]
        while rest:
            member = member or zlib.decompressobj(31)
            yield member.decompress(rest)
            rest, member = (member.unused_data, None) if member.eof else (b"", member)
    if member:
        raise ValueError("a file ends within a member")


def parse(data):
    """(fields of the header, block) of every record of a WARC file, given as bytes or as chunks; one record is held at a time."""
    chunks, held = iter([data] if isinstance(data, bytes) else data), bytearray()

    def reach(enough, wrong: str):
        while not enough():
            chunk = next(chunks, None)
            if chunk is None:
                raise ValueError(wrong)
            held.extend(chunk)

    while True:
        while not held:
            chunk = next(chunks, None)
            if chunk is None:
                return
            held.extend(chunk)
        reach(lambda: b"\r\n\r\n" in held, "a header has no end")
        end = held.index(b"\r\n\r\n")
        version, *lines = held[:end].decode("utf-8", "surrogateescape").split(CRLF)
        if not re.fullmatch(r"WARC/1\.\d", version):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(fields["Content-Length"])
        reach(lambda: len(held) >= stop + 4, "a record's length is wrong")  # noqa: B023
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


SCHEMA = "page_id long, url string, record_type string, digest string, refers_to long, record_id string, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of WARC files; bytes and length of its payload, which a revisit has none of."""

    def frame(rows):
        d = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return d.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

    def run(frames):
        for content in (c for f in frames for c in f.content):
            rows, held = [], 0
            for h, block in parse(inflated(content)):
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                body = None
                if h["WARC-Type"] == "response":
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    if hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError("a record's payload does not have its digest")
                number = lambda k, h=h: int(h[k]) if k in h else None
                rows.append((number("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, number("X-Refers-To-Page-Id"), h["WARC-Record-ID"], None if body is None else len(body), body if payloads else None))
                held += len(body or b"") if payloads else 0
                if len(rows) == 2000 or held > 16 << 20:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(run, SCHEMA)


def op5_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    export(records(spark, path), f"{path}/files")
    found = read(spark, f"{path}/files", payloads=False)
    # a revisit's payload is its response's
    whole = spark.read.parquet(f"{path}/payloads").select("digest", "n")
    sized = found.where("record_type = 'revisit'").drop("payload_bytes")
    sized = _spread_join(sized, whole, "digest", "record_id").withColumnRenamed("n", "payload_bytes")
    every = found.where("record_type = 'response'").unionByName(sized)
    return every.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_page from p group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to
from p join f using (payload_digest)
"""
