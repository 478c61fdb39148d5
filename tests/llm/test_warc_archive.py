import gzip
import hashlib
import pathlib

import pytest

from periodica.llm import warc_archive as w
from tests.llm.helpers import SF, same

SCHEMA = "page_id long, url string, html string, digest string, n int"
LONG, SHORT = "<p>é\r\n\r\nWARC/1.1\r\n" * 40, "<p>"
ROWS = [(5, "http://x/5", LONG, "d", 1), (3, None, LONG, "d", 1), (9, "http://x\r\nEvil: 1", LONG, "d", 1), (1, "u", SHORT, None, None), (2, "u", SHORT, "", 2)]
ROWS += [(4, "u", None, "", 3), (6, "", "", "", 3), (3, None, LONG, "d", 1), (None, "u", LONG, None, 1), (None, None, "alone " * 30, None, 1)]


def archive(spark, tmp_path, rows):
    w.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", date="2020-01-02T03:04:05Z")
    w.export(w.records(spark, f"file://{tmp_path}/a"), f"file://{tmp_path}/a/files")
    return w.read(spark, f"file://{tmp_path}/a/files")


def test_matches_sql(spark):
    same(w.op5_warc_archive(spark, SF), w.ORACLE)


def test_round_trip_and_hard_rows(spark, tmp_path):
    got = archive(spark, tmp_path, ROWS).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((x[0] is None, x[0] or 0) for x in ROWS)
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids)
    for r in got:
        texts = {(x[2] or "").encode() for x in ROWS if x[0] == r.page_id}
        if r.record_type == "response":
            assert bytes(r.payload) in texts and r.payload_bytes == len(r.payload) and r.digest == hashlib.sha256(r.payload).hexdigest()
        else:
            assert r.payload is None and r.digest == hashlib.sha256(LONG.encode()).hexdigest()
        assert r.url is None or "\n" not in r.url
        assert r.page_id is None or (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (5, 9) else ("response", None))
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 4


def test_files_are_plain_warc(spark, tmp_path):
    """Read by the rules of the format alone: version, header, a block of the stated length, two line breaks."""
    archive(spark, tmp_path, ROWS)
    seen = 0
    for file in pathlib.Path(tmp_path, "a/files").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields) and "Evil" not in fields
            block, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
            assert data[:4] == b"\r\n\r\n"
            data, seen = data[4:], seen + 1
            if fields["WARC-Type"] == "response":
                assert hashlib.sha256(block.split(b"\r\n\r\n", 1)[1]).hexdigest() == fields["WARC-Payload-Digest"].split(":")[1]
            else:
                assert block == b"" and fields["WARC-Refers-To"].startswith("<urn:uuid:")
    assert seen == len(ROWS)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    archive(spark, tmp_path, ROWS)
    broken = spark.read.parquet(f"file://{tmp_path}/a/payloads").selectExpr("digest", "n", "copies", "cast('x' as binary) as payload")
    broken.write.parquet(f"file://{tmp_path}/b/payloads")
    spark.read.parquet(f"file://{tmp_path}/a/headers").write.parquet(f"file://{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        w.records(spark, f"file://{tmp_path}/b").collect()
    with pytest.raises(ValueError):
        list(w.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"))


def test_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, []).count() == 0


def test_a_payload_of_many_pages_is_spread(spark, tmp_path, monkeypatch):
    """Half of all pages empty, and one page many times: records meet several copies of a payload, each with an id of its own."""
    monkeypatch.setattr(w, "PER_COPY", 50)
    rows = [(k, "u", "", None, None) for k in range(300)] + [(1000, "u", LONG, None, None)] * 120 + [(2000 + k, None, LONG, None, None) for k in range(80)] + [(None, None, "", None, None)] * 40
    got = archive(spark, tmp_path, rows).collect()
    assert len(got) == len({r.record_id for r in got}) == 540
    assert sum(r.record_type == "revisit" for r in got) == 80 and {r.refers_to for r in got if r.record_type == "revisit"} == {1000}
    files = [gzip.decompress(f.read_bytes()) for f in pathlib.Path(tmp_path, "a/files").glob("*.gz")]
    fields = [h for f in files for h, _ in w.parse(f)]
    assert {h["WARC-Refers-To"] for h in fields if "WARC-Refers-To" in h} <= {h["WARC-Record-ID"] for h in fields if h["WARC-Type"] == "response"}
    assert {r.copies for r in spark.read.parquet(f"file://{tmp_path}/a/payloads").collect()} == {4, 7}


def test_files_of_many_members_and_broken_ones():
    record = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n", b"x" * 300_000]
    members = b"".join(gzip.compress(record(b)) for b in bodies)
    for data, step in ((members, 7), (members, 1 << 16), (gzip.compress(b"".join(map(record, bodies))), 1000)):
        assert [block for _, block in w.parse(w.inflated(data, step))] == bodies
    for wrong in (members[:-9], members + b"junk"):
        with pytest.raises(Exception):
            list(w.parse(w.inflated(wrong)))
    assert list(w.parse(w.inflated(b""))) == []
