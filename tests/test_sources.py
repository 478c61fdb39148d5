"""Mails, workbooks and folders: written, read back, and broken."""

import io
import json
import zipfile
from email.message import EmailMessage

from pyspark.sql import functions as F

from periodica.operators import relational
from periodica.sources import mail, mailbox, vault, workbooks
from periodica.streaming import ingest


def letter(subject, text, *parts, html=None):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = subject, "a@x.org", "b@x.org", "Mon, 05 Jun 2023 10:00:00 +0400"
    m.set_content(text)
    if html:
        m.add_alternative(html, subtype="html")
    for p in parts:
        if isinstance(p, EmailMessage):
            m.add_attachment(p)
        else:
            m.add_attachment(p[1], maintype="application", subtype="pdf", filename=p[0])
    return m


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_messages(spark):
    inner = letter("inner", "inside", ("deep.pdf", b"%PDF deep"))
    raw = letter("Été", "hello", ("a.pdf", b"%PDF a"), inner, html="<p>hello</p>").as_bytes()
    got = {r.path: r for r in mail.messages(files(spark, [("m", raw), ("junk", b"no mail at all"), ("empty", b""), ("date", b"Date: whenever\n\nx")])).collect()}
    m = got["m"]
    assert (m.subject, m.from_, m.body_text.strip(), m.body_html.strip()) == ("Été", "a@x.org", "hello", "<p>hello</p>") and m.date.isoformat() == "2023-06-05T06:00:00"
    assert [(a.name, a.content_type) for a in m.attachments] == [("a.pdf", "application/pdf"), ("inner.eml", "message/rfc822")]
    assert got["junk"].subject is None and got["empty"].attachments == [] and got["date"].date is None


def test_nested_messages(spark):
    m = letter("0", "t0")
    for k in range(1, 7):
        m = letter(str(k), f"t{k}", m)
    got = mail.flattened(files(spark, [("m", m.as_bytes())])).orderBy("place").collect()
    assert [(r.depth, r.content_type) for r in got] == [(0, "text/plain"), (1, "text/plain"), (2, "text/plain"), (3, "text/plain"), (3, "message/rfc822")]
    assert b"t6" in bytes(got[0].content) and [r.place for r in got] == list(range(5))
    flat = mail.flattened(files(spark, [("m", letter("s", "x", letter("i", "y", ("d.pdf", b"%PDF d"))).as_bytes())])).collect()
    assert [r.label for r in flat] == ["/body_text", "/i.eml/body_text", "/i.eml/d.pdf"]


def test_rebuilt_and_bundled(spark):
    rows = [(1, bytearray(b"raw"), None, None, None, None, None, None), (2, None, "A\nB", "a@x.org", "b@x.org", None, "text", "<p>h</p>"), (3, None, None, None, None, None, None, None)]
    made = mail.rebuilt(spark.createDataFrame(rows, "id long, raw binary, subject string, sender string, to string, date string, text string, html string"))
    got = {r.id: bytes(r.content) for r in made.collect()}
    assert got[1] == b"raw" and mail.parse(got[2])["subject"] == "A B" and mail.parse(got[2])["body_html"].strip() == "<p>h</p>" and mail.parse(got[3])["body_text"].strip() == ""
    several = spark.createDataFrame([(7, 2, bytearray(letter("second", "2").as_bytes())), (7, 1, bytearray(letter("first", "1").as_bytes())), (8, 1, bytearray(letter("alone", "3").as_bytes()))], "thread long, at int, content binary")
    out = {r.thread: bytes(r.content) for r in mail.bundled(several, "thread", "at").collect()}
    assert [a["name"] for a in mail.parse(out[7])["attachments"]] == ["first.eml", "second.eml"] and len(mail.parse(out[8])["attachments"]) == 1


def test_mails_are_read_in_few_frames_and_headers_once(spark, monkeypatch):
    mails = spark.range(300).selectExpr("id", "id % 60 as thread", "cast(null as binary) as raw", "concat('s', id) as subject", "'a@x.org' as sender", "'b@x.org' as to", "cast(null as string) as date", "'t' as text", "cast(null as string) as html")
    made = mail.rebuilt(mails).withColumn("thread", F.col("id") % 60)
    assert made.rdd.getNumPartitions() == 4
    whole = mail.bundled(made, "thread", "id")
    assert whole.rdd.getNumPartitions() == 4  # as many tasks as are asked for, however few bytes there are
    got = mail.flattened(whole.selectExpr("cast(thread as string) as path", "content")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("l")).collect()
    assert {int(r.path): [x.label for x in r.l] for r in got} == {t: [f"/s{t + 60 * k}.eml/body_text" for k in range(5)] for t in range(60)}
    raw, asked = letter("once", "read", ("a.pdf", b"%PDF a"), letter("in", "it")).as_bytes(), []
    read = mail.email.headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(mail.email.headerregistry.HeaderRegistry, "__call__", lambda self, name, value: asked.append((name, value)) or read(self, name, value))
    mail.parse(raw)
    assert len(asked) == len(set(asked))


def test_text_items(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc \xff" + b"x" * 30_000)
    r = mail.text_items(spark, str(tmp_path)).first()
    assert len(r.text) == 20_000 and r.text.startswith("abc ")


def test_workbooks_round_trip(spark):
    grid = [["Emp ID", "DCO", "Employees Name", "Project", "Account Managers Name", "Contact No.", "Email"], ["12", "D-1", "Ann & Bo", None, "M", "5", "a@x.org"], [None] * 7, [13, None, "<Cy>", "P", None, None, None]]
    other = [["report of May"], ["Full Name", "Employee ID"], ["Dan", "E9"]]
    rows = workbooks.read(files(spark, [("a", workbooks.written(grid, [None, "FFFFFF00", None, None])), ("b", workbooks.written(other)), ("junk", b"PK no zip"), ("empty", b"")]))
    found = {(r.path, r.row): r for r in rows.collect()}
    assert found["a", 2].cells[2] == "Ann & Bo" and found["a", 2].fills[0] == "FFFFFF00" and found["a", 1].fills[0] is None
    people = {r.badge: (r.name, r.project, r.address) for r in workbooks.roster(rows).collect()}
    assert people == {"12": ("Ann & Bo", None, "a@x.org"), "13": ("<Cy>", "P", None), "E9": ("Dan", None, None)}
    text = {r.path: r.text for r in workbooks.as_text(rows).collect()}
    assert text["b"] == "report of May\nFull Name | Employee ID\nDan | E9" and "Ann & Bo [FFFFFF00]" in text["a"]


def test_merged_cells():
    raw = workbooks.written([["a", "b"], ["c", "d"], ["e", "f"]])
    book = zipfile.ZipFile(io.BytesIO(raw))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in book.namelist():
            z.writestr(name, book.read(name).replace(b"</sheetData>", b'</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>'))
    assert [r[2] for r in workbooks.cells(out.getvalue())] == [["a", "a"], ["a", "a"], ["e", "f"]]
    assert [r[2] for r in workbooks.cells(raw, rows=2, columns=1)] == [["a"], ["c"]]


def test_a_workbook_for_each_key(spark):
    df = spark.createDataFrame([("x", 2, "b", None), ("x", 1, "a", "FFFF0000"), ("y", 1, None, None)], "k string, n int, v string, colour string")
    out = {r.k: [(x[2], x[3]) for x in workbooks.cells(bytes(r.content))] for r in workbooks.write_by(df, "k", "n", "colour").collect()}
    assert out["x"] == [(["n", "v"], [None, None]), (["1", "a"], ["FFFF0000", "FFFF0000"]), (["2", "b"], [None, None])] and out["y"][1][0] == ["1"]


def test_vault(spark, tmp_path):
    for path, text in {"team/Ann/May-2024/a.txt": "aaa", "team/Ann/June-2023/b.txt": "bb", "team/Bob/May-2024/c.txt": "c", "_hidden/x/y/z.txt": "no"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    listed = vault.listed(spark, str(tmp_path))
    assert sorted(r.path for r in listed.collect()) == ["team/Ann/June-2023/b.txt", "team/Ann/May-2024/a.txt", "team/Bob/May-2024/c.txt"]
    assert {(r.year, r.files, r.bytes) for r in vault.by_year(listed).collect()} == {(2024, 2, 4), (2023, 1, 2)}
    kids = {r.folder: (r.level, r.children, r.bytes) for r in vault.children(listed).collect()}
    assert kids["team"] == (0, 2, 6) and kids["team/Ann"] == (1, 2, 5) and kids["team/Ann/May-2024"] == (2, 1, 3)
    assert tuple(vault.scope_size(listed, F.col("path").contains("Ann")).first()) == (2, 5) and tuple(vault.scope_size(listed, F.lit(False)).first()) == (0, 0)
    assert vault.expired(listed, F.current_timestamp()).count() == 0 and vault.expired(listed, F.current_timestamp() + F.expr("interval 61 days")).count() == 3
    assert {r.path: bytes(r.content) for r in vault.contents(spark, str(tmp_path)).collect()}["team/Bob/May-2024/c.txt"] == b"c"


def test_mailbox(spark, tmp_path):
    def put(name, *hours):
        lines = [json.dumps({"message_id": f"m{h}", "conversation_id": "c" if h % 2 else "d", "received_at": f"2024-01-01T{h:02}:00:00+00:00"}) for h in hours]
        (tmp_path / "box" / name).write_text("\n".join(lines))

    (tmp_path / "box").mkdir()
    put("a.jsonl", 1, 2, 3, 5)
    box = str(tmp_path / "box")
    assert [r.message_id for r in mailbox.mailbox(spark, box, page=2).collect()] == ["m5", "m3", "m2", "m1"]
    assert [r.message_id for r in mailbox.mailbox(spark, box, page=2, cap=3).collect()] == ["m5", "m3", "m2"]
    assert [r.message_id for r in mailbox.mailbox(spark, box, since="2024-01-01T02:00:00+00:00").collect()] == ["m5", "m3"]
    assert [r.message_id for r in mailbox.conversation(mailbox.mailbox(spark, box), "c", 2).collect()] == ["m1", "m3"]
    for hours in ((), (7,)):
        if hours:
            put("b.jsonl", *hours)
        ingest.run(mailbox.mailbox(spark, box, stream=True), f"{tmp_path}/state", path=f"{tmp_path}/out")
    assert sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["m1", "m2", "m3", "m5", "m7"]


def test_a_mailbox_loses_no_message(spark, tmp_path):
    """More messages than a page, a span or a limit; equal times; mail that arrives late; runs again from the checkpoint."""
    box = tmp_path / "box"
    box.mkdir()
    put = lambda name, rows: (box / name).write_text("\n".join(json.dumps({"message_id": i, "received_at": f"2024-01-01T00:{m:02}:00+00:00"}) for i, m in rows))
    put("a.jsonl", [(f"m{k:02}", k // 4) for k in range(20)])
    seen = []

    def go(**options):
        before = len(seen)
        stream = mailbox.mailbox(spark, str(box), stream=True, page=3, span=4, **options)
        ingest.run(stream, f"{tmp_path}/state", each=lambda df, n: seen.extend(r.message_id for r in df.collect()))
        return sorted(seen[before:])

    assert go() == [f"m{k:02}" for k in range(20)] and go() == []
    put("b.jsonl", [(f"n{k:02}", 4 if k < 2 else 9) for k in range(12)])  # two of the time that was the newest, behind it by id
    assert go() == [f"n{k:02}" for k in range(12)]
    put("c.jsonl", [("late", 7), ("z", 9)])
    assert go(overlap=180) == ["late", *(f"n{k:02}" for k in range(2, 12)), "z"]
    assert len(set(seen)) == 34
    plan = mailbox._Stream({"path": str(box), "page": "3", "span": "4", "limit": "6"})
    start, ends = plan.initialOffset(), []
    while (end := plan.latestOffset()) != start:
        spans = plan.partitions(start, end)
        ends.append(sum(len(list(plan.read(x))) for x in spans))
        start = end
    assert ends == [6] * 5 + [4] and all(len(list(plan.read(x))) <= 4 for x in spans)
    assert mailbox.mailbox(spark, str(box), page=2, span=3, cap=10).count() == 10
    assert [r.message_id for r in mailbox.mailbox(spark, str(box), span=3, cap=4).collect()] == ["z", "n11", "n10", "n09"]


def test_names_that_overwrite_nothing(spark):
    df = spark.createDataFrame([("f", "a.pdf", 1), ("f", "a.pdf", 2), ("f", "b.pdf", 3), ("g", "a.pdf", 4), ("f", "c", 5)], "folder string, name string, id int")
    taken = spark.createDataFrame([("f", "a.pdf"), ("f", "a_2024-01-02.pdf"), ("f", "c")], "folder string, name string")
    got = {r.id: r.stored_name for r in relational.dated_names(df, "folder", "name", taken, F.lit("2024-01-02").cast("date"), "id").collect()}
    assert got == {1: "a_2024-01-02 (2).pdf", 2: "a_2024-01-02 (3).pdf", 3: "b.pdf", 4: "a.pdf", 5: "c_2024-01-02"}


def test_every_row_of_a_long_roster_is_read(spark):
    df = spark.range(1200).select((F.col("id") % 2).alias("k"), F.col("id").alias("Emp ID"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("Full Name"))
    found = workbooks.roster(workbooks.read(workbooks.write_by(df, "k", "Emp ID").select(F.col("k").cast("string").alias("path"), "content")))
    assert {(r.path, r.badge, r.name) for r in found.collect()} == {(str(k % 2), str(k), f"n{k}") for k in range(1200)}


def test_workbooks_are_written_and_read_a_row_at_a_time():
    import tracemalloc

    raw = workbooks.written(([f"{r} of {k}" for k in range(20)] for r in range(3000)), ("FFFFFF00" for _ in range(3000)))
    tracemalloc.start()
    assert sum(len(v) for _, _, v, _ in workbooks.cells(raw)) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20, peak


def test_merged_cells_beyond_the_rows():
    raw = workbooks.written([["a", "b", "c"], ["c", "d"]])
    book = zipfile.ZipFile(io.BytesIO(raw))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in book.namelist():
            z.writestr(name, book.read(name).replace(b"</sheetData>", b'</sheetData><mergeCells><mergeCell ref="C1:C1"/><mergeCell ref="B2:C4"/></mergeCells>'))
    assert [r[1:3] for r in workbooks.cells(out.getvalue())] == [(1, ["a", "b", "c"]), (2, ["c", "d", "d"]), (3, [None, "d", "d"]), (4, [None, "d", "d"])]


def test_ranges_of_files_hold_every_message_once(tmp_path, monkeypatch):
    """A stream's tasks read bytes of files: each line by one of them, whatever the cuts, and no file is read whole."""
    import datetime
    import json

    from periodica.sources import mailbox

    at = lambda k: datetime.datetime(2024, 1, 1, 0, k % 60, k // 60, tzinfo=datetime.UTC)
    for n in range(2):
        lines = [json.dumps({"message_id": f"é{k:03d}", "received_at": at(k).isoformat(), "body": "x" * (k % 5)}) for k in range(n, 200, 2)]
        (tmp_path / f"{n}.json").write_text("\n".join(lines) + ("\n" if n else ""))
    monkeypatch.setattr(mailbox, "_sorted", None)
    store = mailbox.Folder(str(tmp_path))
    after, until = (at(59), "é059"), store.newest()
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(mailbox, "RANGE", size)
        got = [r[0] for s in store.splits(mailbox.BEGIN, until, 50, 500) for r in store.split(s, 50)]
        assert sorted(got) == [f"é{k:03d}" for k in range(200)]
    assert until == max((at(k), f"é{k:03d}") for k in range(200))
    assert {r[0] for s in store.splits(after, until, 50, 500) for r in store.split(s, 50)} == {f"é{k:03d}" for k in range(200) if (at(k), f"é{k:03d}") > after}


def test_a_few_mails_are_parsed_at_once(spark, monkeypatch):
    """No frame of a task has more mails than ``MAILS``, however many a batch brings; all are there."""
    import pandas as pd

    sizes = [len(f) for f in mail._few(iter([pd.DataFrame({"path": range(450)}), pd.DataFrame({"path": range(3)}), pd.DataFrame({"path": []})]))]
    assert sizes == [200, 200, 50, 3]
    raw = spark.range(450).coalesce(1).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("Subject: "), F.col("id").cast("string"), F.lit("\n\nx")).cast("binary").alias("content"))
    assert {(r.path, r.subject) for r in mail.messages(raw).select("path", "subject").collect()} == {(str(k), str(k)) for k in range(450)}
