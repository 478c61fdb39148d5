"""Workbooks: the rows of their sheets, rosters under either header, and a writer for grids."""

from __future__ import annotations

import functools
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row int, cells array<string>, fills array<string>"
CELL_TYPES = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]

# Columns of a roster and the headers that name them.
HEADERS = {
    "badge": ("emp id", "employee id"), "name": ("employees name", "full name"), "dco": ("dco",), "project": ("project",),
    "manager": ("account managers name", "salesman"), "contact": ("contact no.", "mobile number"), "address": ("email", "email id"),
}

# The columns of a month's report in order, what a person's state is called, and the colours of the states that need attention.
PERSON = {
    "employee_id": "Employee ID", "employee_name": "Employee Name", "dco_number": "DCO Number", "account_manager": "Account Manager",
    "location": "Location", "project": "Project", "employee_email": "Email", "contact_no": "Contact",
}
STATE = {
    "status": "Status", "month_label": "Month", "year": "Year", "validation_status": "Validation", "approval_status": "Approval",
    "source_file_count": "Source Files",
}
LISTS = {
    "annual": ("Annual Leave Count", "Annual Leave Dates"), "remote": ("Remote / WFH Count", "Remote / WFH Dates"), "sick": ("Sick Leave Count", "Sick Leave Dates"),
    "maternity": ("Maternity Leave Count", "Maternity Leave Dates"), "unpaid": ("Unpaid Leave Count", "Unpaid Leave Dates"), "absent": ("Absent Count", "Absent Dates"),
    "public_holiday": ("Public Holiday Count", "Public Holiday Dates"), "other": ("Other Leave Count", "Other Leave Dates"),
    "working": ("Working Days Count", "Working Dates"), "weekend": ("Weekend Days Count", "Weekend Dates"),
}
STORED, NOT_STORED, NOT_RECEIVED = "Received & Stored", "Received & Not Stored", "Not Received"
FILLS = {NOT_RECEIVED: "FFC7CE", NOT_STORED: "FFEB9C"}
FONTS = {NOT_RECEIVED: "9C0006", NOT_STORED: "9C6500"}
HEAD_STYLE = ("1E3A5F", "FFFFFF", "head")
#: Rows that a sheet has room for, the header not counted, and columns.
MOST_ROWS, MOST_COLUMNS = (1 << 20) - 1, 1 << 14
#: Rows that are values of Python at once.
PER_BATCH = 1000


@functools.lru_cache(MOST_COLUMNS)
def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    return int(ref[len(letters) :]), _column(letters)


def _merged(sheet) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """First and last place of the merged ranges of a sheet, which stand behind its rows."""
    tail, chunk = b"", sheet.read(1 << 20)
    while chunk and b"mergeCell" not in tail + chunk:
        tail, chunk = chunk[-16:], sheet.read(1 << 20)
    if not chunk:
        return []
    sheet.seek(0)
    found = []
    for _, e in ElementTree.iterparse(sheet):
        if e.tag == _NS + "mergeCell":
            a, b = (e.get("ref").split(":") * 2)[:2]
            found.append((_place(a), _place(b)))
        if e.tag in (_NS + "row", _NS + "mergeCell"):
            e.clear()
    return found


def _rows(sheet, shared: list[str], colours: list[str | None], columns: int):
    """(row, cells by column) of a sheet, a row at a time."""
    rows = None
    for event, e in ElementTree.iterparse(sheet, ("start", "end")):
        if event == "start":
            rows = e if e.tag == _NS + "sheetData" else rows
        elif e.tag == _NS + "row":
            grid: dict[int, dict[int, tuple]] = {}
            for c in e.iter(_NS + "c"):
                r, k = _place(c.get("r"))
                if k < columns:
                    kind, style = c.get("t"), int(c.get("s", 0))
                    if kind == "inlineStr":
                        text = "".join([t.text or "" for t in c.iter(_NS + "t")])
                    else:
                        text = c.findtext(_NS + "v") or None
                    grid.setdefault(r, {})[k] = (shared[int(text)] if kind == "s" and text is not None else text, colours[style] if style < len(colours) else None)
            yield from grid.items()
            rows.clear()


def _filled(rows, merged: list, most: int, columns: int):
    """``rows`` with merged ranges filled from their first cell."""
    waiting, firsts, at = sorted(merged), {}, 0
    last = max((min(b[0], most) for _, b in merged), default=0)

    def fill(r: int, row: dict) -> dict:
        for m in [m for m in firsts if m[1][0] < r]:
            del firsts[m]
        while waiting and waiting[0][0][0] <= r:
            a, b = waiting.pop(0)
            firsts[a, b] = row.get(a[1], (None, None)) if a[0] == r else (None, None)
        for ((_, c0), (_, c1)), first in firsts.items():
            for k in range(c0, min(c1, columns - 1) + 1):
                row[k] = first
        return row

    for r, row in rows:
        for gap in range(at + 1, min(r, last + 1)):
            yield gap, fill(gap, {})
        at = r
        yield r, fill(r, row)
    for gap in range(at + 1, last + 1):
        yield gap, fill(gap, {})


def cells(raw: bytes, rows: int = MOST_ROWS + 1, columns: int = MOST_COLUMNS):
    """(sheet, row, values, fills) of a workbook, a row at a time, merged ranges filled from their first cell; what is no workbook has none."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(_NS + "t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    colours = [None]
    if "xl/styles.xml" in names:
        style = ElementTree.fromstring(book.read("xl/styles.xml"))
        fills = [(f.find(f".//{_NS}fgColor").get("rgb") if f.find(f".//{_NS}fgColor") is not None else None) for f in style.iter(_NS + "fill")]
        formats = style.find(_NS + "cellXfs")
        colours = [fills[int(x.get("fillId", 0))] for x in formats] if formats is not None and fills else [None]
    for sheet in root.iter(_NS + "sheet"):
        target = links[sheet.get(_REL)].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        with book.open(target) as f:
            merged = _merged(f)
        with book.open(target) as f:
            for r, row in _filled(_rows(f, shared, colours, columns), merged, rows, columns):
                if r > rows:
                    break
                if row:
                    width = max(row) + 1
                    yield sheet.get("name"), r, [row.get(k, (None,))[0] for k in range(width)], [row.get(k, (None, None))[1] for k in range(width)]


def read(files: DataFrame, rows: int = MOST_ROWS + 1, columns: int = MOST_COLUMNS) -> DataFrame:
    """One row per row of every sheet of the files (path, content): values and fill colours as lists."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                found = ((path.as_py(), *x) for x in cells(raw.as_py() or b"", rows, columns))
                while some := list(itertools.islice(found, PER_BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), CELL_TYPES)], names=["path", "sheet", "row", "cells", "fills"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, CELLS)


def as_text(rows: DataFrame) -> DataFrame:
    """path and the text of its workbook: a line a row, cells between bars, the fill where there is one."""
    said = F.array_join(F.transform(F.arrays_zip("cells", "fills"), lambda x: F.concat(F.coalesce(x["cells"], F.lit("")), F.coalesce(F.concat(F.lit(" ["), x["fills"], F.lit("]")), F.lit("")))), " | ")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("sheet", "row", said.alias("t")))), lambda x: x["t"])
    return rows.groupBy("path").agg(F.array_join(lines, "\n").alias("text"))


def roster(rows: DataFrame) -> DataFrame:
    """path, sheet, row and the roster's columns: below the first row of a sheet that names a person's id and name."""
    low = F.transform("cells", lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    at = {n: F.coalesce(*(F.nullif(F.array_position(low, h), F.lit(0).cast("long")) for h in names)) for n, names in HEADERS.items()}
    heads = rows.select("path", "sheet", F.col("row").alias("head"), *(c.alias(f"at_{n}") for n, c in at.items())).where("at_badge is not null and at_name is not null")
    first = Window.partitionBy("path", "sheet").orderBy("head")
    heads = heads.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    below = rows.join(heads, ["path", "sheet"]).where(F.col("row") > F.col("head"))
    value = lambda n: F.nullif(F.trim(F.try_element_at("cells", F.col(f"at_{n}").cast("int"))), F.lit(""))
    found = below.select("path", "sheet", "row", *(value(n).alias(n) for n in HEADERS))
    return found.where("badge is not null or name is not null").withColumn("badge", F.regexp_replace("badge", r"^(\d+)\.0$", "$1"))


def written(grid: Iterable[list], fills: Iterable[str | None] | None = None, sheet: str = "Sheet1", fonts: Iterable[str | None] | None = None, wrap_from: int | None = None, head: bool = False) -> bytes:
    """A workbook of one sheet: text and numbers, a fill and a font colour by row, widths after the first fifty rows.

    Columns from ``wrap_from`` wrap their text; ``head`` makes the first row a header that stays in view. Rows are taken one at a time.
    """
    none = itertools.repeat(None)
    rows = zip(grid, none if fills is None else fills, none if fonts is None else fonts)
    first = list(itertools.islice(rows, 51 if head else 50))
    across = range(max((len(x) for x, _, _ in first), default=0))
    longest = [max((len(str(x[k])) for x, _, _ in first if k < len(x) and x[k] is not None), default=8) + 2 for k in across]
    widths = [max(10, min(44, w)) if head else min(w, 60) for w in longest]
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    name = functools.cache(lambda k: (name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26))
    styles = {(None, None, False): 0}
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if head else ""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def line(r: int, row: list, fill: str | None, font: str | None) -> str:
        cells_ = []
        for k, v in enumerate(row):
            if v is not None and v == v:  # NaN is no value
                style = HEAD_STYLE if head and r == 1 else (fill, font, wrap_from is not None and k >= wrap_from)
                n = styles.setdefault(style, len(styles))
                at = f'<c r="{name(k)}{r}"' + (f' s="{n}"' if n else "")
                number = isinstance(v, (int, float)) and not isinstance(v, bool)
                cells_.append(f"{at}><v>{v}</v></c>" if number else f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        return f'<row r="{r}"{" ht=\"28\" customHeight=\"1\"" if head and r == 1 else ""}>{"".join(cells_)}</row>'

    out = io.BytesIO()
    opening = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'{opening}<worksheet {space}>{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
            for r, x in enumerate(itertools.chain(first, rows), 1):
                f.write(line(r, *x).encode())
            f.write(b"</sheetData></worksheet>")
        colours, inks = sorted({f for f, *_ in styles if f}), sorted({c for _, c, _ in styles if c})
        fill_xml = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in colours)
        font_xml = "".join(f'<font>{"<b/>" if head and c == HEAD_STYLE[1] else ""}<color rgb="{c}"/></font>' for c in inks)
        align = {False: "", True: '<alignment vertical="top" wrapText="1"/>', "head": '<alignment horizontal="center" vertical="center" wrapText="1"/>'}
        place = lambda among, c, first: among.index(c) + first if c else 0
        formats = "".join(f'<xf numFmtId="0" fontId="{place(inks, c, 1)}" fillId="{place(colours, f, 2)}" borderId="0" applyFill="1" applyFont="1" applyAlignment="1">{align[w]}</xf>' for f, c, w in styles)
        files = {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook {space} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {space}><fonts count="{len(inks) + 1}"><font/>{font_xml}</fonts><fills count="{len(colours) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill_xml}</fills><borders count="1"><border/></borders><cellXfs count="{len(styles)}">{formats}</cellXfs></styleSheet>',
        }
        for path, text in files.items():
            z.writestr(path, opening + text)
    return out.getvalue()


def _books(rows: DataFrame, keys: list[str], order: str, columns: list[str], schema: str, book: Callable[[dict, Iterable[dict]], bytes]) -> DataFrame:
    """``keys`` and ``content``: a workbook for each of ``keys``, whose rows ``book`` takes one at a time, in ``order``."""
    placed = rows.select(*keys, order, *(c for c in columns if c not in (*keys, order))).repartition(*keys).sortWithinPartitions(*keys, order)
    names = [*keys, "content"]

    def run(batches):
        # a few rows at a time become values
        lines = (r for b in batches for k in range(0, b.num_rows, PER_BATCH) for r in b.slice(k, PER_BATCH).to_pylist())
        for key, of in itertools.groupby(lines, lambda r: tuple(r[k] for k in keys)):
            content = book(dict(zip(keys, key)), of)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, content), kinds)], names=names)

    kinds = [field.type for field in to_arrow_schema(placed.select(*keys).schema)] + [pa.binary()]
    return placed.mapInArrow(run, schema)


def write_by(df: DataFrame, key: str, order: str, fill: str | None = None) -> DataFrame:
    """key and ``content``: a workbook for each key, its rows in ``order`` under a header, filled by the column ``fill``."""
    columns = [c for c in df.columns if c not in (key, fill)]

    def book(of: dict, rows: Iterable[dict]) -> bytes:
        mine, theirs = itertools.tee(rows)  # read in step: nothing is held
        return written(itertools.chain([columns], ([r[c] for c in columns] for r in mine)), itertools.chain([None], (r[fill] if fill else None for r in theirs)))

    return _books(df, [key], order, [*columns, *([fill] if fill else [])], f"{key} {dict(df.dtypes)[key]}, content binary", book)


def month_report(people: DataFrame, records: DataFrame, received: DataFrame) -> DataFrame:
    """The 34 columns of a month's report for every person and period of ``people``, with ``period`` and ``pk``.

    ``people`` has year, month, pk and the columns of ``PERSON``; ``records`` year, month, pk, the lists of ``LISTS``, validation_status,
    approval_status and source_file_count, and of a person the columns that it knows; ``received`` year, month and pk of what was sent.
    A person with a record has its values for id, name, reference and manager; without one the counts are 0 and the lists empty.
    """
    keys = ["year", "month", "pk"]
    own = [c for c in ("employee_id", "employee_name", "dco_number", "account_manager") if c in records.columns]
    filed = records.select(*keys, F.struct(*own, *LISTS, "validation_status", "approval_status", "source_file_count").alias("r"))
    sent = received.select(*keys).distinct().withColumn("_sent", F.lit(True))
    rows = people.join(filed, keys, "left").join(sent, keys, "left")
    has = F.col("r").isNotNull()
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    person = {n: said(F.when(has, F.col(f"r.{n}")).otherwise(F.col(n)) if n in own else F.col(n)) for n in PERSON}
    first = F.make_date("year", "month", F.lit(1))
    state = {
        "status": F.when(has, STORED).when(F.col("_sent"), NOT_STORED).otherwise(NOT_RECEIVED), "month_label": F.date_format(first, "MMMM"), "year": F.col("year"),
        "validation_status": said(F.col("r.validation_status")), "approval_status": said(F.col("r.approval_status")), "source_file_count": F.coalesce("r.source_file_count", F.lit(0)),
    }
    listed = {n: F.sort_array(F.coalesce(f"r.{n}", F.array().cast("array<string>"))) for n in LISTS}
    named = [c.alias(PERSON[n]) for n, c in person.items()] + [c.alias(STATE[n]) for n, c in state.items()]
    named += [F.size(c).alias(LISTS[n][0]) for n, c in listed.items()] + [F.array_join(c, ", ").alias(LISTS[n][1]) for n, c in listed.items()]
    return rows.select(F.date_format(first, "MMM yyyy").alias("period"), "pk", *named)


def write_reports(report: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """period, book and ``content``: the report of a period as a workbook, more than one where a sheet has no room for all rows."""
    columns = [*PERSON.values(), *STATE.values(), *(c for c, _ in LISTS.values()), *(d for _, d in LISTS.values())]
    by_name = Window.partitionBy("period").orderBy(F.lower(PERSON["employee_name"]), "pk")
    numbered = report.withColumn("_n", F.row_number().over(by_name)).withColumn("book", F.floor((F.col("_n") - 1) / most))

    def book(of: dict, rows: Iterable[dict]) -> bytes:
        values, fills, fonts = itertools.tee(rows, 3)  # read in step: nothing is held
        status = STATE["status"]
        return written(
            itertools.chain([columns], ([r[c] for c in columns] for r in values)), itertools.chain([None], (FILLS.get(r[status]) for r in fills)), of["period"][:31],
            itertools.chain([None], (FONTS.get(r[status]) for r in fonts)), len(columns) - len(LISTS), head=True,
        )

    return _books(numbered, ["period", "book"], "_n", columns, "period string, book long, content binary", book)
