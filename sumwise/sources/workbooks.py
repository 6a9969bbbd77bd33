"""Tables from spreadsheet workbooks (`.xlsx`): zip files with one XML part per sheet.

Files come through Spark's own file access, one row per file, and a task reads its files one
after the other; the rows of a sheet are parsed as a stream, a few at a time as a small tree.
Only the shared strings of one workbook are held.  A zip part cannot be split, so one workbook is
one task's work; a folder of them spreads over the cluster, in several tasks for each core, as
files of equal size, packed by size, differ in what they cost.

The first row of a sheet that holds anything names its columns.  A column without a name is
`Unnamed: i`, i counting from 0; names that repeat, whatever their case, or that are `file`,
`sheet` or `row`, get their position appended (`name__3`).  Cells are read as follows:

* numbers are whole or not by their value; under a date format they are moments, to the
  millisecond, in the workbook's date system; a time without a day is text; a span of time
  (`[h]:mm`) stays a number of days;
* formulas count by their stored value; errors (`#N/A`) and empty texts are NULL;
* texts are taken as they stand, with all their runs and without phonetic hints.

A column of one kind has its type (bigint, double, boolean, timestamp_ntz); whole and other
numbers together are double; any other mix is text.  Sheets are put together by column name.
Rows without cells are left out.  A sheet without cells has no columns.  A file that is damaged
or no workbook raises ValueError with its path; one of no bytes has no sheets, as Spark's file
access skips it.  Binary workbooks (`.xls`) are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from datetime import date, datetime, time, timedelta
from functools import lru_cache
from itertools import accumulate, islice
from typing import TypeVar
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import spread

KEYS = ("file", "sheet", "row")
TYPES = {"whole": "bigint", "number": "double", "boolean": "boolean", "moment": "timestamp_ntz", "text": "string"}
#: The numbers of the built-in formats that show dates and times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
#: What a number format shows as it is: quoted or escaped text, room for a sign, colours and conditions.
SHOWN = re.compile(r'"[^"]*"|[\\_*].|\[[^\]]*\]')
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
MOST_COLUMNS = 100_000
ROWS_A_BATCH = 2048
READ_BYTES = 1 << 16
DAY_MS = 86_400_000

Made = TypeVar("Made")
Cell = tuple[int, str, str]  # column, kind, value as text


@lru_cache(1 << 10)
def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def local(e: ElementTree.Element) -> str:
    return local_name(e.tag)


def shows_date(code: str) -> bool:
    return bool(set(SHOWN.sub("", code.split(";")[0]).lower()) & set("dmyhs"))


@lru_cache(1 << 12)
def column_index(ref: str) -> int:
    """The column of a reference, whose row may be left out."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


@lru_cache(1 << 13)
def moment(serial: float, from_1904: bool) -> tuple[str, str]:
    """Kind and text of a day number; the 1900 system counts a 29 February 1900 that never was."""
    days, ms = divmod(round(serial * DAY_MS), DAY_MS)
    at = timedelta(milliseconds=ms)
    if days == 0 and not from_1904:
        return "text", (datetime.min + at).time().isoformat()
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if days >= 60 else 31)
    try:
        return "moment", (start + timedelta(days=days) + at).isoformat(" ")
    except OverflowError:
        return "number", repr(serial)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


class Workbook:
    """One workbook: its sheets in their order, and the rows of each."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        (main,) = [p for kind, p in self.related("").values() if kind == "officeDocument"]
        parts = self.related(main)
        root = self.tree(main)
        self.from_1904 = any(e.get("date1904") in ("1", "true") for e in root.iter() if local(e) == "workbookPr")
        self.sheets: list[tuple[str, str]] = []
        for e in (e for e in root.iter() if local(e) == "sheet"):
            (of,) = [v for k, v in e.attrib.items() if k.endswith("}id")]
            if parts[of][0] == "worksheet":
                self.sheets.append((e.get("name"), parts[of][1]))
        by_kind = {kind: part for kind, part in parts.values()}
        self.dates = self.date_styles(by_kind.get("styles"))
        self.shared = [self.text_of(e) for e in self.tree(by_kind["sharedStrings"])] if "sharedStrings" in by_kind else []

    def tree(self, part: str) -> ElementTree.Element:
        with self.zip.open(part) as f:
            return ElementTree.parse(f).getroot()

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """Kind and path of every part that `part` refers to, by the id it uses."""
        folder, name = posixpath.split(part)
        path = posixpath.join(folder, "_rels", f"{name}.rels")
        if path not in self.names:
            return {}
        inside = [e for e in self.tree(path) if e.get("TargetMode") != "External"]
        return {
            e.get("Id"): (e.get("Type").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, e.get("Target")))[1:])
            for e in inside
        }

    def date_styles(self, part: str | None) -> list[bool]:
        """Whether a cell's style shows a date, by the number of the style."""
        if part is None:
            return []
        root = self.tree(part)
        own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if local(e) == "numFmt"}
        used = [int(e.get("numFmtId", 0)) for group in root if local(group) == "cellXfs" for e in group]
        return [shows_date(own[n]) if n in own else n in DATE_FORMATS for n in used]

    def text_of(self, e: ElementTree.Element) -> str:
        found = [t.text or "" for c in e for t in ([c] if local(c) == "t" else c if local(c) == "r" else []) if local(t) == "t"]
        return unescaped("".join(found))

    def read(self, c: ElementTree.Element, kind: str, value: str | None) -> tuple[str, str] | None:
        """Kind and text of a cell of the type `kind`, None for an empty one."""
        if kind == "inlineStr":
            text = "".join(self.text_of(e) for e in c if local(e) == "is")
            return ("text", text) if text else None
        if not value or kind == "e":
            return None
        if kind in ("s", "str"):
            text = self.shared[int(value)] if kind == "s" else unescaped(value)
            return ("text", text) if text else None
        if kind == "b":
            return "boolean", "true" if value.strip() == "1" else "false"
        if kind == "d":
            return "moment", datetime.fromisoformat(value).replace(tzinfo=None).isoformat(" ")
        return self.read_number(value, c.get("s"))

    def read_number(self, value: str, style: str | None) -> tuple[str, str]:
        n = float(value)
        if style and n >= 0 and int(style) < len(self.dates) and self.dates[int(style)]:
            return moment(n, self.from_1904)
        if n.is_integer() and abs(n) < 1 << 63:
            return "whole", str(int(value) if value.strip("-").isdigit() else int(n))
        return "number", repr(n)

    def rows(self, part: str) -> Iterator[tuple[int, list[Cell]]]:
        """Number (from 1) and filled cells of every row that has any."""
        number, cell, of_cell = 0, "", ""
        for e in self.row_elements(part):
            number = int(e.get("r", number + 1))
            cells, at = [], -1
            for c in e:
                if c.tag != cell:
                    if local(c) != "c":
                        continue
                    cell, of_cell = c.tag, c.tag[:-1] + "v"
                ref = c.get("r")
                at = column_index(ref.rstrip("0123456789")) if ref else at + 1
                value = c.findtext(of_cell)
                if value is None and len(c):
                    value = next((v.text for v in c if local(v) == "v"), None)
                kind = c.get("t", "n")
                found = self.read_number(value, c.get("s")) if kind == "n" and value else self.read(c, kind, value)
                if found:
                    cells.append((at, *found))
            if cells:
                yield number, cells

    def row_elements(self, part: str) -> Iterator[ElementTree.Element]:
        """The rows of a sheet; the tree grows by READ_BYTES, and rows that have ended are taken out of it."""
        builder = ElementTree.TreeBuilder()
        whole = builder.start("whole", {})  # opened here, so that what the parser adds can be seen
        parser = ElementTree.XMLParser(target=builder)
        with self.zip.open(part) as f:
            data, more = None, True
            while more:
                content = f.read(READ_BYTES)
                more = bool(content)
                parser.feed(content) if more else parser.close()
                if data is None:
                    data = next((e for sheet in whole for e in sheet if local(e) == "sheetData"), None)
                if data is not None:
                    ended = data[:-1] if more else data[:]
                    yield from (e for e in ended if local(e) == "row")
                    del data[: len(ended)]


def common_kind(kinds: Iterable[str]) -> str:
    found = set(kinds)
    if len(found) == 1:
        return found.pop()
    return "number" if found == {"whole", "number"} else "text"


DAMAGE = (
    zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError,
    KeyError, ValueError, IndexError, TypeError, AttributeError,
)


def checked(rows: Callable[[], Iterator[Made]], path: str) -> Iterator[Made]:
    try:
        yield from rows()
    except DAMAGE as e:
        raise ValueError(f"no readable workbook: {path}: {type(e).__name__} {e}") from e


class Sheet:
    """A sheet, the names of its columns, and its rows below the header."""

    def __init__(self, name: str, number: int, rows: Iterator[tuple[int, list[Cell]]]):
        self.name, self.number, self.rows = name, number, rows
        header = next(rows, (0, []))[1]
        seen = Counter([v.lower() for _, _, v in header] + list(KEYS))
        self.names = {i: v if seen[v.lower()] == 1 else f"{v}__{i}" for i, _, v in header}
        self.taken = {n.lower() for n in self.names.values()}
        self.keys: dict[int, str] = {}

    def column(self, at: int) -> str:
        """The name of a column; one that the header does not name is named when it first holds a cell."""
        if at not in self.names:
            name = f"Unnamed: {at}"
            self.names[at] = f"{name}__{at}" if name.lower() in self.taken else name
            self.taken.add(self.names[at].lower())
        return self.names[at]

    def key(self, at: int) -> str:
        """The name of a column in lower case."""
        if at not in self.keys:
            self.keys[at] = self.column(at).lower()
        return self.keys[at]


def sheets_in(batches: Iterator[pa.RecordBatch], sheet: str | int | None) -> Iterator[tuple[str, Sheet]]:
    """Path and every sheet asked for, of every workbook."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            book = next(checked(lambda: iter([Workbook(content.as_py() or b"")]), path))
            for number, (name, part) in enumerate(book.sheets):
                if sheet is None or sheet in (name, number):
                    yield path, Sheet(name, number, checked(lambda: book.rows(part), path))


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, content` of a workbook, or of all workbooks of a folder and its folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.lower().endswith(".xlsx"):
        reader = reader.option("pathGlobFilter", "*.xlsx")
    return reader.load(path).select("path", "content")


COLUMNS = "file string, sheet string, number int, position int, name string, key string, type string"


def workbook_columns(files: DataFrame, sheet: str | int | None = None) -> DataFrame:
    """COLUMNS: every column of every sheet, its name in lower case (`key`) and its type; `sheet` is a name or a number from 0."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, one in sheets_in(batches, sheet):
            kinds: dict[int, set[str]] = {i: set() for i in one.names}
            for _, cells in one.rows:
                for at, kind, _ in cells:
                    kinds.setdefault(at, set()).add(kind)
            named = [(at, one.column(at), TYPES[common_kind(kinds[at])] if kinds[at] else None) for at in sorted(kinds)]
            out = [dict(zip(COLUMNS_ARROW.names, (path, one.name, one.number, at, n, n.lower(), t))) for at, n, t in named]
            yield pa.RecordBatch.from_pylist(out, schema=COLUMNS_ARROW)

    return spread(files.select("path", "content"), "path").mapInArrow(described, COLUMNS)


COLUMNS_ARROW = pa.schema(
    [("file", pa.string()), ("sheet", pa.string()), ("number", pa.int32()), ("position", pa.int32()), ("name", pa.string()), ("key", pa.string()), ("type", pa.string())]
)
CELLS_ARROW = pa.schema(
    [("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string()))]
)


def common_schema(columns: DataFrame) -> T.StructType:
    """One field per column name of all sheets, in the order of their first places.

    Names and types are combined by Spark; one row per name reaches the driver, as a schema has
    to, and more than MOST_COLUMNS names raise ValueError.
    """
    one = (
        F.when(F.size("types") == 1, F.col("types")[0])
        .when((F.size("types") == 2) & F.forall("types", lambda t: t.isin("bigint", "double")), F.lit("double"))
        .otherwise(F.lit("string"))
    )
    by_name = columns.groupBy("key").agg(F.min(F.struct("position", "name")).alias("first"), F.collect_set("type").alias("types"))
    found = by_name.select("first.*", one.alias("type")).orderBy("position", "name").limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"the sheets have over {MOST_COLUMNS} different columns; name a sheet or give a schema")
    of = {t.simpleString(): t for t in (T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(), T.StringType())}
    return T.StructType([T.StructField(r["name"], of[r["type"]]) for r in found])


def read_workbooks(files: DataFrame, sheet: str | int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """`file, sheet, row` and the columns of all sheets of `files` (`path, content`), one row per row.

    `row` is the number shown in the sheet.  Without a `schema` the files are read once before to
    find names and types; with one they are read once, its columns are found by name in any
    case, and a cell that does not fit its type raises.  Parsing is repeated whenever the result
    is used, so write what is used often to Parquet.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = schema if schema is not None else common_schema(workbook_columns(files, sheet))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, one in sheets_in(batches, sheet):
            while rows := list(islice(one.rows, ROWS_A_BATCH)):
                ends = [0, *accumulate(len(cells) for _, cells in rows)]
                names = [one.key(at) for _, cells in rows for at, _, _ in cells]
                values = [value for _, cells in rows for _, _, value in cells]
                cells_of = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
                numbers = pa.array([number for number, _ in rows], pa.int32())
                of_file = [pa.array([text] * len(rows), pa.string()) for text in (path, one.name)]
                yield pa.RecordBatch.from_arrays([*of_file, numbers, cells_of], schema=CELLS_ARROW)

    rows = spread(files.select("path", "content"), "path").mapInArrow(parsed, "file string, sheet string, row int, cells map<string,string>")
    return rows.select(*KEYS, *[F.col("cells")[f.name.lower()].cast(f.dataType).alias(f.name) for f in fields])


def load_workbooks(spark: SparkSession, path: str, sheet: str | int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """`read_workbooks` of a file, or of all `.xlsx` files below a folder."""
    return read_workbooks(workbook_files(spark, path), sheet, schema)


def workbook_bytes(sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence]]]) -> bytes:
    """A workbook of the given sheets, each with its column names and rows of plain values."""
    shared: dict[str, int] = {}

    @lru_cache(1 << 13)
    def day_number(at: datetime) -> float:
        since = at - datetime(1899, 12, 30)
        return since.days + (since - timedelta(since.days)).total_seconds() / 86400

    def cell(v: object) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (date, datetime)):
            at = v if isinstance(v, datetime) else datetime.combine(v, time())
            return f'<c s="1"><v>{day_number(at if at.tzinfo is None else at.replace(tzinfo=None))!r}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="s"><v>{shared.setdefault(str(v), len(shared))}</v></c>'

    def kept(text: str) -> str:
        """Signs that XML cannot hold, and what looks like an escaped one, are escaped."""
        text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
        return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {}
    for k, (names, rows) in enumerate(sheets.values(), 1):
        lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [names, *rows])
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'
    texts = "".join(f'<si><t xml:space="preserve">{kept(t)}</t></si>' for t in shared)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">{texts}</sst>'
    parts["xl/styles.xml"] = (
        f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'
    )
    ends = {**{f"s{k}": ("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)},
            "strings": ("sharedStrings", "sharedStrings.xml"), "styles": ("styles", "styles.xml")}
    links = "".join(f'<Relationship Id="{i}" Type="{office}/{kind}" Target="{to}"/>' for i, (kind, to) in ends.items())
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{package}/relationships">{links}</Relationships>'
    first = f'<Relationship Id="main" Type="{office}/officeDocument" Target="xl/workbook.xml"/>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{package}/relationships">{first}</Relationships>'
    form = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    forms = {"workbook": "sheet.main", "sharedStrings": "sharedStrings", "styles": "styles"}
    over = {f"xl/{n}.xml": kind for n, kind in forms.items()} | {p: "worksheet" for p in parts if "/sheet" in p}
    typed = "".join(f'<Override PartName="/{p}" ContentType="{form}.{kind}+xml"/>' for p, kind in over.items())
    rels = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    parts["[Content_Types].xml"] = f'<Types xmlns="{package}/content-types">{rels}{typed}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()
