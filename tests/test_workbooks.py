"""Workbooks: what cells mean, several files and sheets as one table, damage."""

import io
import sys
import zipfile
from datetime import date, datetime

import pytest

from sumwise.sources.tables import load_table
from sumwise.sources.workbooks import READ_BYTES, Workbook, load_workbooks, moment, shows_date, workbook_bytes, workbook_columns, workbook_files

DAY = datetime(2024, 2, 29, 13, 30, 15)
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def put(folder, name, sheets):
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(workbook_bytes(sheets))
    return str(path)


def changed(content, part, edit):
    """The workbook with one part edited."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, edit(old.read(n).decode()) if n == part else old.read(n))
    return out.getvalue()


def test_types_of_columns(spark, tmp_path):
    names = ["n", "x", "flag", "at", "text", "mixed", "empty"]
    rows = [(1, 1.5, True, DAY, " a & <b>\x01_x0041_\n", 7, None), (-(10**15), 2, False, date(1900, 3, 1), "é漢🙂", "x", None), (None, None, None, None, None, True, "")]
    path = put(tmp_path, "a.xlsx", {"S 1": (names, rows)})
    df = load_table(spark, path)
    assert df.dtypes == list(zip(names, ["bigint", "double", "boolean", "timestamp_ntz", "string", "string", "string"]))
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, DAY, " a & <b>\x01_x0041_\n", "7", None),
        (-(10**15), 2.0, False, datetime(1900, 3, 1), "é漢🙂", "x", None),
        (None, None, None, None, None, "true", None),
    ]


def test_many_files_and_sheets_are_one_table(spark, tmp_path):
    for k in range(200):
        sheets = {"one": (["id", "Amount"], [(k, 2)]), "two": (["amount", "id", "note"], [(0.5, k, f"n{k}")])}
        put(tmp_path / f"f{k % 3}", f"b{k}.xlsx", sheets)
    (tmp_path / "notes.txt").write_text("no workbook")
    df = load_workbooks(spark, str(tmp_path))
    assert df.columns == ["file", "sheet", "row", "amount", "id", "note"]
    got = sorted((r.id, r.sheet, r.row, r.amount, r.note, r.file.rsplit("/", 1)[1]) for r in df.collect())
    assert got == sorted(x for k in range(200) for x in [(k, "one", 2, 2.0, None, f"b{k}.xlsx"), (k, "two", 2, 0.5, f"n{k}", f"b{k}.xlsx")])
    assert load_workbooks(spark, str(tmp_path), "two").count() == load_workbooks(spark, str(tmp_path), 1).count() == 200
    assert load_table(spark, str(tmp_path), format="xlsx").columns == ["id", "Amount"]
    given = load_workbooks(spark, str(tmp_path), schema="AMOUNT decimal(5,1), absent string")
    assert given.select("AMOUNT").distinct().count() == 2 and given.where("absent is not null").count() == 0


def test_names_that_repeat_or_clash(spark, tmp_path):
    path = put(tmp_path, "a.xlsx", {"s": (["a", "A", "row", None, "b.c`d", "Unnamed: 6", "z"], [(1, 2, 3, 4, 5, None, None, 8), (None,) * 9, (1,) * 8])})
    df = load_workbooks(spark, path)
    assert df.columns[3:] == ["a__0", "A__1", "row__2", "Unnamed: 3", "b.c`d", "Unnamed: 6", "z", "Unnamed: 7"]
    assert [tuple(r)[2:] for r in df.collect()] == [(2, 1, 2, 3, 4, 5, None, None, 8), (4, *[1] * 8)]


def test_first_filled_row_is_the_header_and_empty_sheets(spark, tmp_path):
    path = put(tmp_path, "a.xlsx", {"none": ([], []), "late": ([None], [(None,), (None, "x"), (None, 5)])})
    assert [(r["row"], r["x"]) for r in load_workbooks(spark, path).collect()] == [(4, 5)]
    none = load_workbooks(spark, path, "none")
    assert none.columns == ["file", "sheet", "row"] and none.count() == 0
    only = workbook_columns(workbook_files(spark, put(tmp_path, "b.xlsx", {"s": (["a"], [])})))
    assert [(r.name, r.position, r.type) for r in only.collect()] == [("a", 0, None)]


CELLS = {
    '<c t="inlineStr"><is><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="1"><t>no</t></rPh></is></c>': "two runs",
    '<c t="str"><f>A1&amp;B1</f><v>made</v></c>': "made",
    '<c t="e"><v>#N/A</v></c>': None,
    '<c t="b"><v>1</v></c>': "true",
    '<c><f>1+1</f><v>2</v></c>': "2",
    '<c><v>1E+3</v></c>': "1000",
    '<c t="d"><v>2024-01-05T10:00:00</v></c>': "2024-01-05 10:00:00",
    '<c s="1"><v>0.25</v></c>': "06:00:00",
    '<c s="1"><v>45292</v></c>': "2024-01-01 00:00:00",
    '<c s="1"><v>-1</v></c>': "-1",
    '<c r="A1"/>': None,
}


def test_cells_of_every_kind(spark, tmp_path):
    lines = "".join(f'<row r="{2 * k}">{c}</row>' for k, c in enumerate(CELLS, 2))
    sheet = f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData><row xmlns="{MAIN}"><c t="inlineStr"><is><t>v</t></is></c></row>'
    sheet += lines.replace("<row", f'<row xmlns="{MAIN}"') + "</x:sheetData></x:worksheet>"
    content = changed(workbook_bytes({"s": (["v"], [])}), "xl/worksheets/sheet1.xml", lambda _: sheet)
    (tmp_path / "a.xlsx").write_bytes(content)
    got = {r["row"]: r["v"] for r in load_workbooks(spark, str(tmp_path / "a.xlsx")).collect()}
    assert got == {2 * k: v for k, v in enumerate(CELLS.values(), 2) if v is not None}


def test_days():
    assert moment(1, False) == ("moment", "1900-01-01 00:00:00")
    assert moment(59, False)[1].startswith("1900-02-28") and moment(61, False)[1].startswith("1900-03-01")
    assert moment(0, True) == ("moment", "1904-01-01 00:00:00")
    assert moment(45351.999999999, False)[1] == "2024-03-01 00:00:00"
    assert moment(1e12, False)[0] == "number"
    assert all(map(shows_date, ["yyyy-mm-dd", "[$-409]d mmm yy;@", "h:mm AM/PM", "mm:ss.0"]))
    assert not any(map(shows_date, ["General", "0.00E+00", '#,##0 "days"', "[Red]0", "[h]", r"0\d", "@", "0_d", '0;"y"']))


def test_other_date_system(spark, tmp_path):
    content = workbook_bytes({"s": (["at"], [(DAY,)])})
    content = changed(content, "xl/workbook.xml", lambda t: t.replace("<sheets>", '<workbookPr date1904="1"/><sheets>'))
    (tmp_path / "a.xlsx").write_bytes(content)
    assert (load_table(spark, str(tmp_path / "a.xlsx")).first().at - DAY).days == 1462


def cut(content):
    return content[: len(content) // 2]


@pytest.mark.parametrize("damage", [cut, lambda c: b"plain text", lambda c: changed(c, "xl/worksheets/sheet1.xml", cut), lambda c: changed(c, "xl/workbook.xml", cut), lambda c: changed(c, "xl/sharedStrings.xml", lambda t: t.replace("<si><t xml:space=\"preserve\">a</t></si>", ""))])
def test_damage_raises_with_the_path(spark, tmp_path, damage):
    (tmp_path / "broken.xlsx").write_bytes(damage(workbook_bytes({"s": (["a"], [(i, "t") for i in range(50)])})))
    with pytest.raises(Exception, match="no readable workbook.*broken.xlsx"):
        load_table(spark, str(tmp_path / "broken.xlsx")).count()


def test_a_file_of_no_bytes_has_no_sheets(spark, tmp_path):
    put(tmp_path, "a.xlsx", {"s": (["x"], [(1,)])})
    (tmp_path / "b.xlsx").write_bytes(b"")
    assert [r.x for r in load_workbooks(spark, str(tmp_path)).collect()] == [1]


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(b"x")
    with pytest.raises(ValueError, match="extension"):
        load_table(spark, str(tmp_path / "a.xls"))
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "none.xlsx"))


def test_rows_longer_than_one_reading():
    rows = [(k, k / 8, f"t{k} & <é>", DAY, None, k % 2 == 0, "x" * (k % 97)) for k in range(6000)]
    rows[3000] = (*rows[3000][:-1], "y" * 3 * READ_BYTES)
    book = Workbook(workbook_bytes({"s": (list("abcdefg"), rows)}))
    assert len(book.zip.read("xl/worksheets/sheet1.xml")) > 10 * READ_BYTES
    got = {number: cells for number, cells in book.rows(book.sheets[0][1])}
    assert list(got) == list(range(1, 6002)) and got[1] == [(i, "text", c) for i, c in enumerate("abcdefg")]
    at = ("moment", DAY.isoformat(" "))
    for k, row in enumerate(rows):
        number = ("whole", str(k // 8)) if k % 8 == 0 else ("number", repr(k / 8))
        cells = [(0, "whole", str(k)), (1, *number), (2, "text", row[2]), (3, *at), (5, "boolean", str(row[5]).lower())]
        assert got[k + 2] == cells + [(6, "text", row[6])] * (row[6] != "")


def test_a_long_row_inside_the_sheet_and_cells_of_another_namespace(spark, tmp_path):
    cells = '<c t="inlineStr"><is><t>%s</t></is></c>' % ("z" * 3 * READ_BYTES)
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData><row r="3"><c><v>1</v></c></row><row r="9">{cells}<c><y:v xmlns:y="y">7</y:v></c></row></sheetData>'
    sheet += "<rowBreaks/></worksheet>"
    content = changed(workbook_bytes({"s": (["v"], [])}), "xl/worksheets/sheet1.xml", lambda _: sheet)
    book = Workbook(content)
    assert list(book.rows(book.sheets[0][1])) == [(3, [(0, "whole", "1")]), (9, [(0, "text", "z" * 3 * READ_BYTES), (1, "whole", "7")])]


def test_a_cell_costs_few_calls():
    """What Python does for each cell is most of the time of a large folder."""
    book = Workbook(workbook_bytes({"s": (list("abcde"), [(k, k / 8, f"t{k % 5}", DAY, True) for k in range(2000)])}))
    calls = 0

    def counted(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(counted)
    try:
        rows = sum(1 for _ in book.rows(book.sheets[0][1]))
    finally:
        sys.setprofile(None)
    assert rows == 2001 and calls < 2.5 * 5 * rows


def test_many_small_files_are_several_tasks_a_core(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"b{k}.xlsx", {"s": (["x"], [(k,)])})
    cores = spark.sparkContext.defaultParallelism
    df = load_workbooks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 2 * cores and sorted(r.x for r in df.collect()) == [0, 1, 2]
