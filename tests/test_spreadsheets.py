"""Workbooks written by hand: header, gaps, shared and inline texts, rows without name, many files."""

import zipfile

import pytest

from quern.sources import spreadsheets as X

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {OFFICE}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(shared) + "</sst>")


LIST = (
    '<row r="1"><c r="A1" t="inlineStr"><is><t>idx</t></is></c><c r="B1" t="s"><v>0</v></c></row>'
    '<row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> use </t></is></c><c r="F2" t="s"><v>2</v></c></row>'
    '<row r="3"><c r="A3"><v>8</v></c><c r="B3" t="inlineStr"><is><t>  </t></is></c></row>'
    '<row r="5"><c t="e"><v>#N/A</v></c><c t="str"><v>乙</v></c><c t="b"><v>1</v></c><c r="AB5"><v>1.5</v></c></row><row r="6"/>'
)
SHARED = ["<si><t>name</t></si>", "<si><r><t>甲</t></r><r><t xml:space='preserve'> x</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si>", "<si><t>kind</t></si>"]


def test_additives(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"other": '<row r="2"><c r="B2"><v>1</v></c></row>', "list": LIST}, SHARED)
    got = [tuple(r) for r in X.additives(spark, str(tmp_path / "a.xlsx"), "list").orderBy("name_zh").collect()]
    assert got == [(None, "乙", "TRUE", None, None, None), ("TFDA-7", "甲 x", None, ["kind"], "use", None)]
    cells = {(r.sheet, r.row): r.cells for r in X.spreadsheet_cells(spark, str(tmp_path / "a.xlsx")).collect()}
    assert cells["list", 5] == {"B": "乙", "C": "TRUE", "AB": "1.5"} and ("list", 6) not in cells and cells["other", 2] == {"B": "1"}


def test_many_files(spark, tmp_path):
    rows = "".join(f'<row><c><v>{i}</v></c><c t="inlineStr"><is><t>n{i}</t></is></c></row>' for i in range(X.BATCH + 3))
    for i in range(3):
        workbook(tmp_path / f"{i}.xlsx", {"s": rows})
    workbook(tmp_path / "empty.xlsx", {"s": ""})
    assert X.spreadsheet(spark, str(tmp_path), "s", ["i", "name"], "name", first_row=1).count() == 3 * (X.BATCH + 3)
    assert X.spreadsheet(spark, str(tmp_path), "none", ["i"], "i").count() == 0


def test_letters():
    assert [X.letters_of(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(X.number_of(X.letters_of(n)) == n for n in range(1, 2000))


def test_no_workbook(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("x")
    with pytest.raises(Exception, match="BadZipFile"):
        X.spreadsheet_cells(spark, str(tmp_path / "x.xlsx")).count()
