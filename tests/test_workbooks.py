import datetime as dt
import zipfile

from pyspark.sql import functions as F

from sheetwright.operators import extract
from sheetwright.plans.template import load, template
from sheetwright.sources import sinks, workbooks
from sheetwright.streaming import ingest

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write(path, version, name, readings):
    cells = "".join(f'<row r="{k + 2}"><c r="C{k + 2}"><v>{v}</v></c></row>' for k, v in enumerate(readings))
    sheet = f"""<worksheet {NS}><cols><col min="6" max="6" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45306.4375</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c><c r="F1" t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c></row>
    {cells}<row r="90"><c r="A90" t="str"><f>A1</f><v></v></c><c r="B90" s="2"><f>1+1</f><v>2</v></c><c r="C90"><f>1</f></c></row></sheetData><mergeCells><mergeCell ref="A90:B91"/></mergeCells><headerFooter><oddHeader>&amp;L{name}&amp;R&amp;"Arial,Bold"v&amp;&amp;v</oddHeader></headerFooter></worksheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Main" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>{version}</t><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="0" fontId="1"/></cellXfs></styleSheet>')


T = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {"v1": {"fields": {"who": {"cell": "header:left"}, "at": {"cell": "B1", "type": "datetime"}, "xs": {"range": "C2:C", "type": "list[float]"}}}}})


def test_read_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "a.xlsx", "v1", "Ann", [1.5, 2])
    write(tmp_path / "sub" / "b.XLSX", "v9", "Bob", [3])
    write(tmp_path / "~$a.xlsx", "v1", "tmp", [])
    (tmp_path / "c.xls").write_bytes(b"old")
    (tmp_path / "d.xlsm").write_bytes(b"broken")
    (tmp_path / "e.txt").write_text("no")
    assert workbooks.list_workbooks(spark, str(tmp_path)).count() == 4
    assert workbooks.list_workbooks(spark, str(tmp_path), ["a*"]).count() == 1
    assert workbooks.list_workbooks(spark, str(tmp_path), ["sub/*"], str(tmp_path)).count() == 1
    books, bad = workbooks.read_workbooks(spark, str(tmp_path))
    assert {(r.path.rpartition("/")[2], r.error_kind) for r in bad.collect()} == {("c.xls", "unsupported_format"), ("d.xlsm", "unreadable")}
    cells = {(r.row, r.col): r for r in books.cells.filter("doc_id LIKE '%a.xlsx'").collect()}
    assert cells[1, 1].text == "v1" and cells[1, 2].ts == dt.datetime(2024, 1, 15, 10, 30) and cells[1, 4].bool and cells[1, 5].kind == "e" and cells[1, 6].text == "rich" and cells[1, 6].hidden_col
    assert (cells[2, 3].kind, cells[2, 3].text, cells[3, 3].kind, cells[3, 3].text) == ("f", "1.5", "i", "2") and cells[90, 2].emphasized and cells[90, 1].text == "" and cells[90, 3].text == "=1"
    assert {(r.section, r.text) for r in books.edges.filter("doc_id LIKE '%a.xlsx'").collect()} == {("left", "Ann"), ("right", "v&v")}
    assert [(r.top, r.left, r.bottom, r.right) for r in books.merges.filter("doc_id LIKE '%a.xlsx'").collect()] == [(90, 1, 91, 2)]
    e = extract.extract(books, [T])
    r = e.records("t", "v1").filter("doc_id LIKE '%a.xlsx'").first()
    assert (r.who, r.at, r.xs) == ("Ann", dt.datetime(2024, 1, 15, 10, 30), [1.5, 2.0])
    seen = sinks.with_provenance(e.records("t", "v1"), e.resolved, books.docs).filter("doc_id LIKE '%a.xlsx'").first()
    assert (seen._source_file, seen._discriminator_cell) == ("a.xlsx", "A1")
    out = str(tmp_path / "out.json")
    sinks.write_json(e.records("t", "v1"), e.failures(), books.docs, out, ordered=True)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert any('"who":"Ann"' in x for x in lines) and len(lines) == 2
    failed = spark.createDataFrame([(books.docs.first().doc_id, "k", "no version")], "doc_id string, error_kind string, message string")
    assert '"error":"no version"' in sinks.json_lines(e.records("t", "v1").limit(0), failed, books.docs).first().value
    sinks.write_records(e.records("t", "v1"), "t", "v1", str(tmp_path / "records"))
    assert spark.read.parquet(str(tmp_path / "records")).filter("schema = 't' AND version = 'v1'").count() == 2


def test_csv(spark, tmp_path):
    flat = spark.createDataFrame([("d", "a", 'x"y'), ("d", "b", None)], "doc_id string, path string, value string")
    sinks.write_csv(flat, ["a", "b"], str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()][1:] == ['"d","x""y",""']


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    (tmp_path / "src").mkdir()
    write(tmp_path / "src" / "a.xlsx", "v1", "Ann", [1, 2])
    ingest.ingest(spark, src, [T], out, seen)
    write(tmp_path / "src" / "b.xlsx", "v1", "Bob", [3])
    ingest.ingest(spark, src, [T], out, seen)
    ingest.ingest(spark, src, [T], out, seen)
    got = ingest.results(spark, out, "values").filter("field = 'xs'").select(F.regexp_extract("doc_id", "[^/]+$", 0).alias("f"), "num").collect()
    assert sorted(map(tuple, got)) == [("a.xlsx", 1.0), ("a.xlsx", 2.0), ("b.xlsx", 3.0)]


def test_captures_replace(spark, tmp_path):
    store = str(tmp_path / "store")
    make = lambda at, *xs: spark.createDataFrame([("t", "v1", at, x) for x in xs], "schema string, version string, captured_at long, field string")
    ingest.upsert_captures(spark, store, make(1, "a", "b"))
    ingest.upsert_captures(spark, store, make(2, "c").unionByName(make(1, "z")))
    assert [r.field for r in spark.read.parquet(store).collect()] == ["c"]


def test_load(tmp_path):
    (tmp_path / "b.yaml").write_text("name: b\ndiscriminator: {cell: A1}\nversions: {1: {fields: {x: {cell: A2}}}}\n")
    (tmp_path / "a.yaml").write_text("name: a\ndiscriminator: {cells: [A1]}\nversions: {v: {}}\n")
    assert [t.name for t in load(str(tmp_path))] == ["a", "b"] and list(load(str(tmp_path / "b.yaml"))[0].versions) == ["1"]
