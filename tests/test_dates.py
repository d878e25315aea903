import datetime as dt
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetwright import queries
from sheetwright.functions import dates
from sheetwright.sources import grid, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CODES = {
    "yyyy\\-mm\\-dd": "date", "mmm": "date", "ss": "date", "mm:ss": "date", "d/m;0": "date", "[$-409]d-mmm": "date", "[h]:mm": "duration", "[SS].0": "duration", "[mm]": "duration",
    "0.00": "number", "General": "number", "0;d": "number", '0" days"': "number", "[Red]0": "number", "0_d": "number", "\\d0": "number", "0.00E+00": "number", "@": "number", "": "number", None: "number",
}
EDGES = [0.0, 0.25, 0.9999999999, 1.0, 59.5, 60.0, 61.0, 45306.4375, 45306.000001234, 2958465.0, 2958466.0, 1e7, 1e12, 1e300, -0.5, -1.0, -2.75, -693593.0, -693594.0, float("nan")]


def test_format_rule_is_one(spark):
    rows = spark.createDataFrame([(c,) for c in CODES], "format string")
    got = {r.format: "number" if not r.d else "duration" if r.e else "date" for r in rows.select("format", dates.is_date_format(F.col("format")).alias("d"), dates.is_duration_format(F.col("format")).alias("e")).collect()}
    assert got == CODES and {c: workbooks.format_shows(c) for c in CODES} == CODES


def test_columns_agree_with_the_reader(spark):
    rng = random.Random(5)
    numbers = EDGES + [rng.uniform(-1e5, 3e6) for _ in range(300)] + [rng.randrange(80_000) / 8 for _ in range(200)]
    places = [(k, x, code) for k, (x, code) in enumerate((x, code) for x in numbers for code in ("d/m/yyyy", "[h]:mm:ss", "0.0", None))]
    raw = spark.createDataFrame([("d", "p", "S", 0, k + 1, 1, "f", "raw", x, None, None, None, None) for k, x, _ in places], grid.CELLS)
    formats = spark.createDataFrame([("d", "S", k + 1, 1, code, "x") for k, _, code in places] + [("d", "S", 1, 1, "d", "again")], grid.FORMATS + ", kind string")
    got = {r.row - 1: r for r in grid.dated(raw, formats).collect()}
    assert len(got) == len(places)
    for k, x, code in places:
        if code in ("0.0", None):
            assert got[k].kind == "f" and got[k].text == "raw"
            continue
        want = workbooks._from_serial(x, code.startswith("["), dt.timedelta())
        assert (got[k].kind, got[k].text, got[k].ts, got[k].num) == (want["kind"], want["text"], want.get("ts"), None), (x, code)
    assert [c.name for c in grid.dated(raw, formats).schema] == [c.name for c in raw.schema]
    words = raw.withColumns({"kind": F.lit("s"), "num": F.lit(None).cast("double")})
    assert grid.dated(words, formats).filter("kind <> 's' OR text <> 'raw'").isEmpty() and grid.dated(raw, formats.limit(0)).filter("kind <> 'f'").isEmpty() and grid.dated(raw.limit(0), formats).isEmpty()


def test_reader_takes_days_as_shown(spark, tmp_path):
    values = [("1", 1), ("0.75", 1), ("59", 1), ("2958465", 1), ("99999999", 1), ("1.5", 2), ("7", 3), ("12.5", 4), ("0.5", 5)]
    cells = "".join(f'<c r="{"ABCDEFGHI"[k]}1" s="{s}"><v>{v}</v></c>' for k, (v, s) in enumerate(values))
    for name, late in (("a", ""), ("b", '<workbookPr date1904="1"/>')):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {NS}>{late}<sheets><sheet name="Main" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>')
            z.writestr("xl/worksheets/one.xml", f'<worksheet {NS}><sheetData><row r="1">{cells}</row></sheetData></worksheet>')
            z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="[$-409]d\\-mmm"/><numFmt numFmtId="171" formatCode="0;d"/></numFmts><fonts><font/></fonts><fills><fill/></fills><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="46"/><xf numFmtId="171"/><xf numFmtId="2"/><xf numFmtId="30"/></cellXfs></styleSheet>')
    books, bad = workbooks.read_workbooks(spark, str(tmp_path))
    assert bad.isEmpty()
    read = lambda name: {r.col: (r.kind, r.text) for r in books.cells.filter(f"doc_id LIKE '%{name}.xlsx'").collect()}
    want = {1: ("t", "1900-01-01 00:00:00"), 2: ("s", "18:00:00"), 3: ("t", "1900-02-28 00:00:00"), 4: ("t", "9999-12-31 00:00:00"), 5: ("e", "#VALUE!"), 6: ("s", "1 day, 12:00:00"), 7: ("i", "7"), 8: ("f", "12.5"), 9: ("s", "12:00:00")}
    assert read("a") == want
    assert read("b") == want | {1: ("t", "1904-01-02 00:00:00"), 3: ("t", "1904-02-29 00:00:00"), 4: ("e", "#VALUE!")}
    codes = {r.col: r.format for r in books.stored().formats.filter("doc_id LIKE '%a.xlsx'").collect()}
    assert codes == {k: "[$-409]d\\-mmm" for k in range(1, 6)} | {6: "[h]:mm:ss", 7: "0;d", 8: "0.00"}


@pytest.mark.parametrize("name", ["number_formats", "serial_dates"])
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
