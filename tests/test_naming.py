"""Names for selections, proposals beside a template, hidden columns, titled tables: small sheets worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwright.functions import text
from sheetwright.operators import coverage, discover, drift, naming
from sheetwright.plans.template import fields_table, template
from sheetwright.sources.grid import CELLS, HIDDEN, MERGES
from tests.test_extract import block, cell

BLOCK = "doc_id string, sheet string, row int, col int, end_row int, end_col int"


def test_header_row_of_a_block(spark):
    cells = spark.createDataFrame(block("d", "A1", [["Group", None, "x"], ["Name", "Amount", "When"], ["n1", "2", "3"]]) + block("e", "A1", [["same", "same", "Same"], ["One", "Two", "3"], ["1", "2", "4"]]), CELLS)
    merges = spark.createDataFrame([("d", "Sheet1", 1, 1, 1, 2)], MERGES)
    blocks = spark.createDataFrame([("d", "Sheet1", 1, 1, 3, 3), ("e", "Sheet1", 1, 1, 3, 3), ("none", "Sheet1", 4, 1, 9, 2)], BLOCK)
    got = {r.doc_id: (r.header_row, r.score) for r in naming.best_header_row(blocks, cells, merges).collect()}
    # d: two texts and a merged area, 2 + 1; row 2 has 3; the upper of equal ones. e: repeated texts, 3 - 2; row 2 has 2 - 1; row 1 is the upper
    assert got == {"d": (1, 3), "e": (1, 1), "none": (4, None)}
    names = {(r.doc_id, r.letters): r.name for r in naming.column_names(blocks, cells, merges).collect()}
    assert names == {("d", "A"): "group", ("d", "B"): "group", ("d", "C"): "x", ("e", "A"): "same", ("e", "B"): "same", ("e", "C"): "same"}
    assert {(r.at, r.name) for r in naming.row_names(blocks.filter("doc_id = 'd'"), cells).collect()} == {(1, "group"), (2, "name"), (3, "n1")}


def test_field_names(spark):
    cells = spark.createDataFrame([cell("d", "B1", "Above"), cell("d", "A2", "Sample Date:"), cell("d", "A5", "left"), cell("d", "C4", "( )")], CELLS)
    picked = spark.createDataFrame([("d", "Sheet1", 2, 2, False), ("d", "Sheet1", 5, 2, False), ("d", "Sheet1", 5, 2, True), ("d", "Sheet1", 3, 1, True), ("d", "Sheet1", 5, 3, False)], "doc_id string, sheet string, row int, col int, is_range boolean")
    got = sorted((r.row, r.col, r.name) for r in naming.field_names(picked, cells).collect())
    assert got == [(2, 2, "above"), (3, 1, "sample_date"), (5, 2, "left")]
    names = spark.createDataFrame([("date_of_sample",), ("other",)], "name string")
    assert ("sample_date", "date_of_sample") in {(r.slug, r.name) for r in coverage.fuzzy_names(spark.createDataFrame([("sample_date",), ("zzz",)], "slug string"), names).collect()}


def test_promotion_versions_and_edges(spark):
    cells = spark.createDataFrame(block("d", "A1", [["Name", "Amount"], ["n1", "2"], ["n2", "3"]]), CELLS)
    blocks = spark.createDataFrame([("d", "Sheet1", 2, 1, 3, 2), ("d", "Sheet1", 1, 1, 3, 2)], BLOCK)
    assert sorted((r.row, r.promoted) for r in naming.promoted_headers(blocks, cells).collect()) == [(1, False), (1, True)]
    assert [(r.doc_id, r.value) for r in naming.guessed_versions(cells, [(None, 2, 1), ("Sheet1", 1, 2), ("Other", 1, 1), (None, 9, 9)]).collect()] == [("d", "n1 Amount")]
    edges = [("d", "S", 0, "footer", "odd", "left", "x"), ("d", "S", 0, "header", "even", "right", "y"), ("d", "S", 0, "header", "first", "center", "z"), ("d", "S", 0, "header", "odd", "left", " ")]
    got = naming.first_edges(spark.createDataFrame(edges, "doc_id string, sheet string, sheet_idx int, kind string, page string, section string, text string")).collect()
    assert [(r.kind, r.page, r.section, r.text) for r in got] == [("header", "first", "center", "z")]


def test_hidden_columns_within_runs(spark):
    cells = spark.createDataFrame([cell("d", r, "x") for r in ("A1", "B1", "E1", "H1", "B2", "J2")], CELLS)
    hidden = spark.createDataFrame([("d", "Sheet1", 3, 3), ("d", "Sheet1", 4, 4), ("d", "Sheet1", 6, 6), ("d", "Sheet1", 11, 20)], HIDDEN)
    got = sorted((r.row, r.start_col, r.end_col, r.width) for r in discover.row_runs(cells, hidden).collect())
    assert got == [(1, 1, 6, 6), (1, 8, 8, 1), (2, 2, 4, 3), (2, 10, 10, 1)]
    assert sorted((r.row, r.start_col, r.end_col) for r in discover.row_runs(cells).collect()) == [(1, 1, 2), (1, 5, 5), (1, 8, 8), (2, 2, 2), (2, 10, 10)]


def test_titled_tables_and_mapped_places(spark):
    rows = [["Table 2: Lab results"], [], ["Name", "Amount", "Unit", None, None, "Place", "Remark"], ["n1", "2.5", "mg", None, None, "p1", "x"], ["n2", "3.5", "mg", None, None, "p2", "y"], ["n3", "4.5", "mg", None, None, "p3", "z"]]
    cells = spark.createDataFrame(block("d", "B2", rows), CELLS)
    got = [(r.name, r.row, r.end_row, r.start_col, r.end_col, r.score) for r in discover.suggest_titled_tables(cells).collect()]
    assert sorted(got) == [("lab_results_n1_table", 5, 7, 2, 8, 0.94), ("lab_results_table", 4, 7, 2, 8, 0.99)]  # the next row would do as a header too
    t = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {"v": {"fields": {"amount": {"range": "C5:C", "type": "list[float]"}}}}})
    found = discover.suggest_titled_tables(cells)
    assert discover.clear_of_mapped(found, fields_table(spark, [t])).count() == 0
    refs = lambda found: {r.ref for r in found.filter("kind = 'table'").collect()}
    assert refs(discover.scan_suggestions(cells)) == {"B4:H"} and refs(discover.scan_suggestions(cells, mapped=fields_table(spark, [t]))) == {"G4:H"}
    elsewhere = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {"v": {"fields": {"far": {"cell": "Z99"}, "lab_results_table": {"cell": "Y99"}}}}})
    assert discover.clear_of_mapped(found, fields_table(spark, [elsewhere]).filter("field = 'far'")).count() == 2
    assert discover.clear_of_mapped(found, fields_table(spark, [elsewhere])).count() == 1


def test_at_most_so_many_tables_a_sheet(spark):
    rows = [r for k in range(20) for r in ([f"Name{k} a", "Amount b", "Unit c"], ["x y", "1", "2"], ["z w", "3", "4"], [])]
    cells = spark.createDataFrame(block("d", "A1", rows), CELLS)
    assert discover.suggest_tables(cells).count() == discover.MOST_TABLES


def test_rendered_values_and_moves(spark):
    rows = spark.createDataFrame([("d", True, None, [1, 2], {"a": "b"})], "doc_id string, yes boolean, none string, xs array<int>, m map<string,string>")
    assert tuple(coverage.render(rows).first()) == ("d", "TRUE", "", "[1,2]", '{"a":"b"}')
    t = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {"v": {"fields": {"one": {"cell": "B3"}, "open": {"range": "C5:D", "type": "table", "columns": {"C": "x"}}, "closed": {"range": "C5:C9", "type": "list[str]"}, "still": {"cell": "A9"}}}}})
    moves = spark.createDataFrame([("t", "v", "one", 7, 4), ("t", "v", "open", 6, 1), ("t", "v", "closed", 6, 1)], "schema string, version string, field string, new_row int, new_col int")
    got = {r.field: (r.start_row, r.start_col, r.end_row, r.end_col, r.columns) for r in drift.apply_moves(fields_table(spark, [t]), moves).collect()}
    assert got == {"one": (7, 4, 7, 4, {}), "open": (6, 1, None, 2, {}), "closed": (6, 1, 9, 1, {}), "still": (9, 1, 9, 1, {})}
    assert spark.range(1).select(text.is_table_title(F.lit(" Table 3: x")), text.is_table_title(F.lit("table of 3: x"))).first()[:] == (True, False)
