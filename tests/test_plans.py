"""How results are planned: cells are read once and not shuffled again, and nothing as large as the collection is broadcast."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sheetwright import queries
from sheetwright.operators import discover, drift, extract, slices
from sheetwright.sources import grid, layout
from sheetwright.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    entry.queries()["halt_resume"](spark, SF)
    return queries.orders(spark, SF)


def test_slices_read_stored_cells_once(orders):
    """Bounded and open ranges and the ends of open ones used to be three scans."""
    logical, _ = plan(slices.slices(orders.books, orders.resolved.filter("version IS NOT NULL"), orders.fields))
    assert logical.count("FileScan parquet spark_catalog.default.cells") == 1


@pytest.mark.parametrize("form", ["tables", "lists", "dicts"])
def test_long_forms_shuffle_nothing(orders, form):
    """They used to be joined with themselves by place."""
    _, physical = plan(getattr(orders, form)())
    assert "Exchange" not in physical


@pytest.mark.parametrize("name", ["halt_resume", "typed_dict", "provenance"])
def test_documents_are_not_broadcast(spark, name):
    """files of sorted ids are small, millions of their rows are not."""
    logical, _ = plan(entry.queries()[name](spark, SF))
    assert "BroadcastHashJoin" not in logical


def test_gaps_and_equal_headers(spark):
    """Rows of a bounded table without cells come as nulls; of equal headers the last counts; a place held twice counts once."""
    cell = lambda r, c, x: ("d", "d.xlsx", "S", 0, r, c, "s", x, None, None, None, False, False)
    cells = spark.createDataFrame([cell(2, 1, "a"), cell(2, 2, "a"), cell(2, 3, "b"), cell(4, 1, "1"), cell(4, 2, "2"), cell(4, 2, "2")], grid.CELLS)
    made = queries.template({"name": "t", "discriminator": {"cells": ["Z1"]}, "versions": {"v": {"fields": {"rows": {"range": "A2:C9", "type": "table"}}}}})
    done = extract.extract(grid.from_cells(cells), [made], forced="v")
    got = sorted((r["record"], r["name"], r["text"]) for r in done.tables().collect())
    assert got == [(0, "a", None), (0, "b", None), (1, "a", "2"), (1, "b", None)]


def test_slices_are_stored_narrow(orders):
    """What a template says of a field used to be sorted and written with each of its cells, some 17 columns and a map."""
    title = next(line for line in orders.sliced._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line)
    assert all(f"{c}#" not in title for c in ("schema", "version", "field", "columns", "pattern", "shape")) and "field_no#" in title
    got = orders.sliced.select(*slices.KEYS, *slices.SPEC).dropDuplicates(slices.KEYS[1:])
    told = {(r["version"], r["field"]): r.asDict() for r in orders.fields.collect()}
    for r in got.collect():
        assert all(r[c] == told[r["version"], r["field"]][c] for c in slices.SPEC)


def test_only_what_is_asked_for_is_cut(spark):
    """Books alone neither detect nor slice; a field's table is cut for that field alone, in one pass over cells that are made of stored rows."""
    queries._DONE.clear()
    e = queries.orders(spark, SF)
    assert e.books.cells.count() > 0 and not {"resolved", "narrow"} & set(e.__dict__)
    logical, physical = plan(e.tables("lines", version="v1.0"))
    assert "narrow" not in e.__dict__ and logical.count("FileScan parquet spark_catalog.default.cells") == 1
    assert e.tables("lines", version="v1.0").count() == e.tables("lines").filter("version = 'v1.0'").count() > 0
    assert e.results("orders", "v2.0", []).count() > 0 and "narrow" not in e.__dict__


def test_equal_places_and_missing_cells_of_tables(spark):
    """Gaps are filled as cells come: before, between and after them, with places held twice and headers that look like missing ones."""
    cell = lambda r, c, x: ("d", "d.xlsx", "S", 0, r, c, "s", x, None, None, None, False, False)
    cells = spark.createDataFrame([cell(1, 2, "col_0"), cell(1, 3, "b"), cell(3, 3, "x"), cell(3, 3, "y"), cell(4, 1, "1"), cell(6, 2, "2")], grid.CELLS)
    made = queries.template({"name": "t", "discriminator": {"cells": ["Z1"]}, "versions": {"v": {"fields": {
        "rows": {"range": "A1:C9", "type": "table"}, "named": {"range": "A3:C9", "type": "table", "columns": {"A": "k", "C": "k"}},
    }}}})
    done = extract.extract(grid.from_cells(cells), [made], forced="v")
    got = sorted((r["field"], r["record"], r["name"], r["text"]) for r in done.tables().collect())
    assert [x for x in got if x[0] == "rows"] == [("rows", r, n, {(1, "b"): "y", (4, "col_0"): "2"}.get((r, n))) for r in range(5) for n in ("b", "col_0")]
    assert [x for x in got if x[0] == "named"] == [("named", r, n, {(0, "k"): "y", (3, "B"): "2"}.get((r, n))) for r in range(4) for n in ("B", "k")]


def test_moves_do_not_sort_or_shuffle_cells(orders):
    """cells used to be shuffled and sorted for each way a field is looked for; now they pass by what is looked up."""
    fields = "doc_id string, schema string, version string, field string, samples array<string>, sheet string, sheet_idx int, row int, col int, width int"
    wanted = orders.books.cells.sparkSession.createDataFrame([("1", "orders", "v2.0", "customer", ["x"], "Sheet1", 0, 3, 2, 1)], fields)
    with layout.by_document(wanted.sparkSession):
        logical, _ = plan(drift.ill_fitting(wanted, orders.books.cells))
    assert "ShuffledHashJoin" in logical and logical.count("FileScan parquet spark_catalog.default.cells") == 1


def test_stream_results_are_not_broadcast(spark, tmp_path):
    """the states of a stream's files are as many as its files; they used to be sent through the driver."""
    out = str(tmp_path)
    spark.createDataFrame([("p", "d", "done")], "path string, doc_id string, state string").write.parquet(f"{out}/files/batch=0/again=0")
    spark.createDataFrame([("d", "x")], "doc_id string, text string").write.parquet(f"{out}/values/batch=0/again=0")
    got = ingest.results(spark, out, "values")
    assert "BroadcastHashJoin" not in plan(got)[0] and got.count() == 1


def test_clean_up_takes_many_documents(spark):
    """a batch of documents is one call; one that has a single proposal is none of Python's."""
    row = lambda lo, hi, score, kind: [lo, hi, 1.0, 2.0, score, kind, 0.0]
    nums = pd.Series([None, np.array(row(1, 1, 0.7, 2) + row(5, 9, 0.9, 0) + row(6, 6, 0.8, 2))])
    texts = pd.Series([None, np.array(["S", "S", "S", "a", "t_table", "b"], dtype=object)])
    assert list(discover._kept(nums, texts)) == [None, [1, 0]]
