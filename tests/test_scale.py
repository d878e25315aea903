"""Long sheets in blocks, registries as tables, streams with bounded batches that halt and go on, merged areas by asked rows, version tables."""

from __future__ import annotations

import contextlib
import io
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from sheetwright import queries
from sheetwright.operators import coverage, detect, drift, lines, slices
from sheetwright.plans import registry
from sheetwright.plans.template import fields_table, template
from sheetwright.sources import grid, layout, melt, shared, sinks
from sheetwright.sources.grid import CELLS, MERGES, from_cells
from sheetwright.streaming import ingest
from tests.test_extract import cell

LONG = template({"name": "long", "discriminator": {"cells": ["Z1"]}, "versions": {"v": {"fields": {"rows": {"range": "B3:C", "type": "table"}, "flat": {"range": "B3:B20", "type": "list[str]"}}}}})


def open_ends(spark, cells):
    books = from_cells(cells)
    found = slices.slices(books, detect.detect_versions(books, [LONG], forced="v"), fields_table(spark, [LONG]))
    return {r.doc_id: r.last for r in found.filter("field = 'rows'").groupBy("doc_id").agg(F.max("row").alias("last")).collect()}, found


def test_open_ranges_over_blocks(spark, monkeypatch):
    """Blocks of 4 rows, sheets with gaps anywhere: the range ends before the first empty row."""
    monkeypatch.setattr(slices, "BLOCK_ROWS", 4)
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(60):
        there = {r: rng.sample("BC", rng.randint(1, 2)) for r in range(3, 3 + rng.randint(0, 30)) if rng.random() < 0.93}
        rows += [cell(str(d), f"{c}{r}", f"x{r}") for r, cols in there.items() for c in cols] + [cell(str(d), "A1", "z")]
        end = 3
        while end in there:
            end += 1
        if end > 3:
            want[str(d)] = end - 1
    assert open_ends(spark, spark.createDataFrame(rows, CELLS))[0] == want


def method_sizes(df):
    """Bytes of the largest compiled method of each stage of the plan. The JVM runs methods beyond 8,000 interpreted, several times slower."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]


def test_methods_that_the_jvm_compiles(spark):
    """What goes over every cell, making cells of rows and inferring a version by layout, stays within methods that are compiled."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        books, orders = melt.order_books(spark, "/root/testdata/sf0.001"), template(melt.ORDER_TEMPLATE)
        tried = books.docs.select("doc_id", F.lit("orders").alias("schema"))
        for made in (books.cells, detect.by_layout(from_cells(spark.createDataFrame([], CELLS)), tried, fields_table(spark, [orders]))):
            sizes = method_sizes(made)
            assert sizes and max(sizes) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_settings_of_a_laid_out_table(spark):
    """More buckets than shuffle partitions deal rows once, in as many files; the session's settings are as before."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("doc_id"))
    made = layout.laid_out(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "counts", 7)
    assert made.count() == 1000 and len(made.inputFiles()) == 7
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert layout.buckets_for(spark, 10) == 3 and layout.buckets_for(spark, 5 * layout.BUCKET_CELLS + 1) == 6


def test_lines_are_of_one_list_and_kept_by_small_methods(spark, monkeypatch):
    """A line's cells are collected once; what is kept is written without stages that are one huge method; the session's settings are as before."""
    cells = spark.createDataFrame([cell("d", "A1", "Part:"), cell("d", "B1", "A-1"), cell("d", "C1", "Table 1: Order lines ")], CELLS)
    made = lines.sheet_lines(cells)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path: (seen.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit")), write(w, path)))
    r = shared.cut(made, "lines").first()
    assert seen == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
    assert r.cols == [1, 2, 3] and r.id_cols == r.typed_cols == [2] and r.formula_cols == [] and [(t.col, t.title, t.is_table) for t in r.titled] == [(3, "Order lines", True)]
    assert [(c.col, c.label) for c in r.cells] == [(1, "Part"), (2, "A-1"), (3, "Table 1: Order lines")] and (1, "Part") in [(o.col, o.label) for o in r.over]


def test_users_are_not_sent_to_all_tasks(spark):
    """Slices of event workbooks meet their users as they lie: only the templates' fields are broadcast."""
    books = queries.events(spark, "/root/testdata/sf0.001")
    fields = fields_table(spark, [queries.EVENTS])
    found = slices.slices(books, detect.detect_versions(books, [queries.EVENTS], fields, "log"), fields)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1


def test_a_million_rows(spark):
    """One sheet of a million rows with a gap near its end: the same answer, and its blocks lie in several tasks."""
    n = 1_000_000
    rows = spark.range(3, n + 3).filter("id <> 990001").withColumns({"doc_id": F.lit("d"), "path": F.lit("d")})
    cells = melt.to_cells(rows, F.array(melt.cell(F.col("id"), 2, "i", F.col("id"))))
    ends, found = open_ends(spark, cells)
    assert ends == {"d": 990_000}
    opened = found.filter("field = 'rows'").select(*slices.KEYS, "start_row", "row").withColumn("block", F.expr(f"(row - start_row) div {slices.BLOCK_ROWS}"))
    blocks = slices.open_blocks(opened)
    assert blocks.count() == -(-989_998 // slices.BLOCK_ROWS)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "block" in plan[plan.index("hashpartitioning(doc_id") :]
    dealt = opened.repartition(3, *slices.KEYS, "block").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) == 3


def test_registry(spark):
    versions = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "x", "y"), ("t", "y", "z"), ("t", "z", "y"), ("t", "self", "self"), ("t", "lost", "nowhere"), ("t", "below", "lost"), ("u", "b", None)]
    fields = [("t", "a", "one", 0, 1), ("t", "a", "two", 1, 2), ("t", "b", "three", 0, 3), ("t", "b", "one", 1, 11), ("t", "c", "two", 0, 22), ("t", "x", "q", 0, 5), ("u", "b", "own", 0, 6)]
    found, wrong = registry.resolve(spark.createDataFrame(versions, "schema string, version string, extends string"), spark.createDataFrame(fields, "schema string, version string, field string, field_ord int, start_row int"))
    got: dict = {}
    for r in found.orderBy("schema", "version", "place").collect():
        got.setdefault((r.schema, r.version), []).append((r.field, r.start_row, r.origin))
    assert got == {("t", "a"): [("one", 1, "a"), ("two", 2, "a")], ("t", "b"): [("one", 11, "b"), ("two", 2, "a"), ("three", 3, "b")], ("t", "c"): [("one", 11, "b"), ("two", 22, "c"), ("three", 3, "b")], ("u", "b"): [("own", 6, "b")]}
    assert {(r.version, r.error) for r in wrong.collect()} == {("x", "cycle"), ("y", "cycle"), ("z", "cycle"), ("self", "cycle"), ("lost", "unknown parent"), ("below", "unknown parent")}
    # the same as the driver's templates resolve
    made = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {v: {"extends": up, "fields": {f: {"cell": f"A{row}"} for s, w, f, _, row in fields if s == "t" and w == v}} for s, v, up in versions[:3]}})
    for v in "abc":
        assert [(f.name, f.start_row) for f in made.versions[v].values()] == [x[:2] for x in got["t", v]]


def test_long_chains(spark):
    n = 300
    versions = spark.createDataFrame([("t", str(k), str(k - 1) if k else None) for k in range(n)], "schema string, version string, extends string")
    chain = registry.ancestors(versions)
    assert chain.count() == n * (n + 1) // 2 and chain.filter("version = '299' AND ancestor = '0'").first().depth == 299


def test_wide_or_long(spark):
    flat = spark.createDataFrame([("d", "x.10", "a"), ("d", "x.2", "b"), ("e", "name", "c")], "doc_id string, path string, value string")
    rows, is_wide = coverage.wide_or_long(flat)
    assert is_wide and rows.columns == ["doc_id", "name", "x.2", "x.10"] and rows.filter("doc_id = 'd'").first()["x.10"] == "a"
    same, is_wide = coverage.wide_or_long(flat, most=2)
    assert not is_wide and same.count() == 3


def test_a_backlog_goes_in_bounded_batches(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    for k in range(5):
        spark.createDataFrame([cell(f"d{k}", "A1", "v"), cell(f"d{k}", "A2", f"x{k}")], CELLS).coalesce(1).write.mode("append").parquet(src)
    t = template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": {"v": {"fields": {"x": {"cell": "A2"}}}}})
    ingest.ingest_cells(spark, src, [t], out, seen, admission=ingest.Admission(most_files=2))
    assert sorted(r.text for r in ingest.results(spark, out, "values").collect()) == [f"x{k}" for k in range(5)]
    assert ingest.results(spark, out, "values").select("batch").distinct().count() == 3


def test_a_stream_halts_and_goes_on(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    # a version's field stands in a row of its own, else the layout would tell
    one, two, three = (template({"name": f"v{k}", "discriminator": {"cells": ["A1"]}, "versions": {f"v{k}": {"fields": {"x": {"cell": f"A{k + 1}"}}}}}) for k in (1, 2, 3))

    def arrive(*docs):
        spark.createDataFrame([c for d, v in docs for c in (cell(d, "A1", v), cell(d, f"A{int(v[1]) + 1}", f"of {d}"))], CELLS).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_cells(spark, src, [one], out, seen, stop_on_unmatched=True)

    def states():
        return {r.doc_id: r.state for r in ingest.file_states(spark, out).collect()}

    values = lambda: sorted(r.doc_id for r in ingest.results(spark, out, "values").collect())
    failures = lambda: sorted(r.doc_id for r in ingest.results(spark, out, "failures").collect())
    arrive(("a", "v1"), ("b", "v2"), ("c", "v1"))
    assert states() == {"a": "done", "b": "halt", "c": "held"} and values() == ["a"] and failures() == ["b"]
    arrive(("d", "v1"), ("e", "v3"))
    assert states() == {"a": "done", "b": "halt", "c": "held", "d": "held", "e": "held"} and values() == ["a"] and failures() == ["b"]
    halt = ingest.go_on(spark, [one, two], out)
    assert halt.endswith("e.xlsx") and states() == {"a": "done", "b": "done", "c": "done", "d": "done", "e": "halt"} and values() == ["a", "b", "c", "d"] and failures() == ["e"]
    assert ingest.go_on(spark, [one, two, three], out) is None and failures() == [] and values() == ["a", "b", "c", "d", "e"]
    assert ingest.go_on(spark, [one], out) is None
    arrive(("f", "v1"))
    assert states()["f"] == "done" and values() == ["a", "b", "c", "d", "e", "f"]


def test_captures_again_and_out_of_order(spark, tmp_path):
    store, make = str(tmp_path / "store"), lambda at, *xs: spark.createDataFrame([("t", "v1", at, x) for x in xs], "schema string, version string, captured_at long, field string")
    held = lambda: sorted((r.captured_at, r.field) for r in spark.read.parquet(store).collect())
    ingest.upsert_captures(spark, store, make(5, "a", "b"))
    ingest.upsert_captures(spark, store, make(3, "old"))
    assert held() == [(5, "a"), (5, "b")]
    for _ in range(2):
        ingest.upsert_captures(spark, store, make(7, "c"))
        assert held() == [(7, "c")]


def test_version_tables(spark, tmp_path):
    base = str(tmp_path / "records")
    sinks.write_records(spark.createDataFrame([("d", 1)], "doc_id string, n int"), "s/1", "v 2", base)
    sinks.write_records(spark.createDataFrame([("e", 2.5)], "doc_id string, x double"), "s/1", "v 2", base)
    sinks.write_records(spark.createDataFrame([("f", "many")], "doc_id string, n string"), "s/1", "v3", base)
    one = sinks.read_records(spark, "s/1", "v 2", base)
    assert dict(one.dtypes) == {"doc_id": "string", "n": "int", "x": "double"} and sorted(map(tuple, one.select("doc_id", "n", "x").collect())) == [("d", 1, None), ("e", None, 2.5)]
    both = sinks.read_all_records(spark, [("s/1", "v 2"), ("s/1", "v3")], base)
    assert sorted(map(tuple, both.select("version", "doc_id", "n", "x").collect()), key=repr) == [("v 2", "d", "1", None), ("v 2", "e", "", 2.5), ("v3", "f", "many", None)]


def test_merged_cells_of_asked_rows(spark):
    rng = random.Random(3)
    rows = [cell("d", f"{c}{r}", f"{c}{r}") for r in range(1, 40) for c in "ABCD" if rng.random() < 0.4]
    merges = [("d", "Sheet1", 1, 1, 30, 1), ("d", "Sheet1", 2, 2, 2, 4), ("d", "Sheet1", 35, 3, 38, 4), ("d", "Sheet1", 40, 1, 41, 2), ("d", "Sheet1", 33, 1, 33, 1)]
    books = from_cells(spark.createDataFrame(rows, CELLS), merges=spark.createDataFrame(merges, MERGES))
    every = {(r.row, r.col, r.text) for r in grid.merged_cells(books).collect()}
    asked = spark.createDataFrame([("d", "Sheet1", r) for r in (1, 2, 2, 17, 36, 38, 50)], "doc_id string, sheet string, row int")
    assert {(r.row, r.col, r.text) for r in grid.merged_cells(books, asked).collect()} == {x for x in every if x[0] in (1, 2, 17, 36, 38)}
    assert {(r.row, r.col) for r in grid.fill_merges(books).cells.collect()} == {(r, c) for r, c, _ in every} | {(r.row, r.col) for r in books.cells.collect()}


def test_votes_follow_the_first_sample(spark):
    """A sheet full of the later samples' values: what is looked up follows the hits of the first."""
    noise = [cell("d", f"{c}{r}", "ok") for r in range(1, 60) for c in "ABCDEFGH"]
    moved = [cell("d", f"J{r + 10}", v) for r, v in enumerate(["start here", "ok", "0", "ok"])]
    wanted = spark.createDataFrame([("d", "t", "v", "f", ["start here", "ok", "0", "ok"], "Sheet1", 0, 5, 12)], "doc_id string, schema string, version string, field string, samples array<string>, sheet string, sheet_idx int, row int, col int")
    cells = spark.createDataFrame(noise + moved, CELLS)
    (r,) = drift.moved_ranges(wanted, cells).collect()
    assert (r.axis, r.row, r.col, r.end_row, r.hits) == ("vertical", 10, 10, 13, 4)
    assert drift.moved_ranges(wanted, cells.filter("text <> 'start here'")).count() == 0
