"""The library's own queries over the driver's tables, laid out as workbooks, and their SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, dates, text
from .functions.addressing import format_ref, index_to_letters, letters_to_index, parse_cell, parse_range
from .operators import coverage, detect, discover, drift, extract, naming, slices
from .plans import registry
from .plans.template import fields_table, template
from .sources import grid, melt, sinks
from .sources.layout import buckets_for, by_document, whole
from .sources.shared import cut, new_path
from .streaming import ingest

ORDERS = template(melt.ORDER_TEMPLATE)
EVENTS = template({"name": "events", "discriminator": {"cells": ["A1"]}, "versions": {"log": {"fields": {
    "rows": {"range": "A1:E", "type": "table", "columns": {"A": "event", "B": "value", "C": "at", "D": "key", "E": "n"}},
    "tall": {"range": "A1:E", "type": "table", "orientation": "vertical"},
    "types": {"range": "A1:B", "type": "list[str]"},
}}}})
TALKS = template({"name": "talks", "discriminator": {"cells": ["A1"]}, "versions": {"user": {"fields": {"turns": {"range": "A1:B", "type": "table", "columns": {"A": "role", "B": "text"}}}}}})
LINES = template({"name": "text", "discriminator": {"cells": ["A1"]}, "versions": {"text": {"fields": {"top": {"range": "A1:A", "type": "list[str]"}, "block": {"range": "A1:A1048576", "type": "list[str]"}}}}})
TALLY = template({"name": "tally", "discriminator": {"cells": ["A1"]}, "versions": {"log": {"fields": {"props": {"range": "D1:E", "type": "dict[str, int]"}}}}})
TIED = template({"name": "tied", "discriminator": {"cells": ["Z99"]}, "versions": {"a": {"fields": {"x": {"cell": "A3"}}}, "b": {"fields": {"y": {"cell": "A3"}}}}})
_DONE: dict[tuple, extract.Extraction] = {}


def orders(spark: SparkSession, sf_dir: str) -> extract.Extraction:
    """The order workbooks, laid out once a session and folder; what queries ask for is detected and sliced then."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        _DONE.clear()
        about = melt.read(spark, sf_dir, "orders").count() * 15 + melt.read(spark, sf_dir, "lineitem").count() * 5
        _DONE[key] = extract.extract(melt.order_books(spark, sf_dir, buckets_for(spark, about)), [ORDERS])
    return _DONE[key]


def events(spark: SparkSession, sf_dir: str) -> grid.Workbooks:
    """The event workbooks, laid out by document: then their users and ranges are not sent to all tasks to meet the cells."""
    about = melt.read(spark, sf_dir, "events").count() * 5
    return melt.event_books(spark, sf_dir).stored(buckets_for(spark, about))


def order_totals(spark, sf_dir):
    lines = slices.typed_table(orders(spark, sf_dir).tables("lines"), {"price": "float", "qty": "float"})
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.round(F.sum("price"), 2).alias("total"), F.sum("qty").alias("qty"))


def scalar_fields(spark, sf_dir):
    return orders(spark, sf_dir).results("orders", "v2.0", []).select("doc_id", "customer", "total", "n_lines", F.date_format("order_date", "yyyy-MM-dd").alias("ordered"))


def open_range_list(spark, sf_dir):
    return orders(spark, sf_dir).lists("quantities").select("doc_id", "version", F.col("pos").cast("long").alias("pos"), coerce.to_float().alias("quantity"))


def dict_field(spark, sf_dir):
    return orders(spark, sf_dir).dicts("info").select("doc_id", "key", "value")


def table_header(spark, sf_dir):
    e = orders(spark, sf_dir)
    return e.tables("lines", version="v2.0").select("doc_id", F.col("record").cast("long").alias("record"), "name", F.round(F.coalesce("num", F.lit(0)), 2).alias("num"), F.when(F.col("kind") == "s", F.col("text")).otherwise("").alias("word"))


def table_columns(spark, sf_dir):
    e = orders(spark, sf_dir)
    rows = slices.typed_table(e.tables("lines", version="v1.0"), {"part": "int", "qty": "float", "price": "float", "flag": "str"})
    return rows.select("doc_id", F.col("record").cast("long").alias("record"), "part", "qty", F.round("price", 2).alias("price"), "flag")


def version_by_discriminator(spark, sf_dir):
    return orders(spark, sf_dir).resolved.select("doc_id", "version", "matched_by", F.coalesce("matched_cell", F.lit("<inferred>")).alias("source"))


def checked_cells(spark, sf_dir):
    return orders(spark, sf_dir).resolved.select("doc_id", F.size("checked").cast("long").alias("n"), F.array_join(F.transform("checked", lambda c: F.concat(c["cell"], F.lit("="), c["value"])), ",").alias("trail"))


def version_by_layout(spark, sf_dir):
    e = orders(spark, sf_dir)
    blank = e.resolved.filter("matched_by = 'inference'").select("doc_id", F.lit("orders").alias("schema"))
    return detect.by_layout(e.books, blank, e.fields).select("doc_id", "version", F.round("confidence", 6).alias("confidence"))


def ambiguous_layout(spark, sf_dir):
    e = orders(spark, sf_dir)
    got = detect.detect_versions(e.books, [TIED])
    return got.groupBy(F.coalesce("version", F.lit("none")).alias("version")).agg(F.count("*").alias("n"))


def multi_template(spark, sf_dir):
    e = orders(spark, sf_dir)
    other = template({"name": "early", "discriminator": {"cells": ["A1"]}, "versions": {"v1.0": {"fields": {"who": {"cell": "A3"}}}}})
    got = detect.detect_versions(e.books, [other, ORDERS])
    return got.groupBy("schema", "version", "matched_by").agg(F.count("*").alias("n"))


def forced_version(spark, sf_dir):
    e = orders(spark, sf_dir)
    got = detect.detect_versions(e.books, [ORDERS], forced="v1.0")
    cuts = slices.slices(e.books, got, e.fields.filter("field = 'customer'"))
    return got.join(whole(cuts.select("doc_id", "text")), "doc_id", "left").groupBy(F.col("text").isNotNull().alias("has_customer")).agg(F.count("*").alias("n"))


def computed_fields(spark, sf_dir):
    return orders(spark, sf_dir).results("orders", "v2.0", []).select("doc_id", F.round("per_line", 4).alias("per_line"), "label")


def rule_failures(spark, sf_dir):
    rows = orders(spark, sf_dir).results("orders", "v2.0", []).select("doc_id", F.explode("errors").alias("e"))
    return rows.select("doc_id", "e.field", "e.rule")


def batch_summary(spark, sf_dir):
    return extract.batch_summary(orders(spark, sf_dir))


def halt_resume(spark, sf_dir):
    e = orders(spark, sf_dir)
    only = e.resolved.withColumn("version", F.when(F.col("version") == "v1.0", F.col("version")))
    return extract.halted(only, e.books.docs)


def typed_cells(spark, sf_dir):
    """Every order line's cells with the type that a template may ask for."""
    lines = melt.numbered_lines(spark, sf_dir).withColumns({"doc_id": F.col("l_orderkey").cast("string"), "path": F.lit("")})
    c = F.col
    values = F.array(melt.cell(c("n"), 1, "i", c("l_partkey")), melt.cell(c("n"), 2, "f", c("l_extendedprice")), melt.cell(c("n"), 3, "s", c("l_returnflag")), melt.cell(c("n"), 4, "s", F.concat(F.lit(" "), c("l_suppkey"), F.lit(" "))), melt.cell(c("n"), 5, "t", c("l_shipdate")))
    return melt.to_cells(lines, values)


def coerce_strict(spark, sf_dir):
    rows = typed_cells(spark, sf_dir)
    return rows.groupBy("col").agg(F.count("*").alias("n"), F.sum(coerce.to_int()).alias("ints"), F.count_if(coerce.failed("int")).alias("no_int"), F.round(F.sum(coerce.to_float()), 2).alias("floats"), F.count_if(coerce.to_bool()).alias("truths"), F.count_if(coerce.failed("date")).alias("no_date"))


def coerce_lenient(spark, sf_dir):
    rows = typed_cells(spark, sf_dir)
    return rows.groupBy("col").agg(F.sum(coerce.lenient_int()).alias("ints"), F.count_if(F.coalesce(coerce.lenient_bool(), F.lit(False))).alias("truths"))


def col_letters(spark, sf_dir):
    parts = melt.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 18277 + 1).cast("int").alias("idx")).distinct()
    return parts.select("idx", index_to_letters(F.col("idx")).alias("letters")).withColumn("back", letters_to_index(F.col("letters")))


def parse_refs(spark, sf_dir):
    lines = melt.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    sheet = F.when(F.col("l_partkey") % 3 == 0, F.lit("Sheet2"))
    refs = lines.select(format_ref(sheet, (F.col("l_orderkey") + 1).cast("int"), (F.col("l_partkey") % 700 + 1).cast("int")).alias("ref"))
    refs = refs.withColumns({"c": parse_cell(F.col("ref")), "r": parse_range(F.concat("ref", F.lit(":ZZ")))})
    return refs.groupBy(F.coalesce("c.sheet", F.lit("")).alias("sheet")).agg(F.count("*").alias("n"), F.sum(F.col("c.row").cast("long")).alias("rows"), F.sum(F.col("c.col").cast("long")).alias("cols"), F.count_if(F.col("r.end_row").isNull() & (F.col("r.end_col") == 702)).alias("open_ranges"))


def conversation_table(spark, sf_dir):
    e = extract.extract(melt.conversation_books(spark, sf_dir), [TALKS], forced="user")
    rows = slices.typed_table(e.tables(), {"role": "str", "text": "str"})
    return rows.select("doc_id", F.col("record").cast("long").alias("record"), "role", F.coalesce("text", F.lit("")).alias("text"))


def event_table(spark, sf_dir):
    e = extract.extract(events(spark, sf_dir), [EVENTS], forced="log")
    rows = slices.typed_table(e.tables("rows"), {"event": "str", "value": "float", "n": "int"})
    return rows.groupBy("doc_id", "event").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.sum("n").alias("n"))


def table_vertical(spark, sf_dir):
    e = extract.extract(events(spark, sf_dir), [EVENTS], forced="log")
    return e.tables("tall").select("doc_id", F.col("record").cast("long").alias("record"), "name", F.round("num", 6).alias("value"))


def first_column_only(spark, sf_dir):
    e = extract.extract(events(spark, sf_dir), [EVENTS], forced="log")
    return e.lists("types").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("text").alias("last_type"))


def open_list_ends(spark, sf_dir):
    """Document sheets: the open range ends at the first blank line, the bounded one keeps inner gaps."""
    e = extract.extract(melt.document_books(spark, sf_dir), [LINES], forced="text")
    return e.lists().groupBy("doc_id").agg(F.count_if(F.col("field") == "top").alias("top"), F.count_if(F.col("field") == "block").alias("block"), F.count_if((F.col("field") == "block") & F.col("kind").isNull()).alias("gaps"))


def rule_mining(spark, sf_dir):
    e = orders(spark, sf_dir)
    return coverage.mine_rules(e.slices_of("customer", "total", "n_lines", "quantities"), ["version", "field"])


def rule_mining_by_document(spark, sf_dir):
    e = orders(spark, sf_dir)
    return coverage.mine_rules(e.slices_of("quantities"), ["doc_id"]).select("doc_id", "min", "max")


def flatten_long(spark, sf_dir):
    rows = orders(spark, sf_dir).results("orders", "v2.0", ["info"]).select("doc_id", "customer", "n_lines", "info", "quantities")
    return coverage.flatten(rows).filter("value IS NOT NULL")


def union_columns(spark, sf_dir):
    return coverage.union_columns(coverage.flatten(orders(spark, sf_dir).results("orders", "v1.0", []).select("doc_id", "customer", "quantities")))


def slugs(spark, sf_dir):
    return melt.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.slugify(F.coalesce("text", F.lit(""))).alias("slug"))


def clean_labels(spark, sf_dir):
    return melt.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_label(F.concat(F.coalesce("text", F.lit("")), F.lit(" :*"))).alias("label"))


def label_predicates(spark, sf_dir):
    lines = melt.document_books(spark, sf_dir).cells.select("text")
    t = F.col("text")
    return lines.agg(F.count("*").alias("n"), F.count_if(text.is_label(t)).alias("labels"), F.count_if(text.is_header(t)).alias("headers"), F.count_if(text.is_data_like(t)).alias("data"), F.count_if(text.is_identifier(t)).alias("identifiers"), F.count_if(text.section_title(t).isNotNull()).alias("titles"))


def value_types(spark, sf_dir):
    cells = melt.event_books(spark, sf_dir).cells
    return cells.groupBy("col", text.value_type(F.col("kind"), F.col("text")).alias("type")).agg(F.count("*").alias("n"))


def header_footer_split(spark, sf_dir):
    raw = F.concat(F.lit('&"Arial,Bold"&L'), "role", F.lit("&C&12 "), F.col("conv_id"), F.lit("&&"), F.lit("&R&KFF0000"), F.col("turn"))
    rows = melt.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.header_footer_sections(raw).alias("s"))
    return rows.select("conv_id", "turn", "s.left", "s.center", "s.right")


def row_runs(spark, sf_dir):
    return discover.row_runs(melt.event_books(spark, sf_dir).cells).groupBy("doc_id", "start_col", "end_col").agg(F.count("*").alias("n"))


def table_depth(spark, sf_dir):
    cells = cut(melt.event_books(spark, sf_dir).cells, "event-cells")
    return discover.table_depth(cells, discover.row_runs(cells)).select("doc_id", "row", F.col("depth").cast("int").alias("depth"))


def linear_depth(spark, sf_dir):
    cells = melt.document_books(spark, sf_dir).cells
    return discover.linear_depth(cells).groupBy("doc_id").agg(F.max("down_depth").cast("long").alias("deepest"), F.sum("down_depth").alias("total"))


def distinct_headers(spark, sf_dir):
    events = melt.event_books(spark, sf_dir).cells.filter("col = 1")
    return discover.distinct_headers(events.select("doc_id", "sheet", F.lit(1).alias("row"), F.col("row").alias("col"), "text")).select("doc_id", "col", "name")


def header_row_choice(spark, sf_dir):
    return discover.header_row(melt.event_books(spark, sf_dir).cells).select("doc_id", "row", F.col("score").cast("long").alias("score"))


def field_suggestions(spark, sf_dir):
    found = discover.suggest_fields(orders(spark, sf_dir).books.cells)
    return found.select("doc_id", "sheet", "sheet_idx", "name", "label", "axis", "row", "col", "type", "score")


def table_suggestions(spark, sf_dir):
    return _shown(discover.suggest_tables(orders(spark, sf_dir).books.cells))


def _shown(tables: DataFrame) -> DataFrame:
    return tables.withColumn("headers", F.array_join("headers", ",")).drop("turn", "columns", "reasons")


def scan_suggestions(spark, sf_dir):
    return discover.corpus_suggestions(discover.scan_suggestions(orders(spark, sf_dir).books.cells)).withColumn("mean_score", F.round("mean_score", 4))


def fingerprints(spark, sf_dir):
    e = orders(spark, sf_dir)
    return drift.fingerprints(e.slices_of("quantities")).select("doc_id", F.array_join("samples", ",").alias("samples"))


def match_score(spark, sf_dir):
    e = orders(spark, sf_dir)
    marks = drift.fingerprints(e.slices_of("quantities"))
    later = F.concat(F.slice("samples", 2, 7), F.array(F.lit("")))
    return marks.select("doc_id", F.round(drift.match_score(F.col("samples"), later), 6).alias("score"))


def remap_cells(spark, sf_dir):
    e = orders(spark, sf_dir)
    wanted = e.slices_of("customer", version="v2.0").select("doc_id", "schema", "version", "field", F.col("text").alias("value"), F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_idx"), "row", "col")
    moved = e.books.cells.withColumn("row", F.col("row") + 2)
    return drift.moved_cells(wanted, moved).select("doc_id", "ref", F.round("confidence", 6).alias("confidence"))


def remap_ranges(spark, sf_dir):
    e = orders(spark, sf_dir)
    marks = drift.fingerprints(e.slices_of("quantities", version="v1.0")).withColumns({"sheet": F.lit("Sheet1"), "row": F.lit(2), "col": F.lit(3), "width": F.lit(1)})
    moved = e.books.cells.withColumn("row", F.col("row") + 2)
    return drift.votes_on_moves(drift.moved_ranges(marks, moved))


def moved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late order sheets with all cells two rows down: where two of their fields went."""
    e = orders(spark, sf_dir)
    marks = drift.fingerprints(e.slices_of("customer", "quantities", version="v2.0"))
    places = spark.createDataFrame([("customer", "Sheet1", 0, 3, 2, 1, 3, False), ("quantities", "Sheet1", 0, 5, 4, 1, None, True)], "field string, sheet string, sheet_idx int, row int, col int, width int, end_row int, is_open boolean")
    return drift.find_remaps(marks.join(F.broadcast(places), "field"), e.books.cells.withColumn("row", F.col("row") + 2))


def find_remaps(spark, sf_dir):
    shown = drift.remap_suggestions(moved_fields(spark, sf_dir))
    return shown.select("doc_id", "name", "ref", F.round("score", 6).alias("score"))


def applied_moves(spark, sf_dir):
    fields = drift.apply_moves(fields_table(spark, [ORDERS]), drift.accepted_moves(moved_fields(spark, sf_dir)))
    return fields.filter("start_row IS NOT NULL").select("version", "field", "start_row", "start_col", F.coalesce("end_row", F.lit(0)).alias("end_row"), "end_col")


def field_names(spark, sf_dir):
    books = orders(spark, sf_dir).books
    picked = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(w).alias("is_range")) for r, c, w in ((10, 2, False), (41, 3, True), (41, 1, False))]))
    chosen = books.docs.select("doc_id", F.lit("Sheet1").alias("sheet"), picked.alias("p")).select("doc_id", "sheet", "p.*")
    return naming.field_names(chosen, books.cells, spark.createDataFrame([("order_priority",), ("customer",)], "name string")).drop("sheet")


def _blocks(spark: SparkSession, sf_dir: str, row: int, end_row: int, end_col: int) -> DataFrame:
    return orders(spark, sf_dir).books.docs.select("doc_id", F.lit("Sheet1").alias("sheet"), *[F.lit(v).alias(n) for n, v in (("row", row), ("col", 1), ("end_row", end_row), ("end_col", end_col))])


def column_naming(spark, sf_dir):
    books = orders(spark, sf_dir).books
    return naming.column_names(_blocks(spark, sf_dir, 39, 45, 4), books.cells, books.merges).select("doc_id", "letters", "name")


def row_naming(spark, sf_dir):
    return naming.row_names(_blocks(spark, sf_dir, 10, 15, 2), orders(spark, sf_dir).books.cells).select("doc_id", "at", "name")


def header_promotion(spark, sf_dir):
    return naming.promoted_headers(_blocks(spark, sf_dir, 41, 45, 4), orders(spark, sf_dir).books.cells).select("doc_id", "row", "promoted")


def version_guess(spark, sf_dir):
    return naming.guessed_versions(orders(spark, sf_dir).books.cells, [(None, 1, 1), ("Sheet1", 3, 2)])


def first_page_edge(spark, sf_dir):
    talk = melt.read(spark, sf_dir, "conversations")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("turn", F.lit(len(names))) + 1).cast("int"))
    edges = talk.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("Sheet1").alias("sheet"), pick("footer", "header").alias("kind"), pick("even", "first", "odd").alias("page"), pick("right", "center", "left").alias("section"), F.when(F.col("turn") > 0, F.col("role")).otherwise(" ").alias("text"))
    return naming.first_edges(edges).select("doc_id", "kind", "page", "section")


def typed_dict(spark, sf_dir):
    e = extract.extract(melt.event_books(spark, sf_dir), [TALLY], forced="log")
    return e.results("tally", "log").select("doc_id", F.explode("props").alias("key", "value"))


def rendered_values(spark, sf_dir):
    rows = orders(spark, sf_dir).results("orders", "v2.0", ["info"]).select("doc_id", (F.col("n_lines") > 3).alias("long"), "n_lines", "info", F.transform("quantities", lambda q: q.cast("long")).alias("whole"))
    return coverage.render(rows)


def titled_tables(spark, sf_dir):
    """Late order sheets with a title two rows above their table."""
    cells = orders(spark, sf_dir).books.cells
    titles = cells.filter("row = 40 AND col = 1").withColumns({"row": F.lit(38), "text": F.lit("Table 1: Order lines")})
    return _shown(discover.suggest_titled_tables(cells.unionByName(titles)))


def hidden_runs(spark, sf_dir):
    """Event sheets whose columns C and F to H are hidden and whose C is empty: runs go on over them."""
    cells = melt.event_books(spark, sf_dir).cells.filter("col <> 3")
    wide = cells.filter("row = 1 AND col = 1").withColumn("col", F.lit(7))
    spans = cells.select("doc_id", "sheet").distinct().withColumn("s", F.explode(F.array(F.struct(F.lit(3).alias("left"), F.lit(3).alias("right")), F.struct(F.lit(6).alias("left"), F.lit(8).alias("right"))))).select("doc_id", "sheet", "s.*")
    return discover.row_runs(cells.unionByName(wide), spans).groupBy("doc_id", "start_col", "end_col").agg(F.count("*").alias("n"))


def unmapped_suggestions(spark, sf_dir):
    """Table proposals on the order sheets, less what their template maps from the row of the table on, or names."""
    found = discover.suggest_tables(orders(spark, sf_dir).books.cells)
    mapped = fields_table(spark, [ORDERS]).filter("version = 'v2.0' AND field IN ('customer', 'info')")
    free = discover.clear_of_mapped(found, mapped)
    taken = discover.clear_of_mapped(found, fields_table(spark, [ORDERS]).filter("version = 'v2.0'"))
    return free.select("doc_id", F.lit("free").alias("kind")).unionByName(taken.select("doc_id", F.lit("taken").alias("kind")))


def incremental_ingest(spark, sf_dir):
    """The order workbooks as a stream of cell files, taken in two calls: table cells as a batch job reads them."""
    cells, base = orders(spark, sf_dir).books.cells, new_path(spark, "stream")
    arriving, out, seen = f"{base}/in", f"{base}/out", f"{base}/seen"
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    for part in (cells.filter(~late), cells.filter(late)):
        part.repartition("doc_id").write.mode("append").parquet(arriving)
        ingest.ingest_cells(spark, arriving, [ORDERS], out, seen)
    got = ingest.results(spark, out, "tables").filter("name = 'price'")
    return got.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.round(F.sum("num"), 2).alias("total"))


def version_markers(spark, sf_dir):
    """Order sheets with a version label in A2 and the version beside it."""
    e = orders(spark, sf_dir)
    docs = e.resolved.select("doc_id", F.lit("").alias("path"), "version")
    marks = melt.to_cells(docs, F.array(melt.cell(2, 1, "s", F.lit("Template version:")), melt.cell(2, 2, "s", F.col("version"))))
    return discover.suggest_discriminators(e.books.cells.unionByName(marks)).drop("sheet", "sheet_idx", "turn", "reasons")


def serial_dates(spark, sf_dir):
    rows = melt.read(spark, sf_dir, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + (F.col("o_orderkey") % 4) / 4
    return rows.select("o_orderkey", F.date_format(dates.serial_date(serial.cast("double")), "yyyy-MM-dd HH:mm").alias("at"))


def number_formats(spark, sf_dir):
    """A sheet an order with its date as a plain number, shown by one of six number formats."""
    part = (F.expr("o_orderkey div 6") % 8) / 8
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    codes = F.array(*map(F.lit, ("yyyy\\-mm\\-dd", "[h]:mm", "0.00", "[Red]0;d", '0" days"', "h:mm AM/PM")))
    which = F.col("o_orderkey") % 6
    rows = melt.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("Sheet1").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("f").alias("kind"), F.lit("raw").alias("text"), (F.when(which == 5, 0).otherwise(day) + part).alias("num"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.element_at(codes, which.cast("int") + 1).alias("format"))
    rows = cut(rows, "formatted")
    return grid.dated(rows.drop("format"), rows).select("doc_id", "kind", "text", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.round("num", 3).alias("num"))


def resumed_batch(spark, sf_dir):
    """A batch that halted at its first document without the version, then went on from there."""
    e = orders(spark, sf_dir)
    early = e.resolved.withColumn("version", F.when(F.col("version") == "v1.0", F.col("version")))
    done = extract.halted(early, e.books.docs)
    halt = done.filter("halted").select(F.col("path").alias("halt"))
    again = e.books.docs.join(F.broadcast(halt), F.col("path") >= F.col("halt")).select("path", F.lit("again").alias("state"))
    return extract.resumed(done.select("path", F.when(F.col("halted"), "error").otherwise("earlier").alias("state")), again)


def merged_fill(spark, sf_dir):
    """Late order sheets whose total is merged over E3 to G3."""
    books = orders(spark, sf_dir).books
    merges = books.docs.select("doc_id", F.lit("Sheet1").alias("sheet"), *[F.lit(v).alias(n) for n, v in (("top", 3), ("left", 5), ("bottom", 3), ("right", 7))])
    filled = grid.fill_merges(replace(books, merges=merges)).cells
    return filled.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if((F.col("row") == 3) & (F.col("col") >= 5)).alias("wide"), F.round(F.sum(F.when((F.col("row") == 3) & (F.col("col") >= 5), F.col("num"))), 2).alias("total"))


def edge_fields(spark, sf_dir):
    """Conversations whose first role stands in the page header."""
    talks = template({"name": "edged", "discriminator": {"cells": ["A1"]}, "versions": {"v": {"fields": {"who": {"cell": "header:left"}, "none": {"cell": "footer:even:right"}}}}})
    books = melt.conversation_books(spark, sf_dir)
    edges = books.cells.filter("row = 1 AND col = 1").select("doc_id", "sheet", "sheet_idx", F.lit("header").alias("kind"), F.lit("odd").alias("page"), F.lit("left").alias("section"), "text")
    return extract.extract(replace(books, edges=edges), [talks], forced="v").results("edged", "v").filter("who IS NOT NULL").select("doc_id", "who", F.col("none").isNull().alias("no_footer"))


def json_sink(spark, sf_dir):
    e = orders(spark, sf_dir)
    named = [e.records("orders", v, []).select("doc_id", "customer") for v in ("v1.0", "v2.0")]
    return sinks.json_lines(named[0].unionByName(named[1]), e.failures(), e.books.docs)


def provenance(spark, sf_dir):
    e = orders(spark, sf_dir)
    return sinks.with_provenance(e.records("orders", "v2.0", []).select("doc_id", "n_lines"), e.resolved, e.books.docs)


def wide_values(spark, sf_dir):
    flat = coverage.flatten(orders(spark, sf_dir).results("orders", "v2.0", ["info"]).select("doc_id", "customer", "n_lines", "info"))
    return coverage.wide(flat, ["customer", "n_lines", "info.priority"]).withColumnRenamed("info.priority", "priority")


def long_sheet(spark, sf_dir):
    """All orders as one sheet, a row an order, every 9001st row empty: its open range ends before the first empty row."""
    rows = melt.read(spark, sf_dir, "orders").filter("o_orderkey % 9001 <> 9000").withColumns({"doc_id": F.lit("all"), "path": F.lit("all.xlsx")})
    first = rows.agg(F.min("o_orderkey").alias("least"))
    at = (F.col("o_orderkey") - F.col("least") + 1).cast("int")
    rows = rows.crossJoin(F.broadcast(first))  # one row
    cells = melt.to_cells(rows, F.array(melt.cell(at, 1, "s", F.col("o_orderpriority")), melt.cell(at, 2, "f", F.col("o_totalprice"))))
    sheet = template({"name": "long", "discriminator": {"cells": ["Z1"]}, "versions": {"v": {"fields": {"rows": {"range": "A1:B", "type": "table", "columns": {"A": "priority", "B": "price"}}}}}})
    books = grid.from_cells(cells, docs=spark.createDataFrame([("all", "all.xlsx")], grid.DOCS))
    resolved = detect.detect_versions(books, [sheet], forced="v")
    found = slices.slices(books, resolved, fields_table(spark, [sheet]))
    return found.groupBy("col").agg(F.count("*").alias("n"), F.max("row").cast("long").alias("last_row"), F.round(F.sum(F.coalesce("num", F.lit(0.0))), 2).alias("total"))


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A version a customer, extending the one with half its number; every 97th goes in a circle, every 101st extends what isn't there. Two fields each."""
    people = melt.read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    up = F.when(key % 97 == 0, key).when(key % 101 == 0, -key).when(key > 1, F.floor(key / 2))
    versions = people.select(F.lit("crm").alias("schema"), key.cast("string").alias("version"), up.cast("string").alias("extends"))
    fields = people.select(F.lit("crm").alias("schema"), key.cast("string").alias("version"), F.explode(F.array(F.struct(F.lit(0).alias("field_ord"), F.lit("balance").alias("field"), (key % 50 + 1).cast("int").alias("start_row")), F.struct(F.lit(1).alias("field_ord"), F.lower(F.concat(F.lit("seg_"), F.substring("c_mktsegment", 1, 4))).alias("field"), F.col("c_nationkey").cast("int").alias("start_row")))).alias("f")).select("schema", "version", "f.*")
    return versions, fields


def template_registry(spark, sf_dir):
    found, _ = registry.resolve(*_registry(spark, sf_dir))
    return found.select("version", "field", F.col("place").cast("long").alias("place"), "origin", "start_row")


def registry_errors(spark, sf_dir):
    return registry.resolve(*_registry(spark, sf_dir))[1].drop("schema")


def wide_found(spark, sf_dir):
    """Flat results as a wide table whose columns come from the data."""
    flat = coverage.flatten(orders(spark, sf_dir).results("orders", "v2.0", ["info"]).select("doc_id", "n_lines", "info"))
    rows, is_wide = coverage.wide_or_long(flat)
    assert is_wide
    return rows.withColumnsRenamed({c: c.replace("info.", "info_") for c in rows.columns})


def halted_stream(spark, sf_dir):
    """Order workbooks as a stream in three batches that stops at the first unmatched one, and goes on with a template that knows it."""
    cells, base = orders(spark, sf_dir).books.cells, new_path(spark, "halted")
    arriving, out, seen = f"{base}/in", f"{base}/out", f"{base}/seen"
    early = template({"name": "early", "discriminator": {"cells": ["A1"]}, "versions": {"v1.0": {"fields": {"customer": {"cell": "A3"}}}}})
    late = template({"name": "late", "discriminator": {"cells": ["A1"]}, "versions": {"v2.0": {"fields": {"customer": {"cell": "B3"}}}, "": {"fields": {"customer": {"cell": "B3"}}}}})
    batch = F.when(F.col("path") < "orders/F/5", 0).when(F.col("path") < "orders/O/5", 1).otherwise(2)
    for k in range(3):
        cells.filter(batch == k).repartition("doc_id").write.mode("append").parquet(arriving)
        ingest.ingest_cells(spark, arriving, [early], out, seen, stop_on_unmatched=True)
    before = cut(ingest.file_states(spark, out).groupBy("state").agg(F.count("*").alias("n")).withColumn("at", F.lit("halt")), "halted-states")
    assert ingest.go_on(spark, [early, late], out) is None
    values = ingest.results(spark, out, "values").groupBy(F.col("schema").alias("state")).agg(F.count("*").alias("n"))
    return before.select("at", "state", "n").unionByName(values.select(F.lit("values").alias("at"), "state", "n")).unionByName(ingest.file_states(spark, out).groupBy("state").agg(F.count("*").alias("n")).select(F.lit("end").alias("at"), "state", "n"))


def capture_store(spark, sf_dir):
    """Captures of every order's status as a stream, the later batch first and one batch twice: the store keeps each version's latest."""
    base = new_path(spark, "captures")
    rows = melt.read(spark, sf_dir, "orders").select(F.lit("orders").alias("schema"), F.concat(F.lit("v"), F.col("o_custkey") % 20).alias("version"), F.year("o_orderdate").cast("long").alias("captured_at"), F.col("o_orderkey").cast("string").alias("field"))
    late = F.col("captured_at") >= 1995
    for part in (rows.filter(late), rows.filter(~late), rows.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        ingest.keep_captures(spark, f"{base}/in", rows.schema.simpleString()[7:-1].replace(":", " "), f"{base}/store", f"{base}/seen")
    return spark.read.parquet(f"{base}/store").groupBy("version").agg(F.max("captured_at").alias("captured_at"), F.countDistinct("field").alias("n"))


def version_tables(spark, sf_dir):
    """Records of both order versions, a table each, the later in two batches whose columns differ; read back together."""
    e, base = orders(spark, sf_dir), new_path(spark, "records")
    late = e.records("orders", "v2.0", []).select("doc_id", "customer", "total", "n_lines")
    half = F.pmod(F.col("doc_id").cast("long"), F.lit(2)) == 0
    sinks.write_records(late.filter(half).drop("n_lines"), "orders", "v2.0", base)
    sinks.write_records(late.filter(~half), "orders", "v2.0", base)
    sinks.write_records(e.records("orders", "v1.0", []).select("doc_id", "customer", F.size("quantities").cast("string").alias("n_lines")), "orders", "v1.0", base)
    rows = sinks.read_all_records(spark, [("orders", "v1.0"), ("orders", "v2.0")], base)
    return rows.select("version", "doc_id", F.coalesce("customer", F.lit("")).alias("customer"), F.round("total", 2).alias("total"), "n_lines")


def merged_columns(spark, sf_dir):
    """Event sheets whose column G is merged from the first row down to the sheet's format's end, filled in the rows that have events."""
    books = grid.from_cells(melt.event_books(spark, sf_dir).cells)
    top = books.cells.filter("row = 1 AND col = 1").withColumn("col", F.lit(7))
    merges = top.select("doc_id", "sheet", F.lit(1).alias("top"), F.lit(7).alias("left"), F.lit(1_048_576).alias("bottom"), F.lit(7).alias("right"))
    merged = replace(books, cells=books.cells.unionByName(top), merges=merges)
    return grid.merged_cells(merged, books.cells.select("doc_id", "sheet", "row")).groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.max("row").cast("long").alias("last_row"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    order_totals, scalar_fields, open_range_list, dict_field, table_header, table_columns, version_by_discriminator, checked_cells, version_by_layout, ambiguous_layout, multi_template,
    forced_version, computed_fields, rule_failures, batch_summary, halt_resume, coerce_strict, coerce_lenient, col_letters, parse_refs, conversation_table, event_table, table_vertical,
    first_column_only, open_list_ends, rule_mining, rule_mining_by_document, flatten_long, union_columns, slugs, clean_labels, label_predicates, value_types, header_footer_split, row_runs,
    table_depth, linear_depth, distinct_headers, header_row_choice, field_suggestions, table_suggestions, scan_suggestions, fingerprints, match_score, remap_cells, remap_ranges, incremental_ingest,
    find_remaps, applied_moves, field_names, column_naming, row_naming, header_promotion, version_guess, first_page_edge, typed_dict, rendered_values, titled_tables, hidden_runs, unmapped_suggestions,
    version_markers, serial_dates, number_formats, resumed_batch, merged_fill, edge_fields, json_sink, provenance, wide_values,
    long_sheet, template_registry, registry_errors, wide_found, halted_stream, capture_store, version_tables, merged_columns,
)}

_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem"
_EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, try_cast(regexp_extract(props, '\"[^\"]+\"\\s*:\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events"
_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS r FROM documents"
_BARE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_UNTITLED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i)^table\s+[0-9]+\s*:\s*', ''), '(?i)^section\s+[0-9]+\s*:\s*', ''), '[:*]+$', ''), '\s+', ' ', 'g')"
_SLUG = r"regexp_replace(regexp_replace(translate(lower({0}), '()µ', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_COUNTS = "SELECT o.*, coalesce(l.k, 0) AS k FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"
_LABEL = r"(t <> '' AND length(t) <= 48 AND NOT regexp_matches(t, '[<>=%]|(?i:[0-9](\.[0-9]+)?e[+-]?[0-9]+)|^[0-9]+([./-][0-9]+)*$') AND len(regexp_split_to_array(t, '\s+')) <= 6 AND regexp_matches(t, '(?i)[a-z]'))"
_IDENT = r"(length(t) <= 64 AND regexp_matches(t, '(?i)[a-z]') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '(?i)^[a-z0-9._/\- ]+$'))"
_DATA = rf"(regexp_matches(t, '^[0-9]|(?i:^(nq|nd|lod)[<>])') OR (NOT regexp_matches(t, '\s') AND ({_IDENT} OR regexp_matches(t, '(?i)^[A-Z0-9._-]{{7,}}$'))))"
_STATUS = "upper(t) IN ('OK', 'NQ', 'CC', 'PASS', 'FAIL', 'NO', 'YES', 'NQ, CC')"

_LATE = f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o.*, c_name, c_mktsegment FROM ({_COUNTS}) o LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'"
_SAMPLES = f"SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS d FROM ({_NUMBERED}) WHERE n <= 8 GROUP BY 1"

ORACLE_SQL: dict[str, str] = {
    "scan_suggestions": f"""
        WITH late AS ({_LATE}), t AS (SELECT k, CASE WHEN k >= 4 THEN 0.94 WHEN k = 3 THEN 0.88 ELSE 0.8 END AS score FROM late WHERE k > 1),
        early AS (SELECT l_orderkey, count(*) AS k, max(CASE WHEN n = 1 THEN lower(l_returnflag) END) AS name FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT 'table' AS kind, 'part_table' AS name, 'Sheet1' AS sheet, 'A40:D' AS ref, count(*) AS n_docs, CAST(round(avg(score), 4) AS DOUBLE) AS mean_score FROM t HAVING count(*) > 0
        UNION ALL SELECT 'field', name, 'Sheet2', 'Sheet2!D2:D' || k, count(*), CAST(CASE WHEN k >= 6 THEN 0.78 ELSE 0.74 END AS DOUBLE) FROM early WHERE k >= 4 GROUP BY name, k
    """,
    "long_sheet": """
        WITH o AS (SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 9001 <> 9000) + 1 AS r, o_totalprice FROM orders WHERE o_orderkey % 9001 <> 9000),
        d AS (SELECT r, count(*) AS c, sum(o_totalprice) AS s FROM o GROUP BY r), p AS (SELECT *, row_number() OVER (ORDER BY r) AS k FROM d),
        e AS (SELECT max(r) AS last FROM p WHERE r = k)
        SELECT col, sum(c)::BIGINT AS n, max(r) AS last_row, CAST(CASE WHEN col = 1 THEN 0 ELSE round(sum(s), 2) END AS DOUBLE) AS total FROM p, e, (VALUES (1), (2)) c(col) WHERE r <= last GROUP BY col
    """,
    "template_registry": """
        WITH RECURSIVE v AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN c_custkey WHEN c_custkey % 101 = 0 THEN -c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS up FROM customer),
        a AS (SELECT k, k AS a, 0 AS d FROM v UNION SELECT a.k, v.up, d + 1 FROM a JOIN v ON v.k = a.a WHERE v.up IS NOT NULL AND v.up <> v.k),
        bad AS (SELECT DISTINCT a.k FROM a LEFT JOIN v ON v.k = a.a WHERE v.k IS NULL OR v.up = v.k),
        f AS (SELECT c_custkey AS o, unnest([0, 1]) AS ord, unnest(['balance', lower('seg_' || substr(c_mktsegment, 1, 4))]) AS field, unnest([c_custkey % 50 + 1, c_nationkey]) AS start_row FROM customer),
        x AS (SELECT a.k, a.a, a.d, f.field, f.ord, f.start_row, row_number() OVER (PARTITION BY a.k, f.field ORDER BY a.d) AS turn, first_value(a.d) OVER w AS fd, first_value(f.ord) OVER w AS fo FROM a JOIN f ON f.o = a.a WHERE a.k NOT IN (SELECT k FROM bad) WINDOW w AS (PARTITION BY a.k, f.field ORDER BY a.d DESC, f.ord))
        SELECT CAST(k AS VARCHAR) AS version, field, row_number() OVER (PARTITION BY k ORDER BY fd DESC, fo) - 1 AS place, CAST(a AS VARCHAR) AS origin, CAST(start_row AS INTEGER) AS start_row FROM x WHERE turn = 1
    """,
    "registry_errors": """
        WITH RECURSIVE v AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN c_custkey WHEN c_custkey % 101 = 0 THEN -c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS up FROM customer),
        a AS (SELECT k, k AS a FROM v UNION SELECT a.k, v.up FROM a JOIN v ON v.k = a.a WHERE v.up IS NOT NULL AND v.up <> v.k)
        SELECT CAST(a.k AS VARCHAR) AS version, CASE WHEN v.k IS NULL THEN 'unknown parent' ELSE 'cycle' END AS error FROM a LEFT JOIN v ON v.k = a.a WHERE v.k IS NULL OR v.up = v.k
    """,
    "wide_found": f"SELECT doc_id, CAST(k AS VARCHAR) AS n_lines, o_orderpriority AS info_priority, c_mktsegment AS info_segment, o_orderstatus AS info_status FROM ({_LATE})",
    "halted_stream": """
        WITH p AS (SELECT 'orders/' || o_orderstatus || '/' || o_orderkey || '.xlsx' AS path, o_orderstatus, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey), h AS (SELECT min(path) AS halt FROM p WHERE o_orderstatus <> 'F')
        SELECT 'halt' AS at, CASE WHEN path < halt OR halt IS NULL THEN 'done' WHEN path = halt THEN 'halt' ELSE 'held' END AS state, count(*) AS n FROM p, h GROUP BY ALL
        UNION ALL SELECT 'end', 'done', count(*) FROM p UNION ALL SELECT 'values', CASE o_orderstatus WHEN 'F' THEN 'early' ELSE 'late' END, count(*) FROM p WHERE c_name IS NOT NULL GROUP BY ALL
    """,
    "capture_store": "WITH c AS (SELECT 'v' || (o_custkey % 20) AS version, year(o_orderdate) AS y, o_orderkey FROM orders), m AS (SELECT version, max(y) AS y FROM c GROUP BY 1) SELECT version, m.y AS captured_at, count(DISTINCT o_orderkey) AS n FROM m JOIN c USING (version) WHERE c.y = m.y GROUP BY ALL",
    "version_tables": f"""
        WITH h AS (SELECT o.*, c_name FROM ({_COUNTS}) o LEFT JOIN customer ON o_custkey = c_custkey)
        SELECT 'v2.0' AS version, CAST(o_orderkey AS VARCHAR) AS doc_id, coalesce(c_name, '') AS customer, CAST(round(o_totalprice, 2) AS DOUBLE) AS total, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS n_lines FROM h WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000
        UNION ALL SELECT 'v1.0', CAST(o_orderkey AS VARCHAR), coalesce(c_name, ''), NULL, CAST(k AS VARCHAR) FROM h WHERE o_orderstatus = 'F'
    """,
    "merged_columns": f"SELECT CAST(user_id AS VARCHAR) AS doc_id, max(CASE WHEN n = 1 THEN event_type END) AS text, count(*) - 1 AS n, max(n) AS last_row FROM ({_EVENTS}) GROUP BY user_id HAVING count(*) > 1 AND max(CASE WHEN n = 1 THEN event_type END) IS NOT NULL",
    "version_markers": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'Template version:' AS label, 2 AS row, 2 AS col, CASE o_orderstatus WHEN 'F' THEN 'v1.0' ELSE 'v2.0' END AS value, CAST(0.77 AS DOUBLE) AS score FROM orders",
    "serial_dates": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_hours(CAST(6 * (o_orderkey % 4) AS INTEGER)), '%Y-%m-%d %H:%M') AS at FROM orders",
    "number_formats": """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey % 6 AS f, CAST(3 * ((o_orderkey // 6) % 8) AS INTEGER) AS h, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS n FROM orders)
        SELECT doc_id, CASE f WHEN 0 THEN 't' WHEN 1 THEN 's' WHEN 5 THEN 's' ELSE 'f' END AS kind,
        CASE f WHEN 0 THEN strftime(d + to_hours(h), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN n || ' days, ' || h || ':00:00' WHEN 5 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':00:00' ELSE 'raw' END AS text,
        CASE f WHEN 0 THEN strftime(d + to_hours(h), '%Y-%m-%d %H:%M') END AS at, CASE WHEN f BETWEEN 2 AND 4 THEN round(n + h / 24.0, 3) END AS num FROM r""",
    "resumed_batch": "WITH p AS (SELECT 'orders/' || o_orderstatus || '/' || o_orderkey || '.xlsx' AS path, o_orderstatus FROM orders), h AS (SELECT min(path) AS halt FROM p WHERE o_orderstatus <> 'F') SELECT path, CASE WHEN halt IS NULL OR path < halt THEN 'earlier' ELSE 'again' END AS state FROM p, h",
    "merged_fill": f"WITH h AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus, o_totalprice, k, c_name, c_mktsegment FROM ({_COUNTS}) LEFT JOIN customer ON o_custkey = c_custkey) SELECT doc_id, CASE WHEN o_orderstatus = 'F' THEN 1 + CASE WHEN c_name IS NULL THEN 0 ELSE 1 END + 5 * k ELSE 15 + CASE WHEN c_name IS NULL THEN 0 ELSE 1 END + CASE WHEN c_mktsegment IS NULL THEN 0 ELSE 1 END + 5 * k END AS n, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END AS wide, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE round(3 * o_totalprice, 2) END AS total FROM h",
    "edge_fields": "SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS who, TRUE AS no_footer FROM conversations WHERE turn = 0 AND role IS NOT NULL",
    "json_sink": f"WITH h AS (SELECT o.*, c_name, 'orders/' || o_orderstatus || '/' || o_orderkey || '.xlsx' AS path FROM orders o LEFT JOIN customer ON o_custkey = c_custkey) SELECT path, '{{\"file\":\"' || path || CASE WHEN o_orderstatus <> 'F' AND o_totalprice < 50000 THEN '\",\"error\":\"total: min\"}}' WHEN c_name IS NULL THEN '\",\"data\":{{}}}}' ELSE '\",\"data\":{{\"customer\":\"' || c_name || '\"}}}}' END AS value FROM h",
    "provenance": f"SELECT doc_id, o_orderkey || '.xlsx' AS _source_file, 'orders/' || o_orderstatus || '/' || o_orderkey || '.xlsx' AS _source_path, CASE o_orderstatus WHEN 'P' THEN '<inferred>' ELSE 'A1' END AS _discriminator_cell, k AS n_lines FROM ({_LATE}) WHERE o_totalprice >= 50000",
    "wide_values": f"SELECT doc_id, c_name AS customer, CAST(k AS VARCHAR) AS n_lines, o_orderpriority AS priority FROM ({_LATE})",
    "field_suggestions": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'Sheet1' AS sheet, 0 AS sheet_idx, 'priority' AS name, 'priority' AS label, 'horizontal' AS axis, 10 AS row, 2 AS col, 'str' AS type, CAST(0.71 AS DOUBLE) AS score FROM orders WHERE o_orderstatus <> 'F'",
    "table_suggestions": f"SELECT doc_id, 'Sheet1' AS sheet, 0 AS sheet_idx, 'part_table' AS name, 40 AS row, CAST(40 + k AS INTEGER) AS end_row, 1 AS start_col, 4 AS end_col, CAST(k AS INTEGER) AS depth, 'part,qty,price,flag' AS headers, CAST(CASE WHEN k >= 4 THEN 0.94 WHEN k = 3 THEN 0.88 WHEN k = 2 THEN 0.8 ELSE 0.76 END AS DOUBLE) AS score FROM ({_LATE}) WHERE k > 1",
    "titled_tables": f"SELECT doc_id, 'Sheet1' AS sheet, 0 AS sheet_idx, 'order_lines_table' AS name, 40 AS row, CAST(40 + k AS INTEGER) AS end_row, 1 AS start_col, 4 AS end_col, CAST(k AS INTEGER) AS depth, 'part,qty,price,flag' AS headers, CAST(CASE WHEN k >= 3 THEN 0.99 ELSE 0.94 END AS DOUBLE) AS score FROM ({_LATE}) WHERE k > 0",
    "unmapped_suggestions": f"SELECT doc_id, 'free' AS kind FROM ({_LATE}) WHERE k > 1",
    "hidden_runs": f"SELECT CAST(user_id AS VARCHAR) AS doc_id, 1 AS start_col, CASE WHEN n = 1 AND k IS NOT NULL THEN 7 WHEN k IS NOT NULL THEN 7 ELSE 3 END AS end_col, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL UNION ALL SELECT CAST(user_id AS VARCHAR), 7, 7, count(*) FROM ({_EVENTS}) WHERE n = 1 AND k IS NULL GROUP BY ALL",
    "remap_ranges": f"SELECT 'orders' AS schema, 'v1.0' AS version, 'quantities' AS field, 'C4:C' || (3 + n) AS ref, count(*) AS n_docs FROM ({_SAMPLES}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL",
    "find_remaps": f"SELECT doc_id, 'customer' AS name, 'B5' AS ref, CAST(round(1 - 2 / 120.0, 6) AS DOUBLE) AS score FROM ({_LATE}) WHERE c_name IS NOT NULL UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'quantities', CASE WHEN d >= 3 THEN 'D7:D' || (6 + n) ELSE 'D7:D' END, CAST(CASE WHEN d >= 3 THEN round(1 - 2 / 220.0, 6) ELSE 0.99 END AS DOUBLE) FROM ({_SAMPLES}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND n >= 2",
    "applied_moves": "SELECT * FROM (VALUES ('v2.0', 'customer', 5, 2, 5, 2), ('v2.0', 'order_date', 4, 2, 4, 2), ('v2.0', 'total', 3, 5, 3, 5), ('v2.0', 'n_lines', 4, 5, 4, 5), ('v2.0', 'info', 10, 1, 15, 2), ('v2.0', 'quantities', 7, 4, 0, 4), ('v2.0', 'lines', 40, 1, 0, 4), ('v1.0', 'customer', 3, 1, 3, 1), ('v1.0', 'quantities', 2, 3, 0, 3), ('v1.0', 'lines', 1, 1, 0, 4)) AS f(version, field, start_row, start_col, end_row, end_col)",
    "field_names": f"SELECT doc_id, unnest([10, 41, 41]) AS row, unnest([2, 3, 1]) AS col, unnest(['order_priority', 'price', 'part']) AS name FROM ({_LATE})",
    "column_naming": f"SELECT doc_id, unnest(['A', 'B', 'C', 'D']) AS letters, unnest(['part', 'qty', 'price', 'flag']) AS name FROM ({_LATE})",
    "row_naming": f"SELECT doc_id, unnest([10, 11, 12]) AS at, unnest(['priority', 'status', 'segment']) AS name FROM ({_LATE})",
    "header_promotion": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 41 ELSE 40 END AS row, o_orderstatus <> 'F' AS promoted FROM orders",
    "version_guess": f"SELECT doc_id, value FROM (SELECT doc_id, concat_ws(' ', CASE WHEN o_orderstatus = 'O' THEN 'v2.0' END, c_name) AS value FROM ({_LATE})) WHERE value <> '' UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'v1.0' FROM orders WHERE o_orderstatus = 'F'",
    "first_page_edge": """WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, CASE turn % 2 WHEN 0 THEN 'footer' ELSE 'header' END AS kind, CASE turn % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'first' ELSE 'odd' END AS page, CASE turn % 3 WHEN 0 THEN 'right' WHEN 1 THEN 'center' ELSE 'left' END AS section FROM conversations WHERE turn > 0 AND trim(role) <> '')
        SELECT doc_id, kind, page, section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind DESC, CASE page WHEN 'odd' THEN 0 WHEN 'first' THEN 1 ELSE 2 END, section = 'right', section = 'center') AS t FROM e) WHERE t = 1""",
    "typed_dict": f"WITH e AS (SELECT *, regexp_extract(props, '\"([^\"]+)\"\\s*:\\s*(-?\\d+)', 1) AS key FROM ({_EVENTS})), s AS (SELECT user_id, coalesce(min(n) FILTER (k IS NULL), max(n) + 1) AS stop FROM e GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS doc_id, key, arg_max(k, n) AS value FROM e JOIN s USING (user_id) WHERE n < stop GROUP BY 1, 2",
    "rendered_values": f"SELECT doc_id, CASE WHEN h.k > 3 THEN 'TRUE' ELSE 'FALSE' END AS long, CAST(h.k AS VARCHAR) AS n_lines, '{{\"priority\":\"' || o_orderpriority || '\",\"segment\":\"' || coalesce(c_mktsegment, '') || '\",\"status\":\"' || o_orderstatus || '\"}}' AS info, coalesce(w.whole, '[]') AS whole FROM ({_LATE}) h LEFT JOIN (SELECT l_orderkey, '[' || string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY n) || ']' AS whole FROM ({_NUMBERED}) GROUP BY 1) w ON w.l_orderkey = h.o_orderkey",
    "order_totals": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "incremental_ingest": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "scalar_fields": f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, c_name AS customer, o_totalprice AS total, k AS n_lines, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS ordered FROM ({_COUNTS}) LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'",
    "open_range_list": f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'v1.0' ELSE 'v2.0' END AS version, n - 1 AS pos, l_quantity AS quantity FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey",
    "dict_field": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, k AS key, v AS value FROM (SELECT o_orderkey, unnest(['priority', 'status', 'segment']) AS k, unnest([o_orderpriority, o_orderstatus, coalesce(c_mktsegment, '')]) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F')",
    "table_header": f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, n - 1 AS record, unnest(['part', 'qty', 'price', 'flag']) AS name, unnest([CAST(l_partkey AS DOUBLE), l_quantity, round(l_extendedprice, 2), 0]) AS num, unnest(['', '', '', l_returnflag]) AS word FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'",
    "table_columns": f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, n - 1 AS record, l_partkey AS part, l_quantity AS qty, round(l_extendedprice, 2) AS price, l_returnflag AS flag FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "version_by_discriminator": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'v1.0' ELSE 'v2.0' END AS version, CASE o_orderstatus WHEN 'P' THEN 'inference' ELSE 'discriminator' END AS matched_by, CASE o_orderstatus WHEN 'P' THEN '<inferred>' ELSE 'A1' END AS source FROM orders",
    "checked_cells": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS n, 'A1=' || CASE o_orderstatus WHEN 'F' THEN 'v1.0' WHEN 'O' THEN 'v2.0' ELSE '' END AS trail FROM orders",
    "version_by_layout": f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'v2.0' AS version, round(v * v / 7.0, 6) AS confidence FROM (SELECT o_orderkey, CASE WHEN c_name IS NULL THEN 0 ELSE 1 END + 3 + CASE WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END + CASE WHEN k > 0 THEN 2 ELSE 0 END AS v FROM ({_COUNTS}) LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')",
    "ambiguous_layout": "SELECT 'none' AS version, count(*) AS n FROM orders",
    "multi_template": "SELECT CASE o_orderstatus WHEN 'F' THEN 'early' ELSE 'orders' END AS schema, CASE o_orderstatus WHEN 'F' THEN 'v1.0' ELSE 'v2.0' END AS version, CASE o_orderstatus WHEN 'P' THEN 'inference' ELSE 'discriminator' END AS matched_by, count(*) AS n FROM orders GROUP BY ALL",
    "forced_version": "SELECT o_orderstatus = 'F' AS has_customer, count(*) AS n FROM orders GROUP BY 1",
    "computed_fields": f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, round(CASE WHEN k > 0 THEN o_totalprice / k ELSE 0 END, 4) AS per_line, coalesce(c_name, '') || ' ' || k AS label FROM ({_COUNTS}) LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'",
    "rule_failures": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'total' AS field, 'min' AS rule FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 50000",
    "batch_summary": "SELECT CASE WHEN o_orderstatus <> 'F' AND o_totalprice < 50000 THEN 'extraction_error' ELSE 'success' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "halt_resume": "WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'orders/' || o_orderstatus || '/' || o_orderkey || '.xlsx' AS path, o_orderstatus FROM orders), h AS (SELECT min(path) AS halt FROM p WHERE o_orderstatus <> 'F') SELECT doc_id, path, coalesce(path = halt, FALSE) AS halted FROM p, h WHERE halt IS NULL OR path <= halt",
    "coerce_strict": """SELECT 1 AS col, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS ints, 0 AS no_int, round(sum(CAST(l_partkey AS DOUBLE)), 2) AS floats, count(*) FILTER (l_partkey <> 0) AS truths, count(*) AS no_date FROM lineitem
        UNION ALL SELECT 2, count(*), CAST(sum(trunc(l_extendedprice)) AS BIGINT), 0, round(sum(l_extendedprice), 2), count(*) FILTER (l_extendedprice <> 0), count(*) FROM lineitem
        UNION ALL SELECT 3, count(*), NULL, count(*), NULL, count(*), count(*) FROM lineitem
        UNION ALL SELECT 4, count(*), CAST(sum(l_suppkey) AS BIGINT), 0, round(sum(CAST(l_suppkey AS DOUBLE)), 2), count(*), count(*) FROM lineitem
        UNION ALL SELECT 5, count(*), NULL, count(*), NULL, count(*), 0 FROM lineitem""",
    "coerce_lenient": """SELECT 1 AS col, CAST(sum(l_partkey) AS BIGINT) AS ints, count(*) FILTER (l_partkey <> 0) AS truths FROM lineitem
        UNION ALL SELECT 2, CAST(sum(trunc(l_extendedprice)) AS BIGINT), count(*) FILTER (l_extendedprice <> 0) FROM lineitem
        UNION ALL SELECT 3, NULL, count(*) FILTER (lower(l_returnflag) IN ('true', '1', 'yes', 'y')) FROM lineitem
        UNION ALL SELECT 4, CAST(sum(l_suppkey) AS BIGINT), count(*) FILTER (l_suppkey = 1) FROM lineitem
        UNION ALL SELECT 5, NULL, count(*) * 0 FROM lineitem""",
    "col_letters": "WITH i AS (SELECT DISTINCT CAST(l_partkey % 18277 + 1 AS INTEGER) AS idx FROM lineitem) SELECT idx, CASE WHEN idx > 702 THEN chr(CAST(64 + (idx - 703) // 676 + 1 AS INTEGER)) ELSE '' END || CASE WHEN idx > 26 THEN chr(CAST(65 + ((idx - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (idx - 1) % 26 AS INTEGER)) AS letters, idx AS back FROM i",
    "parse_refs": "SELECT CASE WHEN l_partkey % 3 = 0 THEN 'Sheet2' ELSE '' END AS sheet, count(*) AS n, CAST(sum(l_orderkey + 1) AS BIGINT) AS rows, CAST(sum(l_partkey % 700 + 1) AS BIGINT) AS cols, count(*) AS open_ranges FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "conversation_table": "SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn - first AS record, role, coalesce(text, '') AS text FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE first = 0 AND turn = n - 1",
    "event_table": f"SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS event, count(*) AS events, round(sum(value), 4) AS value, CAST(sum(k) AS BIGINT) AS n FROM ({_EVENTS}) GROUP BY 1, 2",
    "table_vertical": f"WITH e AS ({_EVENTS}), l AS (SELECT user_id, event_type, max(n) AS n FROM e GROUP BY ALL), d AS (SELECT user_id, bool_or(k IS NOT NULL) AS has FROM e GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(record AS BIGINT) AS record, event_type AS name, CASE record WHEN 0 THEN round(value, 6) WHEN 3 THEN CAST(k AS DOUBLE) END AS value FROM l JOIN e USING (user_id, event_type, n) JOIN d USING (user_id), (VALUES (0), (1), (2), (3)) r(record) WHERE record < 2 OR has",
    "first_column_only": "SELECT CAST(user_id AS VARCHAR) AS doc_id, count(*) AS n, max(event_type) AS last_type FROM events GROUP BY 1",
    "open_list_ends": f"""WITH l AS ({_LINES}), f AS (SELECT doc_id, r, trim(line) <> '' AS has FROM l), e AS (SELECT doc_id, coalesce(min(r) FILTER (NOT has), max(r) + 1) - 1 AS top, max(r) FILTER (has) AS last, count(*) FILTER (has) AS held FROM f GROUP BY 1)
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, top, coalesce(last, 0) AS block, coalesce(last, 0) - held AS gaps FROM e WHERE top > 0 OR last IS NOT NULL""",
    "rule_mining": f"""WITH h AS (SELECT o.*, c_name, CASE o_orderstatus WHEN 'F' THEN 'v1.0' ELSE 'v2.0' END AS version FROM ({_COUNTS}) o LEFT JOIN customer ON o_custkey = c_custkey)
        SELECT version, 'customer' AS field, TRUE AS required, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CASE WHEN bool_and(regexp_matches(c_name, '^[A-Za-z0-9_-]+$')) THEN '^[A-Za-z0-9_-]+$' END AS pattern FROM h WHERE c_name IS NOT NULL GROUP BY 1
        UNION ALL SELECT version, 'total', TRUE, min(o_totalprice), max(o_totalprice), NULL FROM h WHERE version = 'v2.0' GROUP BY 1
        UNION ALL SELECT version, 'n_lines', TRUE, CAST(min(k) AS DOUBLE), CAST(max(k) AS DOUBLE), NULL FROM h WHERE version = 'v2.0' GROUP BY 1
        UNION ALL SELECT version, 'quantities', TRUE, min(l_quantity), max(l_quantity), NULL FROM h JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "rule_mining_by_document": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "flatten_long": f"""WITH h AS (SELECT o.*, c_name, c_mktsegment, CAST(o_orderkey AS VARCHAR) AS doc_id FROM ({_COUNTS}) o LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F')
        SELECT doc_id, 'customer' AS path, c_name AS value FROM h WHERE c_name IS NOT NULL UNION ALL SELECT doc_id, 'n_lines', CAST(k AS VARCHAR) FROM h
        UNION ALL SELECT doc_id, unnest(['info.priority', 'info.status', 'info.segment']), unnest([o_orderpriority, o_orderstatus, coalesce(c_mktsegment, '')]) FROM h
        UNION ALL SELECT doc_id, 'quantities', '' FROM h WHERE k = 0 UNION ALL SELECT doc_id, 'quantities.' || (n - 1), CAST(l_quantity AS VARCHAR) FROM h JOIN ({_NUMBERED}) l ON l.l_orderkey = h.o_orderkey""",
    "union_columns": f"SELECT 'customer' AS path UNION SELECT 'quantities.' || (n - 1) FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION SELECT 'quantities' FROM ({_COUNTS}) WHERE o_orderstatus = 'F' AND k = 0",
    "slugs": "SELECT conv_id, turn, " + _SLUG.format("coalesce(text, '')") + " AS slug FROM conversations",
    "clean_labels": "SELECT conv_id, turn, " + _BARE.format(r"regexp_replace(regexp_replace(coalesce(text, '') || ' :*', '[:*]+$', ''), '\s+', ' ', 'g')") + " AS label FROM conversations",
    "label_predicates": rf"""WITH l AS ({_LINES}), x AS (SELECT line, {_BARE.format('line')} AS t, {_BARE.format(_UNTITLED)} AS u FROM l WHERE trim(line) <> '')
        SELECT count(*) AS n, count(*) FILTER ({_LABEL}) AS labels, count(*) FILTER ({_LABEL} AND NOT {_DATA} AND NOT {_STATUS}) AS headers, count(*) FILTER ({_DATA}) AS data, count(*) FILTER ({_IDENT}) AS identifiers,
        count(*) FILTER (length(u) BETWEEN 6 AND 64 AND regexp_matches(u, '(?i)[a-z]') AND NOT regexp_matches(t, '(?i)^hidden table\b') AND NOT regexp_matches(u, '(?i)^(if|sum|mid|left|right|vlookup|xlookup|index|match|offset)\s*\(') AND NOT regexp_matches(u, '[=()]')) AS titles FROM x""",
    "value_types": f"SELECT 1 AS col, CASE WHEN regexp_matches(event_type, '(?i)^(true|false|yes|no)$') THEN 'bool' ELSE 'str' END AS type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 2, CASE WHEN value = floor(value) THEN 'int' ELSE 'float' END, count(*) FROM events GROUP BY ALL UNION ALL SELECT 3, 'str', count(*) FROM events UNION ALL SELECT 4, 'str', count(*) FROM ({_EVENTS}) WHERE k IS NOT NULL UNION ALL SELECT 5, 'int', count(*) FROM ({_EVENTS}) WHERE k IS NOT NULL",
    "header_footer_split": "SELECT conv_id, turn, role AS left, conv_id || '&' AS center, CAST(turn AS VARCHAR) AS right FROM conversations",
    "row_runs": f"SELECT CAST(user_id AS VARCHAR) AS doc_id, 1 AS start_col, CASE WHEN k IS NULL THEN 3 ELSE 5 END AS end_col, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL",
    "table_depth": "SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS row, CAST(total - n AS INTEGER) AS depth FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)",
    "linear_depth": f"WITH l AS ({_LINES}), f AS (SELECT doc_id, r, r - row_number() OVER (PARTITION BY doc_id ORDER BY r) AS g FROM l WHERE trim(line) <> ''), d AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id, g) - r AS d FROM f) SELECT CAST(doc_id AS VARCHAR) AS doc_id, max(d) AS deepest, CAST(sum(d) AS BIGINT) AS total FROM d GROUP BY 1",
    "distinct_headers": f"SELECT doc_id, CAST(n AS INTEGER) AS col, CASE WHEN t = 1 THEN s ELSE s || '_' || t END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY n) AS t FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, n, {_SLUG.format('event_type')} AS s FROM ({_EVENTS})))",
    "header_row_choice": f"""WITH s AS (SELECT user_id, n, CASE WHEN length(event_type) > 64 THEN -1 WHEN regexp_matches(event_type, '[<>=%]|^[0-9]+([./-][0-9]+)*$|(?i:^(true|false|yes|no|ok|nq|nd)$)|(?i:^[A-Z0-9._-]{{7,}}$)') THEN -2 WHEN regexp_matches(event_type, '(?i)[a-z]') THEN 2 ELSE 0 END + CASE WHEN k IS NULL THEN 0 ELSE 2 END AS score FROM ({_EVENTS}) WHERE n <= 3)
        SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS row, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n) AS t FROM s) WHERE t = 1""",
    "fingerprints": f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, string_agg(CAST(l_quantity AS VARCHAR), ',' ORDER BY n) AS samples FROM ({_NUMBERED}) JOIN orders ON l_orderkey = o_orderkey WHERE n <= 8 GROUP BY 1",
    "match_score": f"WITH q AS ({_NUMBERED}) SELECT CAST(a.l_orderkey AS VARCHAR) AS doc_id, round(count(*) FILTER (a.l_quantity = b.l_quantity) * 1.0 / count(*), 6) AS score FROM q a JOIN orders ON a.l_orderkey = o_orderkey LEFT JOIN q b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1 AND b.n <= 8 WHERE a.n <= 8 GROUP BY 1",
    "remap_cells": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'B5' AS ref, round(1 - 2 / 120.0, 6) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'",
}
