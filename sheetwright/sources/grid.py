"""The data model: workbooks as long tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_date_format, is_duration_format, shown_date, shown_duration
from .layout import PLACE, laid_out
from .shared import cut

CELLS = "doc_id string, path string, sheet string, sheet_idx int, row int, col int, kind string, text string, num double, bool boolean, ts timestamp_ntz, emphasized boolean, hidden_col boolean"
DOCS = "doc_id string, path string"
SHEETS = "doc_id string, sheet string, sheet_idx int, n_rows int, n_cols int"
HEADER_FOOTER = "doc_id string, sheet string, sheet_idx int, kind string, page string, section string, text string"
MERGES = "doc_id string, sheet string, top int, left int, bottom int, right int"
FORMATS = "doc_id string, sheet string, row int, col int, format string"
HIDDEN = "doc_id string, sheet string, left int, right int"
#: Rows of a block in which merged areas meet the rows that are asked for.
MERGE_ROWS = 1_024


@dataclass(frozen=True)
class Workbooks:
    """All workbooks of a collection. Cells hold only values that are there; row and col are 1-based."""

    docs: DataFrame
    sheets: DataFrame
    cells: DataFrame
    edges: DataFrame  # page headers and footers
    merges: DataFrame
    hidden: DataFrame  # spans of hidden columns
    formats: DataFrame | None = None  # number formats of numbers, but for General; where they are known

    def stored(self, buckets: int | None = None) -> Workbooks:
        """The same, with cells and side tables written once: what follows reads them with its filters and columns pushed down.

        Cells, sheets and documents are laid out by document, so that what is keyed by document doesn't shuffle them again.
        buckets: see `laid_out` and `buckets_for`.
        """
        cells = laid_out(self.cells, "cells", buckets)
        return Workbooks(laid_out(self.docs, "docs", cells.buckets), laid_out(self.sheets, "sheets", cells.buckets), cells, *[cut(t, n) for t, n in ((self.edges, "edges"), (self.merges, "merges"), (self.hidden, "hidden"))], cut(self.formats, "formats") if self.formats is not None else None)


def from_cells(cells: DataFrame, docs: DataFrame | None = None, sheets: DataFrame | None = None, edges: DataFrame | None = None, merges: DataFrame | None = None, hidden: DataFrame | None = None) -> Workbooks:
    """Workbooks of a cells table; what isn't given is derived from it, or empty."""
    spark = cells.sparkSession
    return Workbooks(
        docs if docs is not None else cells.groupBy("doc_id").agg(F.min("path").alias("path")),
        sheets if sheets is not None else cells.groupBy("doc_id", "sheet", "sheet_idx").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols")),
        cells,
        # without rows as the planner sees it, so that what meets them is left out
        edges if edges is not None else spark.createDataFrame([], HEADER_FOOTER).limit(0),
        merges if merges is not None else spark.createDataFrame([], MERGES).limit(0),
        hidden if hidden is not None else spark.createDataFrame([], HIDDEN).limit(0),
    )


def has_value(blank_is_empty: bool = False) -> Column:
    """A cell that counts as filled; with blank_is_empty, blank text doesn't."""
    return F.col("kind").isNotNull() & (F.trim("text") != "" if blank_is_empty else F.lit(True))


def dated(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """The cells with numbers as their formats show them: dates as timestamps, times of day and durations as text.

    For cells that hold plain numbers, such as those of other readers; `read_workbooks` gives the same itself. formats: FORMATS, of
    which other columns are not read. Of several formats of a place one that shows dates counts; places without a format
    or with a null one stay as they are, and so do cells that are no numbers. A number that is no date is the error #VALUE!.
    """
    code = F.col("format")
    told = formats.filter(is_date_format(code)).groupBy(*PLACE).agg(F.min(is_duration_format(code)).alias("__lasts"))
    number = F.col("kind").isin("i", "f") & F.col("num").isNotNull()
    shown = F.when(number & F.col("__lasts"), shown_duration(F.col("num"))).when(number & ~F.col("__lasts"), shown_date(F.col("num")))
    out = cells.join(told, PLACE, "left").withColumn("__shown", shown)
    new = {c: F.when(F.col("__shown").isNotNull(), F.col(f"__shown.{c}")).otherwise(F.col(c)).alias(c) for c in ("kind", "text", "ts")} | {"num": F.when(F.col("__shown").isNull(), F.col("num")).alias("num")}
    return out.select(*[new.get(c, F.col(c)) for c in cells.columns])


def fill_merges(books: Workbooks) -> Workbooks:
    """Every cell of a merged area gets the value of its upper left cell, where it has none itself."""
    return replace(books, cells=books.cells.unionByName(merged_cells(books)))


def merged_cells(books: Workbooks, rows: DataFrame | None = None) -> DataFrame:
    """The cells that merged areas add: copies of their upper left cells where no cell is.

    rows: doc_id, sheet, row of the rows that are asked for; all that the areas cover if not given. With them an area meets its rows by the
    blocks of MERGE_ROWS rows that both lie in, so that a merged column costs as many rows as are asked for.
    """
    anchor = books.cells.withColumnsRenamed({"row": "top", "col": "left"})
    areas = books.merges.filter("bottom > top OR right > left").join(anchor, ["doc_id", "sheet", "top", "left"])  # an empty anchor fills nothing
    if rows is None:
        spread = areas.withColumn("row", F.explode(F.sequence("top", "bottom")))
    else:
        block = lambda c: F.expr(f"{c} div {MERGE_ROWS}")
        cut_up = areas.withColumn("block", F.explode(F.sequence(block("top"), block("bottom"))))
        asked = rows.select("doc_id", "sheet", "row").distinct().withColumn("block", block("row"))
        spread = cut_up.join(asked, ["doc_id", "sheet", "block"]).filter("row BETWEEN top AND bottom").drop("block")
    copies = spread.withColumn("col", F.explode(F.sequence("left", "right"))).filter("row <> top OR col <> left").select(*books.cells.columns)
    taken = books.cells.select("doc_id", "sheet", "row", "col")
    return copies.join(taken, ["doc_id", "sheet", "row", "col"], "left_anti")
