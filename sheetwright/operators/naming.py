"""Names for what a user selects: fields, table columns and rows, header rows, version values, page headers.

Everything works within a document; a selection is a row of a table, so a whole collection is named at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..functions.addressing import index_to_letters
from ..sources.grid import has_value
from .coverage import fuzzy_names

SHEET = ["doc_id", "sheet"]
BLOCK = [*SHEET, "row", "col", "end_row", "end_col"]
#: Rows tried for a header, and what counts for and against one.
HEADER_ROWS, LONG_HEADER, NUMBER = 3, 40, r"^-?[0-9]+(\.[0-9]+)?$"
#: The order in which page headers and footers are looked through.
EDGE_ORDER = {"kind": ("header", "footer"), "page": ("odd", "first", "even"), "section": ("left", "center", "right")}


def _beside(selections: DataFrame, cells: DataFrame, d_row: int, d_col: int, name: str) -> DataFrame:
    """selections with the text of the string cell that far from each, as `name`."""
    words = cells.filter((F.col("kind") == "s") & (F.trim("text") != "")).select(*SHEET, (F.col("row") - d_row).alias("row"), (F.col("col") - d_col).alias("col"), F.col("text").alias(name))
    return selections.join(words, [*SHEET, "row", "col"], "left")


def field_names(selections: DataFrame, cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc_id, sheet, row, col, name: for each selection (doc_id, sheet, row, col, is_range) the text above it, else, if it is one cell, left of it.

    A field name of another version (names: name) that shares half of the words goes first. None where no text is, or none that makes a name.
    """
    found = _beside(_beside(selections, cells, -1, 0, "above"), cells, 0, -1, "left")
    label = F.coalesce("above", F.when(~F.col("is_range"), F.col("left")))
    found = found.withColumn("slug", t.slugify(label)).filter("slug <> ''").select(*SHEET, "row", "col", "slug")
    if names is None:
        return found.withColumnRenamed("slug", "name")
    known = fuzzy_names(found, names).select("slug", F.col("name").alias("known"))
    return found.join(known, "slug", "left").select(*SHEET, "row", "col", F.coalesce("known", "slug").alias("name"))


def best_header_row(blocks: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """BLOCK, header_row, score: of a block's first HEADER_ROWS rows the best header, the upper of equal ones; the first if all are empty.

    Counted are cells with a letter and LONG_HEADER characters at most, less numbers, less 2 if no more than half of
    the texts differ, plus 1 for a merged area inside the row.
    """
    value = F.trim("text")
    there = cells.filter(has_value(True)).select(*[F.col(c).alias(f"c_{c}") for c in (*SHEET, "row", "col")], value.alias("v"))
    inside = "doc_id = c_doc_id AND sheet = c_sheet AND c_row BETWEEN row AND least(end_row, row + {}) AND c_col BETWEEN col AND end_col".format(HEADER_ROWS - 1)
    rows = blocks.select(*BLOCK).join(there, F.expr(inside)).groupBy(*BLOCK, "c_row").agg(
        F.count("*").alias("n"), F.countDistinct(F.lower("v")).alias("different"), F.count_if(F.col("v").rlike("(?i)[a-z]") & (F.char_length("v") <= LONG_HEADER)).alias("like"), F.count_if(F.col("v").rlike(NUMBER)).alias("numbers")
    )
    wide = merges.filter("right > left").select(F.col("doc_id").alias("m_doc_id"), F.col("sheet").alias("m_sheet"), "top", "left", "bottom", "right").distinct()
    joined = rows.join(wide, F.expr("doc_id = m_doc_id AND sheet = m_sheet AND c_row BETWEEN top AND bottom AND left >= col AND right <= end_col"), "left_semi").select(*BLOCK, "c_row", F.lit(1).alias("bonus"))
    rows = rows.join(joined.distinct(), [*BLOCK, "c_row"], "left")
    score = F.col("like") - F.col("numbers") - F.when(F.col("different") <= F.ceil(F.col("n") / 2), 2).otherwise(0) + F.coalesce("bonus", F.lit(0))
    best = rows.withColumn("score", score).groupBy(*BLOCK).agg(F.max_by(F.struct("c_row", "score"), F.struct("score", -F.col("c_row"))).alias("b"))
    return blocks.select(*BLOCK).join(best, BLOCK, "left").select(*BLOCK, F.coalesce("b.c_row", "row").alias("header_row"), F.col("b.score").alias("score"))


def column_names(blocks: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """BLOCK, letters, name: a block's columns by its best header row; a merged header names all of its columns, and a blank one none."""
    heads = best_header_row(blocks, cells, merges)
    places = heads.withColumn("at", F.explode(F.sequence("col", "end_col")))
    spans = merges.select(F.col("doc_id").alias("m_doc_id"), F.col("sheet").alias("m_sheet"), "top", "left", "bottom", "right")
    placed = places.join(spans, F.expr("doc_id = m_doc_id AND sheet = m_sheet AND header_row BETWEEN top AND bottom AND at BETWEEN left AND right AND left >= col AND right <= end_col"), "left")
    placed = placed.select(*BLOCK, "header_row", "at", F.coalesce("top", "header_row").alias("c_row"), F.coalesce("left", "at").alias("c_col"))
    words = cells.filter(has_value(True)).select(*SHEET, F.col("row").alias("c_row"), F.col("col").alias("c_col"), "text")
    named = placed.join(words, [*SHEET, "c_row", "c_col"]).withColumn("name", t.slugify(F.col("text"))).filter("name <> ''")
    return named.select(*BLOCK, index_to_letters(F.col("at")).alias("letters"), "name")


def row_names(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """BLOCK, at, name: the rows of a block with records down its columns, by its first column; blank ones have none."""
    words = cells.filter(has_value(True)).select(*SHEET, F.col("row").alias("at"), "col", "text")
    named = blocks.select(*BLOCK).withColumn("at", F.explode(F.sequence("row", "end_row"))).join(words, [*SHEET, "at", "col"])
    return named.select(*BLOCK, "at", t.slugify(F.col("text")).alias("name"))


def promoted_headers(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """BLOCK with the row moved up by one where the row above scores higher as a header, and promoted, whether it was."""
    scores = cells.select(*[F.col(c).alias(f"c_{c}") for c in (*SHEET, "row", "col")], t.header_score(F.col("kind"), F.col("text")).alias("points"))
    near = blocks.select(*BLOCK).join(scores, F.expr("doc_id = c_doc_id AND sheet = c_sheet AND c_row IN (row, row - 1) AND c_col BETWEEN col AND end_col"), "left")
    points = lambda at: F.coalesce(F.sum(F.when(at, F.col("points"))), F.lit(0))
    told = near.groupBy(*BLOCK).agg(points(F.col("c_row") == F.col("row")).alias("here"), points(F.col("c_row") == F.col("row") - 1).alias("above"))
    told = told.withColumn("promoted", (F.col("row") > 1) & (F.col("above") > F.col("here")))
    return told.select(*SHEET, (F.col("row") - F.col("promoted").cast("int")).alias("row"), "col", "end_row", "end_col", "promoted")


def guessed_versions(cells: DataFrame, places: list[tuple[str | None, int, int]]) -> DataFrame:
    """doc_id, value: the texts at the places (sheet or None for the first, row, col), in their order, joined by blanks; documents without any are left out."""
    wanted = F.broadcast(cells.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(places)], "turn int, w_sheet string, row int, col int"))
    met = cells.filter(has_value(True)).join(wanted, ["row", "col"]).filter("w_sheet = sheet OR (w_sheet IS NULL AND sheet_idx = 0)")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("v")))), lambda x: x["v"])
    return met.groupBy("doc_id").agg(F.array_join(texts, " ").alias("value"))


def first_edges(edges: DataFrame) -> DataFrame:
    """doc_id, sheet, kind, page, section, text of each sheet's first page header or footer that isn't blank, in EDGE_ORDER."""
    places = [F.array_position(F.array(*map(F.lit, order)), F.col(c)) for c, order in EDGE_ORDER.items()]
    turn = F.row_number().over(W.partitionBy(*SHEET).orderBy(*places))
    return edges.filter(F.trim("text") != "").withColumn("turn", turn).filter("turn = 1").select(*SHEET, "kind", "page", "section", "text")
