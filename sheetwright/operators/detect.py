"""Which version of which template a workbook follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.addressing import area
from ..functions.coerce import coerced, failed_by
from ..plans.template import ELEMENTS, Template, TemplateError, edge_ref, fields_table
from ..sources.grid import Workbooks
from ..sources.layout import laid_out, whole
from .slices import KEYS, all_slices, missing_sheets, with_spec

TIE = 1e-9


def _markers(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = []
    for i, t in enumerate(templates):
        for k, ref in enumerate(t.cells):
            if found := edge_ref(ref):
                rows.append((t.name, i, k, ref, found[0], None, None, *found[1]))
            else:
                at = area(ref)
                rows.append((t.name, i, k, ref, at.sheet, at.start_row, at.start_col, None, None, None))
    return spark.createDataFrame(rows, "schema string, schema_ord int, marker int, ref string, m_sheet string, row int, col int, edge_kind string, edge_page string, edge_section string")


def checked_cells(books: Workbooks, templates: list[Template]) -> DataFrame:
    """doc_id, schema, schema_ord, marker, ref, value of every discriminator cell of every document.

    An empty cell reads as empty text; a cell on a sheet that isn't there as an error text.
    """
    spark = books.cells.sparkSession
    markers = F.broadcast(_markers(spark, templates))  # configuration
    on_sheet = "(m_sheet = sheet OR (m_sheet IS NULL AND sheet_idx = 0))"
    places = {(at.start_row, at.start_col) for at in (area(ref) for t in templates for ref in t.cells if not edge_ref(ref))}
    asked = F.col("row").isin([r for r, _ in places]) & F.col("col").isin([c for _, c in places])  # as a filter, for the scan
    in_cells = books.cells.filter(asked).select("doc_id", "sheet", "sheet_idx", "row", "col", "text").join(markers, ["row", "col"]).filter(on_sheet).select("doc_id", "schema", "marker", "text")
    edges = books.edges.withColumnsRenamed({"kind": "edge_kind", "page": "edge_page", "section": "edge_section"})
    in_edges = edges.join(markers, ["edge_kind", "edge_page", "edge_section"]).filter(on_sheet).select("doc_id", "schema", "marker", "text")
    found = in_cells.unionByName(in_edges).groupBy("doc_id", "schema", "marker").agg(F.max("text").alias("text"))
    wanted = books.docs.select("doc_id").distinct().crossJoin(markers)
    if any(edge_ref(ref)[0] if edge_ref(ref) else area(ref).sheet for t in templates for ref in t.cells):
        there = books.sheets.select("doc_id", F.col("sheet").alias("m_sheet"), F.lit(True).alias("there")).distinct()
        wanted = wanted.join(whole(there), ["doc_id", "m_sheet"], "left")
    else:
        wanted = wanted.withColumn("there", F.lit(None).cast("boolean"))  # no marker names a sheet
    wanted = wanted.join(whole(found), ["doc_id", "schema", "marker"], "left")
    lost = F.col("m_sheet").isNotNull() & F.col("there").isNull()
    value = F.when(lost, F.concat(F.lit("<error: Sheet '"), "m_sheet", F.lit("' not found in workbook>"))).otherwise(F.trim(F.coalesce("text", F.lit(""))))
    return wanted.select("doc_id", "schema", "schema_ord", "marker", "ref", value.alias("value"), lost.alias("lost"))


def by_marker(checked: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, schema, version, matched_cell: the first discriminator cell that holds a version's key; both null where none does."""
    spark = checked.sparkSession
    keys = spark.createDataFrame([(t.name, v) for t in templates for v in t.versions], "schema string, version string")
    met = checked.join(F.broadcast(keys), (checked["schema"] == keys["schema"]) & (checked["value"] == keys["version"]) & ~checked["lost"], "left").drop(keys["schema"])
    return met.groupBy("doc_id", "schema").agg(F.min(F.when(F.col("version").isNotNull(), F.struct("marker", "version", "ref"))).alias("m")).select("doc_id", "schema", "m.version", F.col("m.ref").alias("matched_cell"))


def valid_fields(books: Workbooks, tried: DataFrame, fields: DataFrame) -> DataFrame:
    """KEYS, valid: whether the field's slice has a value of its type that passes its rules; fields without a slice don't come.

    tried: doc_id, schema, and version where not all of the schema are tried.
    """
    cut = with_spec(all_slices(books, tried, fields), fields, "field_no")
    asked = [r[0] for r in fields.select(F.when(F.col("shape") == "list", F.col("element")).when(F.col("shape") == "scalar", F.col("type"))).distinct().collect()]
    bad = failed_by(F.when(F.col("shape") == "list", F.col("element")).when(F.col("shape") == "scalar", F.col("type")), types=asked)
    number = F.lit(None).cast("double")
    for name in ("int", "float", "bool"):
        if name in asked:
            number = F.when(F.col("type") == name, coerced(name).cast("double")).otherwise(number)
    has_rule = F.col("low").isNotNull() | F.col("high").isNotNull()
    in_bounds = ~has_rule | F.coalesce((number >= F.coalesce("low", F.lit(float("-inf")))) & (number <= F.coalesce("high", F.lit(float("inf")))), F.lit(False))
    matches = F.col("pattern").isNull() | F.coalesce(F.expr("text RLIKE concat('^(?:', pattern, ')')"), F.lit(False))
    filled = F.trim("text") != ""
    header = ~F.col("vertical") & (F.size("columns") == 0)
    ok = (
        F.when(F.col("shape") == "scalar", (filled | ~F.col("type").isin("str", "any")) & ~bad & in_bounds & matches)
        .when(F.col("shape") == "list", filled & (F.col("col") == F.col("start_col")))
        .when(F.col("shape") == "dict", filled & (F.col("col") == F.col("start_col") + 1))
        .when(F.col("vertical"), F.col("col") > F.col("start_col"))
        .otherwise(~header | (F.col("row") > F.col("start_row")))
    )
    broken = (F.col("shape") == "list") & (F.col("col") == F.col("start_col")) & bad
    valid = cut.groupBy("doc_id", "field_no").agg((F.bool_or(ok) & ~F.bool_or(broken)).alias("valid"))  # in the order that slices come in
    return with_spec(valid, fields, "valid").select(*KEYS, "valid")


def by_layout(books: Workbooks, tried: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, schema, version, confidence: valid fields squared over all fields, best by document and schema, no ties.

    tried: doc_id, schema. Confidence depends on which fields are valid, so no value is gathered.
    """
    of_version = fields.filter("ref_kind <> 'computed'").groupBy("schema", "version").agg(F.count("*").alias("total"))
    good = valid_fields(books, tried.select("doc_id", "schema"), fields).filter("valid").groupBy("doc_id", "schema", "version").agg(F.count("*").alias("n"))
    scored = good.join(F.broadcast(of_version), ["schema", "version"]).withColumn("confidence", F.col("n") * F.col("n") / F.col("total"))
    best = W.partitionBy("doc_id", "schema").orderBy(F.desc("confidence"), F.desc("version"))
    top = scored.withColumn("place", F.row_number().over(best)).withColumn("next", F.lead("confidence").over(best)).filter("place = 1")
    return top.filter(f"next IS NULL OR confidence - next >= {TIE}").select("doc_id", "schema", "version", "confidence")


def detect_versions(books: Workbooks, templates: list[Template], fields: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """A row for each document: doc_id, schema, version, matched_cell, matched_by, checked (array of cell and value).

    Each template resolves a version by its discriminator cells, else by layout; the first template that
    does, in the given order, counts. All three are null where none does. A forced version skips detection.
    """
    spark = books.cells.sparkSession
    if forced is not None:
        named = next((t.name for t in templates if forced in t.versions), None)
        if named is None:
            raise TemplateError(f"no template has version {forced!r}")
        none = F.array().cast("array<struct<cell:string,value:string>>")
        return books.docs.select("doc_id").distinct().select("doc_id", F.lit(named).alias("schema"), F.lit(forced).alias("version"), F.lit(None).cast("string").alias("matched_cell"), F.lit("forced").alias("matched_by"), none.alias("checked"))
    fields = fields if fields is not None else fields_table(spark, templates)
    checked = laid_out(checked_cells(books, templates), "checked", getattr(books.cells, "buckets", None))  # small, and read by all that follows
    met = by_marker(checked, templates)
    marked = met.filter("version IS NOT NULL")
    guessed = by_layout(books, met.filter("version IS NULL").select("doc_id", "schema"), fields)
    ordinal = spark.createDataFrame([(t.name, i) for i, t in enumerate(templates)], "schema string, schema_ord int")
    found = marked.withColumn("matched_by", F.lit("discriminator")).unionByName(guessed.select("doc_id", "schema", "version", F.lit(None).cast("string").alias("matched_cell"), F.lit("inference").alias("matched_by")))
    first = found.join(F.broadcast(ordinal), "schema").groupBy("doc_id").agg(F.min(F.struct("schema_ord", "schema", "version", "matched_cell", "matched_by")).alias("m"))
    trail = checked.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("schema_ord", "marker", F.col("ref").alias("cell"), "value"))), lambda c: F.struct(c["cell"].alias("cell"), c["value"].alias("value"))).alias("checked"))
    return trail.join(whole(first), "doc_id", "left").select("doc_id", "m.schema", "m.version", "m.matched_cell", "m.matched_by", "checked")


def version_error(checked: str = "checked"):
    """The message for a document without a version, with what was checked."""
    shown = F.array_join(F.transform(checked, lambda c: F.concat(c["cell"], F.lit("='"), c["value"], F.lit("'"))), ", ")
    return F.concat(F.lit("No schema version matched (checked: "), F.when(F.size(checked) > 0, shown).otherwise("<none>"), F.lit(")"))


def version_fields(template: Template, version: str) -> dict[str, str]:
    """Field types of a version, list elements by their own type."""
    return {n: ELEMENTS.get(f.type, f.type) for n, f in template.versions[version].items()}
