"""Batch extraction: records and failures of a collection of workbooks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerced, failed
from ..plans.expressions import KIND_OF, Value, compile_field, order
from ..plans.template import DICTS, ELEMENTS, SPARK_TYPES, Field, Template, fields_table
from ..sources.grid import Workbooks
from ..sources.layout import by_document, laid_out, whole
from .detect import detect_versions, version_error
from .slices import all_slices, dict_items, dict_typed, list_items, missing_sheets, table_items, with_spec


@dataclass(frozen=True)
class Options:
    strict_required: bool = False  # a required field must have a value
    validate_elements: bool = False  # rules hold for list elements too
    blank_is_empty: bool = False


@dataclass(frozen=True)
class Extraction:
    """Long forms by cell, records by version, and failures; each is planned when asked for."""

    books: Workbooks
    templates: list[Template]
    fields: DataFrame
    options: Options
    forced: str | None = None

    @cached_property
    def resolved(self) -> DataFrame:
        """detect_versions, stored by document when it is first asked for."""
        with by_document(self.fields.sparkSession):
            return laid_out(detect_versions(self.books, self.templates, self.fields, self.forced), "resolved", getattr(self.books.cells, "buckets", None))

    @cached_property
    def narrow(self) -> DataFrame:
        """The slices of all fields, stored by document when they are first asked for."""
        return self._stored(self._cut(self.fields))

    @cached_property
    def sliced(self) -> DataFrame:
        return with_spec(self.narrow, self.fields)

    @cached_property
    def _places(self) -> dict[int, tuple[str, str, str, str]]:
        """field_no: schema, version, field, shape."""
        return {r["field_no"]: tuple(r)[1:] for r in self.fields.select("field_no", "schema", "version", "field", "shape").collect()}

    @cached_property
    def _parts(self) -> dict[frozenset[int], DataFrame]:
        return {}

    def _cut(self, fields: DataFrame) -> DataFrame:
        """The slices of these fields, planned and not stored."""
        return all_slices(self.books, self.resolved.filter("version IS NOT NULL"), fields, self.options.blank_is_empty)

    def _stored(self, narrow: DataFrame) -> DataFrame:
        with by_document(self.fields.sparkSession):
            return laid_out(narrow, "slices", self.resolved.buckets, sort=False)

    def _of(self, wanted: frozenset[int], stored: bool) -> DataFrame:
        """Narrow slices of the fields with these numbers: of a stored set that holds them, or cut for them alone, and stored if they are read more than once."""
        held = self.narrow if "narrow" in self.__dict__ else next((t for k, t in self._parts.items() if wanted <= k), None)
        numbered = F.col("field_no").isin(*sorted(wanted)) if wanted else F.lit(False)
        if held is not None:
            return held.filter(numbered)
        fresh = self._cut(self.fields.filter(numbered))
        if stored:
            fresh = self._parts[wanted] = self._stored(fresh)
        return fresh

    def slices_of(self, *names: str, version: str | None = None) -> DataFrame:
        """Slices of the fields with these names, of one version or all; only these are cut, unless all are stored already."""
        wanted = frozenset(k for k, (_, v, n, _) in self._places.items() if n in names and version in (None, v))
        return with_spec(self._of(wanted, stored=True), self.fields)

    def lists(self, *names: str) -> DataFrame:
        """list_items of the fields with these names. Of none given, all, for which all slices are stored."""
        return list_items(self._long(names))

    def dicts(self, *names: str) -> DataFrame:
        return dict_items(self._long(names))

    def tables(self, *names: str, version: str | None = None) -> DataFrame:
        return table_items(self._once(names, version) if names else self.narrow, self.fields)

    def _once(self, names: tuple[str, ...], version: str | None = None) -> DataFrame:
        return self._of(frozenset(k for k, (_, v, n, _) in self._places.items() if n in names and version in (None, v)), stored=False)

    def _long(self, names: tuple[str, ...]) -> DataFrame:
        return with_spec(self._once(names), self.fields) if names else self.sliced

    def results(self, schema: str, version: str, only: list[str] | None = None) -> DataFrame:
        """doc_id, a column for each field, and errors (array of field, rule, message), of a version's documents.

        only: the fields that are wanted. Of tables and maps others are not assembled then, unless they can be errors.
        """
        template = next(t for t in self.templates if t.name == schema)
        return _results(self, template, version, only)

    def records(self, schema: str, version: str, only: list[str] | None = None) -> DataFrame:
        return self.results(schema, version, only).filter("size(errors) = 0").drop("errors")

    def failures(self) -> DataFrame:
        """doc_id, error_kind, message: documents without a version, and the first error of each that has one."""
        self._of(frozenset(k for k, p in self._places.items() if p[3] in ("scalar", "list")), stored=True)  # once for all versions
        lost = self.resolved.filter("version IS NULL").select("doc_id", F.lit("discriminator_mismatch").alias("error_kind"), version_error().alias("message"))
        for t in self.templates:
            for v in t.versions:
                bad = _results(self, t, v, []).filter("size(errors) > 0").withColumn("e", F.col("errors")[0])
                lost = lost.unionByName(bad.select("doc_id", F.lit("extraction_error").alias("error_kind"), F.concat("e.field", F.lit(": "), "e.rule").alias("message")))
        return lost


def extract(books: Workbooks, templates: list[Template], options: Options = Options(), forced: str | None = None) -> Extraction:
    """Detects versions once, and slices the cells for the fields that are asked for, when they are; what several results read is kept in the shared folder.

    It is laid out by document, in the buckets of the cells if those are laid out so: then nothing here shuffles cells.
    """
    return Extraction(books, templates, fields_table(books.cells.sparkSession, templates), options, forced)


def _error(field: str, rule: str, holds: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))


def _anchored(pattern: str) -> str:
    """A final $ that doesn't match before a line end."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern


def _rules(field: Field, value: Column, shape: str, options: Options) -> list[Column]:
    """Errors of a field's value; null passes all but a strict `required`."""
    out = []
    if shape == "scalar" and field.type in ("int", "float", "bool", "str", "any"):
        number = value if field.type in ("int", "float") else value.cast("double") if field.type == "bool" else None
        if field.low is not None and number is not None:
            out.append(_error(field.name, "min", number < field.low))
        if field.high is not None and number is not None:
            out.append(_error(field.name, "max", number > field.high))
        if field.pattern is not None:
            out.append(_error(field.name, "pattern", ~value.cast("string").rlike(_anchored(field.pattern))))
    if shape == "list" and options.validate_elements:
        if field.low is not None and field.type != "list[str]":
            out.append(_error(field.name, "min", F.exists(value, lambda x: x.cast("double") < field.low)))
        if field.high is not None and field.type != "list[str]":
            out.append(_error(field.name, "max", F.exists(value, lambda x: x.cast("double") > field.high)))
        if field.pattern is not None:
            out.append(_error(field.name, "pattern", F.exists(value, lambda x: ~x.cast("string").rlike(_anchored(field.pattern)))))
    if options.strict_required and field.required:
        out.append(_error(field.name, "required", value.isNull()))
    return out


def _assembled(e: Extraction, template: Template, version: str, wanted: dict[str, Field]) -> DataFrame:
    """doc_id, a column f_<field> for each of these fields that is read, and x_<field> where its coercion failed; one aggregation by document."""
    here = (F.col("schema") == template.name) & (F.col("version") == version)
    docs = e.resolved.filter(here).select("doc_id")
    fields = [f for f in wanted.values() if f.kind != "computed"]
    out = docs
    numbers = {n: k for k, (s, v, n, _) in e._places.items() if (s, v) == (template.name, version)}
    narrow = e._of(frozenset(numbers[f.name] for f in fields), stored=True)
    sliced = with_spec(narrow, e.fields)
    scalars = [f for f in fields if f.shape == "scalar"]
    if scalars:
        of = lambda f: F.col("field") == f.name
        aggs = [F.max(F.when(of(f), coerced(f.type))).alias(f"f_{f.name}") for f in scalars]
        aggs += [F.coalesce(F.bool_or(F.when(of(f), failed(f.type))), F.lit(False)).alias(f"x_{f.name}") for f in scalars]
        out = out.join(whole(sliced.filter("shape = 'scalar'").groupBy("doc_id").agg(*aggs)), "doc_id", "left")
    lists = [f for f in fields if f.shape == "list"]
    if lists:
        aggs = []
        for f in lists:
            item = F.when(F.col("field") == f.name, F.struct("pos", coerced(ELEMENTS[f.type]).alias("v")))
            aggs.append(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias(f"f_{f.name}"))
            aggs.append(F.coalesce(F.bool_or(F.when(F.col("field") == f.name, failed(ELEMENTS[f.type]))), F.lit(False)).alias(f"x_{f.name}"))
        out = out.join(whole(list_items(sliced).groupBy("doc_id").agg(*aggs)), "doc_id", "left")
    for f in (f for f in fields if f.shape == "dict"):
        items = dict_typed(dict_items(sliced.filter(F.col("field") == f.name)), DICTS[f.type]).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias(f"f_{f.name}"))
        out = out.join(whole(items), "doc_id", "left")
    tables = [f for f in fields if f.shape == "table"]
    if tables:
        rows = table_items(narrow, e.fields).groupBy("doc_id", "field", "record").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("r"))
        for f in tables:
            made = rows.filter(F.col("field") == f.name).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record", F.map_entries("r").alias("r")))), lambda s: F.map_from_entries(s["r"])).alias(f"f_{f.name}"))
            out = out.join(whole(made), "doc_id", "left")
    empty = {"list": lambda f: F.array().cast(f"array<{SPARK_TYPES[ELEMENTS[f.type]].simpleString()}>"), "dict": lambda f: F.create_map().cast(f"map<string,{SPARK_TYPES[DICTS[f.type]].simpleString()}>"), "table": lambda f: F.array().cast("array<map<string,string>>")}
    return out.withColumns({f"f_{f.name}": F.coalesce(f"f_{f.name}", empty[f.shape](f)) for f in fields if f.shape != "scalar"} | {f"x_{f.name}": F.coalesce(f"x_{f.name}", F.lit(False)) for f in fields if f.shape in ("scalar", "list")})


def _results(e: Extraction, template: Template, version: str, only: list[str] | None = None) -> DataFrame:
    """Of tables and maps those in only alone (None: all): no error comes from the others, unless they must have a value."""
    every = template.versions[version]
    fields = {n: f for n, f in every.items() if f.shape in ("scalar", "list") or only is None or n in only or e.options.strict_required}
    rows = _assembled(e, template, version, fields)
    errors = []
    if any(f.sheet is not None for f in every.values()):
        here = e.resolved.filter((F.col("schema") == template.name) & (F.col("version") == version))
        lost = missing_sheets(e.books, here, e.fields).groupBy("doc_id").agg(F.min(F.struct("field_ord", "field")).alias("lost"))
        rows = rows.join(whole(lost), "doc_id", "left")
        errors.append(F.when(F.col("lost").isNotNull(), F.struct(F.col("lost.field").alias("field"), F.lit("missing_sheet").alias("rule"))))
    read = [f for f in fields.values() if f.kind != "computed"]
    errors += [_error(f.name, "type", F.col(f"x_{f.name}")) for f in read if f.shape in ("scalar", "list")]
    rows = rows.withColumnsRenamed({f"f_{f.name}": f.name for f in read})
    kinds = {f.name: "list" if f.shape == "list" else KIND_OF.get(f.type, "str") for f in read if f.shape in ("scalar", "list")}
    for f in order(list(fields.values())):
        made: Value = compile_field(f.expression, kinds)
        value = made.column if f.type == "any" else made.column.try_cast(SPARK_TYPES[f.type]) if made.kind != "list" else made.column
        rows = rows.withColumns({f.name: F.when(~F.coalesce(made.error, F.lit(True)), value), f"e_{f.name}": F.coalesce(made.error, F.lit(True))})
        kinds[f.name] = made.kind if f.type == "any" else KIND_OF[f.type]
        errors.append(_error(f.name, "computed", F.col(f"e_{f.name}")))
    errors += [_error(f.name, "null_element", F.exists(f.name, lambda x: x.isNull()) & ~F.col(f"x_{f.name}")) for f in read if f.shape == "list"]
    for f in fields.values():
        if f.kind != "computed" or f.type != "any":
            errors += _rules(f, F.col(f.name), f.shape, e.options)
    return rows.select("doc_id", *fields, F.array_compact(F.array(*errors)).alias("errors"))


def batch_summary(e: Extraction) -> DataFrame:
    """outcome, n: how many documents gave records, and how many failed in which way."""
    failed_docs = e.failures().groupBy("error_kind").agg(F.count("*").alias("n"))
    total = e.books.docs.select("doc_id").distinct().agg(F.count("*").alias("total"))
    ok = failed_docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad")).crossJoin(total).select(F.lit("success").alias("outcome"), (F.col("total") - F.col("bad")).alias("n"))
    return ok.unionByName(failed_docs.select(F.col("error_kind").alias("outcome"), "n"))


def halted(resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, path, halted: the documents up to the first, by path, that follows no version; that one is marked."""
    placed = docs.join(whole(resolved.select("doc_id", "version")), "doc_id", "left")
    first = placed.agg(F.min(F.when(F.col("version").isNull(), F.col("path"))).alias("halt"))
    return placed.crossJoin(F.broadcast(first)).filter("halt IS NULL OR path <= halt").select("doc_id", "path", (F.col("halt").isNotNull() & (F.col("path") == F.col("halt"))).alias("halted"))


def resumed(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Results of a continued batch: earlier rows (path, ...) but for those done again, then the new ones."""
    return earlier.join(whole(new.select("path").distinct()), "path", "left_anti").unionByName(new, allowMissingColumns=True)
