"""Templates: job configuration that becomes a small table of fields.

    name: harvest
    discriminator: {cells: [C1, "Cover!header:left"]}
    versions:
      spring: {extends: old, fields: {trees: {cell: G4, type: float}, crates: {range: "B12:D", type: table}},
               validation: {trees: {min: 0}}}
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.addressing import area

ELEMENTS = {"list[str]": "str", "list[int]": "int", "list[float]": "float", "list[bool]": "bool"}
SCALARS = ("str", "int", "float", "bool", "datetime", "date", "any")
DICTS = {"dict[str, str]": "str", "dict[str, int]": "int", "dict[str, float]": "float"}
TYPES = (*SCALARS, *ELEMENTS, "table", *DICTS)
SPARK_TYPES = {"str": T.StringType(), "any": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "date": T.DateType()}
#: Fixed value: how a template writes a page header or footer.
EDGE_TEXT = re.compile(r"^(?:(?P<sheet>[^!]+)!)?(?P<kind>header|footer)(?::(?P<page>odd|even|first))?:(?P<section>left|center|right)$", re.I)
REFERENCE = re.compile(r"\{(\w+)\}")


class TemplateError(ValueError):
    """The configuration cannot be used."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # cell, edge (page header or footer), range, computed
    type: str
    sheet: str | None = None
    start_row: int | None = None
    start_col: int | None = None
    end_row: int | None = None
    end_col: int | None = None
    edge: tuple[str, str, str] | None = None  # kind, page, section
    expression: str | None = None
    columns: tuple[tuple[str, str], ...] = ()
    vertical: bool = False
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    required: bool = False

    @property
    def shape(self) -> str:
        return "table" if self.type == "table" else "dict" if self.type.startswith("dict") else "list" if self.type in ELEMENTS else "scalar"


@dataclass(frozen=True)
class Template:
    name: str
    cells: tuple[str, ...]
    versions: dict[str, dict[str, Field]]

    def struct(self, version: str) -> T.StructType:
        """The Spark schema of a version's records."""
        of = {"table": lambda f: T.ArrayType(T.MapType(T.StringType(), T.StringType())), "dict": lambda f: T.MapType(T.StringType(), SPARK_TYPES[DICTS[f.type]]), "list": lambda f: T.ArrayType(SPARK_TYPES[ELEMENTS[f.type]])}
        kind = lambda f: of[f.shape](f) if f.shape in of else SPARK_TYPES[f.type]
        return T.StructType([T.StructField(f.name, kind(f)) for f in self.versions[version].values()])


def edge_ref(ref: str) -> tuple[str | None, tuple[str, str, str]] | None:
    """Sheet and (kind, page, section) of a header or footer reference; None for any other."""
    m = EDGE_TEXT.match(ref.strip())
    return (m["sheet"], (m["kind"].lower(), (m["page"] or "odd").lower(), m["section"].lower())) if m else None


def _field(name: str, raw: dict) -> Field:
    kind = "computed" if raw.get("computed") is not None else "cell" if raw.get("cell") else "range" if raw.get("range") else None
    if kind is None:
        raise TemplateError(f"field {name!r} has neither cell, range nor computed")
    type_name = str(raw.get("type") or {"cell": "str", "range": "list[str]", "computed": "any"}[kind])
    if type_name not in TYPES:
        raise TemplateError(f"field {name!r}: unknown type {type_name!r}")
    columns = tuple(sorted((str(k), str(v)) for k, v in (raw.get("columns") or {}).items()))
    made = Field(name, kind, type_name, expression=raw.get("computed"), columns=columns, vertical=raw.get("orientation") == "vertical")
    if kind == "computed":
        return made
    ref = str(raw[kind])
    if kind == "cell" and (found := edge_ref(ref)):
        return replace(made, kind="edge", sheet=found[0], edge=found[1])
    try:
        at = area(ref)
    except ValueError as e:
        raise TemplateError(f"field {name!r}: {e}") from e
    if kind == "cell" and (at.start_row, at.start_col) != (at.end_row, at.end_col):
        raise TemplateError(f"field {name!r}: {ref!r} is not one cell")
    return replace(made, sheet=at.sheet, start_row=at.start_row, start_col=at.start_col, end_row=at.end_row, end_col=at.end_col)


def _chain(name: str, raw: dict[str, dict]) -> list[str]:
    """A version and its ancestors, the root first."""
    out: list[str] = []
    while name is not None:
        if name in out:
            raise TemplateError(f"inheritance cycle at version {name!r}")
        if name not in raw:
            raise TemplateError(f"unknown parent version {name!r}")
        out.append(name)
        name = None if (up := raw[name].get("extends")) is None else str(up)
    return out[::-1]


def template(raw: dict) -> Template:
    """A template from its configuration: inheritance resolved, defaults filled in, every reference parsed."""
    for key in ("name", "discriminator", "versions"):
        if not raw.get(key):
            raise TemplateError(f"template needs {key!r}")
    found = raw["discriminator"]
    cells = tuple(str(c) for c in (found.get("cells") or [found["cell"]] if found.get("cell") or found.get("cells") else []))
    if not cells:
        raise TemplateError("the discriminator names no cell")
    versions_raw = {str(k): v or {} for k, v in raw["versions"].items()}
    versions = {}
    for name in versions_raw:
        fields: dict[str, Field] = {}
        for step in _chain(name, versions_raw):
            rules = versions_raw[step].get("validation") or {}
            for key, spec in (versions_raw[step].get("fields") or {}).items():
                made, rule = _field(str(key), spec), rules.get(key) or {}
                fields[str(key)] = replace(made, low=rule.get("min"), high=rule.get("max"), pattern=rule.get("pattern"), required=bool(rule.get("required")))
        versions[name] = fields
    return Template(str(raw["name"]), cells, versions)


def load(path: str) -> list[Template]:
    """One template file, or all *.yaml of a folder by name."""
    import yaml

    found = sorted(Path(path).glob("*.yaml")) if Path(path).is_dir() else [Path(path)]
    if not found:
        raise TemplateError(f"no templates in {path}")
    return [template(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in found]


def fields_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row a field of each version, computed ones too: the table that jobs broadcast."""
    rows = [
        (t.name, i, v, f.name, k, f.kind, f.shape, f.type, ELEMENTS.get(f.type, f.type), f.sheet, f.start_row, f.start_col, f.end_row, f.end_col, *(f.edge or (None, None, None)), f.vertical, dict(f.columns), f.expression, f.low if f.low is None else float(f.low), f.high if f.high is None else float(f.high), f.pattern, f.required)
        for i, t in enumerate(templates)
        for v, fields in t.versions.items()
        for k, f in enumerate(fields.values())
    ]
    schema = "schema string, schema_ord int, version string, field string, field_ord int, ref_kind string, shape string, type string, element string, f_sheet string, start_row int, start_col int, end_row int, end_col int, edge_kind string, edge_page string, edge_section string, vertical boolean, columns map<string,string>, expression string, low double, high double, pattern string, required boolean"
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], schema + ", field_no int")
