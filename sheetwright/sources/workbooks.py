"""Workbook files as cells: one Spark ingest job over OOXML packages, values only."""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addressing import column_number
from ..functions.dates import DATE_LETTERS, ELAPSED, FORMAT_TEXT
from ..functions.text import header_footer_sections
from .grid import CELLS, FORMATS, Workbooks
from .shared import cut

#: What counts as a workbook, which of them can be read, the built-in number formats by their numbers, and
#: built-in numbers without a code of their own that are dates.
SUFFIXES, READABLE = (".xlsx", ".xls", ".xlsm", ".xlsb"), (".xlsx", ".xlsm")
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
LOCAL_DATES = {*range(27, 37), *range(50, 59)}
EPOCH = dt.datetime(1899, 12, 30)
ROW = "what string, doc_id string, path string, sheet string, sheet_idx int, row int, col int, kind string, text string, num double, bool boolean, ts timestamp_ntz, emphasized boolean, hidden_col boolean, bottom int, right int, format string"
_NAMES = [c.split(" ")[0] for c in ROW.split(", ")]


def glob_filter(name: Column, relative: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """File name or relative path matches any of the globs; * crosses /."""
    flag = "(?i)" if ignore_case else ""
    out = F.lit(False)
    for p in patterns:
        rule = flag + fnmatch.translate(p).replace("\\Z", "$").replace("(?s:", "(?:").replace("\\z", "$")
        out = out | name.rlike(f"^{rule}") | relative.rlike(f"^{rule}")
    return out


def _files(spark: SparkSession, paths: str | list[str], include: list[str] | None, base: str | None) -> DataFrame:
    """The workbook files below folders or among files, without temporary ones; what isn't selected of them is not read."""
    several = sorted(set(paths)) if isinstance(paths, list) else paths
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(several)
    name = F.regexp_extract("path", "[^/]+$", 0)
    files = files.filter(F.lower(name).rlike(r"\.(xlsx|xls|xlsm|xlsb)$") & ~name.startswith("~$"))
    if include:
        relative = F.regexp_replace("path", f"^(file:)?/*{re.escape(base.strip('/'))}/", "") if base else F.col("path")
        files = files.filter(glob_filter(name, relative, include))
    return files


def list_workbooks(spark: SparkSession, paths: str | list[str], include: list[str] | None = None, base: str | None = None) -> DataFrame:
    """path, name, length of each workbook once; contents are not read."""
    return _files(spark, paths, include, base).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length").dropDuplicates(["path"])


def read_workbooks(spark: SparkSession, paths: str | list[str], include: list[str] | None = None, base: str | None = None) -> tuple[Workbooks, DataFrame]:
    """The workbooks of folders or files, and failures(path, error_kind, message) of those that can't be read.

    One task row a file: a package is parsed where it lies, its cells leave in batches, its bytes don't travel. A file that
    the paths name twice (a folder and one of its files) is parsed twice, and its rows are one by path.
    """
    parsed = cut(_files(spark, paths, include, base).select("path", "content").mapInPandas(parse_files, ROW), "workbooks")
    return split(parsed.distinct() if isinstance(paths, list) and len(paths) > 1 else parsed)


def split(rows: DataFrame) -> tuple[Workbooks, DataFrame]:
    """The tables of what parse_files emits."""
    pick = lambda what: rows.filter(F.col("what") == what)
    docs = pick("doc").select("doc_id", "path")
    sheets = pick("sheet").select("doc_id", "sheet", "sheet_idx", F.col("row").alias("n_rows"), F.col("col").alias("n_cols"))
    merges = pick("merge").select("doc_id", "sheet", F.col("row").alias("top"), F.col("col").alias("left"), "bottom", "right")
    hidden = pick("hidden").select("doc_id", "sheet", F.col("col").alias("left"), "right")
    raw = pick("edge").withColumn("s", header_footer_sections(F.col("text")))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.col(f"s.{k}").alias("t")) for k in ("left", "center", "right")]))
    edges = raw.select("doc_id", "sheet", "sheet_idx", "kind", parts.alias("p")).filter("p.t <> ''")
    edges = edges.select("doc_id", "sheet", "sheet_idx", F.lower(F.regexp_extract("kind", "(Header|Footer)$", 1)).alias("kind"), F.regexp_extract("kind", "^(odd|even|first)", 1).alias("page"), "p.section", F.col("p.t").alias("text"))
    cells = pick("cell").select(*[c.split(" ")[0] for c in CELLS.split(", ")])
    formats = pick("cell").filter("format IS NOT NULL").select(*[c.split(" ")[0] for c in FORMATS.split(", ")])
    return Workbooks(docs, sheets, cells, edges, merges, hidden, formats), pick("failure").select("path", F.col("kind").alias("error_kind"), F.col("text").alias("message"))


def parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows: list[dict] = []
            try:
                if not path.lower().endswith(READABLE):
                    rows = [{"what": "failure", "kind": "unsupported_format", "text": posixpath.splitext(path)[1]}]
                else:
                    for row in package(bytes(content)):
                        rows.append(row)
                        if len(rows) >= 20_000:
                            yield _frame(rows, path)
                            rows = []
                    rows.append({"what": "doc"})  # a file that breaks off is no document
            except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                rows = [{"what": "failure", "kind": "unreadable", "text": f"{type(e).__name__}: {e}"}]
            yield _frame(rows, path)


def _frame(rows: list[dict], path: str) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_NAMES).assign(doc_id=path, path=path)
    pdf["ts"] = np.array([r.get("ts") for r in rows], dtype="datetime64[us]")  # the years 1 to 9999
    for c in ("sheet_idx", "row", "col", "bottom", "right"):
        pdf[c] = pdf[c].astype("Int32")
    return pdf.astype({"num": "float64"}).astype({c: object for c in ("what", "sheet", "kind", "text", "bool", "emphasized", "hidden_col", "format")}).where(lambda d: d.notna(), None)


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ET.Element) -> str:
    """All runs of a string, without phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if _bare(child.tag) == "t" else child.iter() if _bare(child.tag) == "r" else []) if _bare(t.tag) == "t")


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ET.fromstring(z.read(rels))}


def format_shows(code: str | None) -> str:
    """What a number format shows: number, date or duration. As `is_date_format` and `is_duration_format` have it."""
    bare = re.sub(FORMAT_TEXT, "", (code or "").partition(";")[0])
    return "number" if not re.search(DATE_LETTERS, bare) else "duration" if re.search(ELAPSED, bare) else "date"


def _styles(z: zipfile.ZipFile) -> list[tuple[str, bool, str | None]]:
    """Of each cell style: what it shows, whether it is bold or filled, and its number format unless it is General."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    part = {_bare(x.tag): x for x in root}
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in part.get("numFmts", [])}
    bold = [any(_bare(x.tag) == "b" for x in f) for f in part.get("fonts", [])]
    filled = [any(x.get("patternType") not in (None, "none", "gray125") for x in f) for f in part.get("fills", [])]
    out = []
    for xf in part.get("cellXfs", []):
        n, font, fill = (int(xf.get(k, 0)) for k in ("numFmtId", "fontId", "fillId"))
        code = custom.get(n) or BUILT_IN.get(n)
        shows = "date" if code is None and n in LOCAL_DATES else format_shows(code)
        out.append((shows, (font < len(bold) and bold[font]) or (fill < len(filled) and filled[fill]), code if code != "General" else None))
    return out


def package(data: bytes) -> Iterator[dict]:
    """Rows of a workbook: cells, then the sheet, its merges and its page headers and footers, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        styles, targets = _styles(z), _relations(z, "xl/workbook.xml")
        book = ET.fromstring(z.read("xl/workbook.xml"))
        late = any(_bare(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book)
        shift = dt.timedelta(days=1462) if late else dt.timedelta()
        sheets = [s for x in book if _bare(x.tag) == "sheets" for s in x]
        for k, s in enumerate(sheets):
            name = s.get("name")
            link = next(v for a, v in s.attrib.items() if _bare(a) == "id")
            yield from _sheet(z.open(targets[link]), {"sheet": name, "sheet_idx": k}, strings, styles, shift)


def _sheet(part, of: dict, strings: list[str], styles: list[tuple[str, bool, str | None]], shift: dt.timedelta) -> Iterator[dict]:
    hidden: list[tuple[int, int]] = []
    formulas: dict[str, str] = {}
    row_at, col_at, n_rows, n_cols = 0, 0, 0, 0
    for event, node in ET.iterparse(part, events=("start", "end")):
        tag = _bare(node.tag)
        if event == "start":
            if tag == "row":
                row_at, col_at = int(node.get("r") or row_at + 1), 0
            continue
        if tag == "col" and node.get("hidden") in ("1", "true"):
            hidden.append((int(node.get("min")), int(node.get("max"))))
        elif tag == "c":
            m = re.match(r"([A-Z]+)(\d+)", node.get("r") or "")
            col_at = column_number(m[1]) if m else col_at + 1
            style = int(node.get("s") or 0)
            shows, bold, code = styles[style] if style < len(styles) else ("number", False, None)
            if value := _value(node, strings, shows, shift, formulas):
                n_rows, n_cols = max(n_rows, row_at), max(n_cols, col_at)
                yield {"what": "cell", **of, "row": row_at, "col": col_at, **value, "format": code if (node.get("t") or "n") == "n" and not value["text"].startswith("=") else None, "emphasized": bold, "hidden_col": any(lo <= col_at <= hi for lo, hi in hidden)}
        elif tag == "row":
            node.clear()
        elif tag == "mergeCell":
            a, _, b = node.get("ref").partition(":")
            (c1, r1), (c2, r2) = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in (a, b or a))
            yield {"what": "merge", **of, "row": int(r1), "col": column_number(c1), "bottom": int(r2), "right": column_number(c2)}
        elif re.fullmatch("(odd|even|first)(Header|Footer)", tag) and node.text:
            yield {"what": "edge", **of, "kind": tag, "text": node.text}
    for lo, hi in hidden:
        yield {"what": "hidden", **of, "col": lo, "right": hi}
    yield {"what": "sheet", **of, "row": n_rows, "col": n_cols}


def _from_serial(number: float, lasts: bool, shift: dt.timedelta) -> dict:
    """A number shown as a date, time or duration, as `shown_date` and `shown_duration` have it; days below 60 of the 1900 system count from a day later."""
    try:
        if lasts:
            return {"kind": "s", "text": str(dt.timedelta(milliseconds=round(number * 86_400_000)))}
        day, part = divmod(number, 1)
        clock = dt.timedelta(milliseconds=round(part * 86_400_000))
        if day == 0 and not clock.days:
            return {"kind": "s", "text": str((EPOCH + clock).time())}
        at = EPOCH + shift + dt.timedelta(days=day + (not shift and 0 < number < 60)) + clock
    except (OverflowError, ValueError):
        return {"kind": "e", "text": "#VALUE!"}
    return {"kind": "t", "text": str(at), "ts": at}


def _value(node: ET.Element, strings: list[str], shows: str, shift: dt.timedelta, formulas: dict[str, str]) -> dict | None:
    """kind, text, num, bool and ts of a cell; None if it has no value. Text is as Python prints the value; a formula without a result is =formula.

    formulas: the shared ones of the sheet so far, by number; a cell that shares one shows it as its first cell has it.
    """
    part = {_bare(x.tag): x for x in node}
    if "f" in part and part["f"].text and part["f"].get("si"):
        formulas[part["f"].get("si")] = part["f"].text
    kind = node.get("t") or "n"
    if kind == "inlineStr":
        return {"kind": "s", "text": _text(part["is"])} if "is" in part else None
    raw = part["v"].text if "v" in part and part["v"].text is not None else None
    if raw is None:
        if "f" in part and "v" not in part:  # never calculated
            formula = part["f"].text or formulas.get(part["f"].get("si"))
            return {"kind": "s", "text": f"={formula}"} if formula else None
        return {"kind": "s", "text": ""} if kind == "str" and "v" in part else None
    if kind == "s":
        return {"kind": "s", "text": strings[int(raw)]}
    if kind == "str":
        return {"kind": "s", "text": raw}
    if kind == "b":
        return {"kind": "b", "text": str(raw == "1"), "bool": raw == "1"}
    if kind == "e":
        return {"kind": "e", "text": raw}
    if kind == "d":
        at = dt.datetime.fromisoformat(raw.removesuffix("Z"))
        return {"kind": "t", "text": str(at), "ts": at}
    number = float(raw)
    if shows != "number":
        return _from_serial(number, shows == "duration", shift)
    if re.fullmatch(r"[+-]?\d+", raw):
        return {"kind": "i", "text": str(int(raw)), "num": number}
    return {"kind": "f", "text": repr(number), "num": number}
