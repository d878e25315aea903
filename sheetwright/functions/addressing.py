"""Cell and range addresses, as Columns for data and as plain functions for templates. 1-based throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last column letters a sheet can have are XFD.
MAX_LETTERS = 3
CELL = r"^([A-Z]{1,3})([1-9][0-9]*)$"
RANGE = r"^([A-Z]{1,3})([1-9][0-9]*):([A-Z]{1,3})([1-9][0-9]*)?$"


def letters_to_index(letters: Column) -> Column:
    """'A' is 1, 'AA' is 27; null for anything that isn't one to three letters."""
    up = F.upper(letters)
    value = F.aggregate(F.transform(F.split(up, ""), lambda c: F.ascii(c) - 64), F.lit(0), lambda a, d: a * 26 + d)
    return F.when(up.rlike("^[A-Z]{1,3}$"), value)


def index_to_letters(index: Column) -> Column:
    """The inverse, up to three letters; null below 1."""
    char = lambda n: F.char(F.lit(65) + n)
    n = index - 1
    one = char(n % 26)
    two = char(F.floor((n - 26) / 26) % 26)
    three = char(F.floor((n - 702) / 676))
    return F.when(index < 1, None).when(n < 26, one).when(n < 702, F.concat(two, one)).when(n < 18278, F.concat(three, two, one))


def split_sheet(ref: Column) -> tuple[Column, Column]:
    """Sheet (null: the first sheet) and the rest in upper case; the sheet ends at the first '!'."""
    at = F.instr(ref, "!")
    return F.when(at > 0, F.substring_index(ref, "!", 1)), F.upper(F.when(at > 0, F.substr(ref, at + 1)).otherwise(ref))


def parse_cell(ref: Column) -> Column:
    """struct(sheet, row, col); row and col are null if the reference is invalid."""
    sheet, rest = split_sheet(ref)
    ok = rest.rlike(CELL)
    return F.struct(
        sheet.alias("sheet"),
        F.when(ok, F.regexp_extract(rest, CELL, 2).try_cast("int")).alias("row"),
        F.when(ok, letters_to_index(F.regexp_extract(rest, CELL, 1))).alias("col"),
    )


def parse_range(ref: Column) -> Column:
    """struct(sheet, start_row, start_col, end_row, end_col); a null end_row of a valid range is open."""
    sheet, rest = split_sheet(ref)
    ok = rest.rlike(RANGE)
    part = lambda k: F.when(ok, F.regexp_extract(rest, RANGE, k))
    return F.struct(
        sheet.alias("sheet"),
        part(2).try_cast("int").alias("start_row"),
        letters_to_index(part(1)).alias("start_col"),
        part(4).try_cast("int").alias("end_row"),
        letters_to_index(part(3)).alias("end_col"),
    )


def format_ref(sheet: Column, row: Column, col: Column, default_sheet: Column | None = None) -> Column:
    """'B3', with 'Sheet!' before it unless the sheet is null or the default one."""
    bare = F.concat(index_to_letters(col), row.cast("string"))
    plain = sheet.isNull() if default_sheet is None else sheet.isNull() | (sheet == default_sheet)
    return F.when(plain, bare).otherwise(F.concat(sheet, F.lit("!"), bare))


def format_range(sheet: Column, start_row: Column, start_col: Column, end_row: Column, end_col: Column, default_sheet: Column | None = None) -> Column:
    """'A1:D9', or 'A1:D' if open."""
    return F.concat(format_ref(sheet, start_row, start_col, default_sheet), F.lit(":"), index_to_letters(end_col), F.coalesce(end_row.cast("string"), F.lit("")))


@dataclass(frozen=True)
class Area:
    """An address in a template; end_row None means open-ended."""

    sheet: str | None
    start_row: int
    start_col: int
    end_row: int | None
    end_col: int


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def area(ref: str) -> Area:
    """A template's cell or range; ValueError if it is neither."""
    sheet, mark, rest = ref.partition("!")
    rest = (rest if mark else sheet).upper()
    name = sheet if mark else None
    if m := re.match(CELL, rest):
        row, col = int(m[2]), column_number(m[1])
        return Area(name, row, col, row, col)
    if m := re.match(RANGE, rest):
        return Area(name, int(m[2]), column_number(m[1]), int(m[4]) if m[4] else None, column_number(m[3]))
    raise ValueError(f"not a cell or range: {ref!r}")
