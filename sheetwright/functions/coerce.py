"""Typed values out of cells: the strict rules of extraction, and the lenient ones of interactive use.

A cell has kind ('s' text, 'i' int, 'f' float, 'b' bool, 'd' date, 't' datetime, 'e' error), text, num,
bool and ts. Every rule gives null where the value is null or does not convert; `failed` tells these apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
#: The words that the lenient rules take for true.
TRUE_WORDS = ("true", "1", "yes", "y")
LONG = 9.2e18


def float_text(num: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16."""
    size = F.abs(num)
    digits = F.regexp_replace(num.cast("decimal(38,17)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    whole = F.concat(num.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((num == 0) | ((size >= 1e-3) & (size < 1e7)), num.cast("string")).when((size >= 1e7) & (size < 1e16) & (num == F.floor(num)), whole).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.lower(num.cast("string")))


def _cell(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{n}") for n in ("kind", "text", "num", "bool", "ts"))


def to_int(prefix: str = "") -> Column:
    kind, text, num, boolean, _ = _cell(prefix)
    cut_off = F.when(F.abs(num) < LONG, F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)))
    return F.when(kind.isin("s", "i"), F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))).when(kind == "f", cut_off).when(kind == "b", boolean.cast("bigint"))


def to_float(prefix: str = "") -> Column:
    kind, text, num, boolean, _ = _cell(prefix)
    return F.when(kind == "s", F.when(text.rlike(DECIMAL), F.trim(text).try_cast("double"))).when(kind.isin("i", "f"), num).when(kind == "b", boolean.cast("double"))


def to_bool(prefix: str = "") -> Column:
    """Truthiness: text is true unless empty, so the text 'false' is true."""
    kind, text, num, boolean, _ = _cell(prefix)
    return F.when(kind.isin("i", "f"), num != 0).when(kind == "b", boolean).when(kind.isin("d", "t"), F.lit(True)).otherwise(text != "")


def to_datetime(prefix: str = "") -> Column:
    kind, text, _, _, ts = _cell(prefix)
    return F.when(kind.isin("d", "t"), ts).when(kind == "s", F.when(text.rlike(DATETIME), F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")))


def to_date(prefix: str = "") -> Column:
    kind, text, _, _, ts = _cell(prefix)
    return F.when(kind.isin("d", "t"), ts.cast("date")).when(kind == "s", F.when(text.rlike(DATE), text.try_cast("date")))


STRICT = {"str": lambda p="": F.col(f"{p}text"), "any": lambda p="": F.col(f"{p}text"), "int": to_int, "float": to_float, "bool": to_bool, "datetime": to_datetime, "date": to_date}


def lenient_bool(prefix: str = "") -> Column:
    kind, text, num, boolean, _ = _cell(prefix)
    return F.when(kind == "b", boolean).when(kind.isin("i", "f"), num != 0).otherwise(F.lower(F.trim(text)).isin(*TRUE_WORDS))


def lenient_int(prefix: str = "") -> Column:
    value = to_float(prefix)
    return F.when(F.abs(value) < LONG, F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)))


LENIENT = STRICT | {"int": lenient_int, "bool": lenient_bool}


def coerced(type_name: str, prefix: str = "", dialect: dict = STRICT) -> Column:
    return dialect[type_name](prefix)


def failed(type_name: str, prefix: str = "", dialect: dict = STRICT) -> Column:
    """There is a value, and it doesn't convert."""
    return F.col(f"{prefix}kind").isNotNull() & coerced(type_name, prefix, dialect).isNull()


def failed_by(type_column: Column, prefix: str = "", types: Iterable[str] = ("int", "float", "bool", "datetime", "date")) -> Column:
    """The same where the type is data. types: those that it may be; fewer of them keep the compiled method small."""
    out = F.lit(False)
    for name in sorted({"int", "float", "bool", "datetime", "date"}.intersection(types)):
        out = F.when(type_column == name, failed(name, prefix)).otherwise(out)
    return out
