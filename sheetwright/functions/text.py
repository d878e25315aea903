"""Labels, headers and values: what the text of a cell looks like. All Columns over text, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns and word lists that decide what a text looks like.
BOOL_WORDS = r"(?i)^(true|false|yes|no)$"
INT_TEXT = r"^-?\d+$"
FLOAT_TEXT = r"^-?\d+\.\d+$"
DATE_TEXT = r"^(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{1,2}-\d{1,2})$"
STATUS_WORDS = ("OK", "NQ", "CC", "PASS", "FAIL", "NO", "YES", "NQ, CC")
PLACEHOLDERS = ("n/a", "na", "none", "null", "-")
WEAK_WORDS = r"^(n/a|na|yes|no|true|false|pass|fail|ok)$"
VERSION_WORDS = r"(?i)\b(version|template|form|revision|rev)\b"
VERSION_TEXT = r"(?i)^v?\d+([._-]\d+)*$"
TABLE_TITLE = r"(?i)^table\s+\d+\s*:"
FORMULA = r"(?i)^(if|sum|mid|left|right|vlookup|xlookup|index|match|offset)\s*\("
LONG_LABEL, LONG_LABEL_WORDS, LONG_HEADER, LONG_IDENTIFIER, TITLE_LENGTHS = 48, 6, 64, 64, (6, 64)
#: Candidate patterns of rule mining, in order of preference: what every value must match, and the rule that it gives.
MINED = (
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "^[0-9a-fA-F-]{36}$"),
    (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}\/\d{1,2}\/\d{4}$"),
    ("^[A-Z0-9_-]+$", "^[A-Z0-9_-]+$"),
    ("^[a-z0-9_]+$", "^[a-z0-9_]+$"),
    ("^[A-Za-z0-9_-]+$", "^[A-Za-z0-9_-]+$"),
)


def _bare(text: Column) -> Column:
    """Without white space (the \\s of patterns) at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def slugify(text: Column) -> Column:
    """Lower case, without ()µ, other runs as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "()µ", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_label(text: Column) -> Column:
    """Without trailing : and *, white space collapsed."""
    return _bare(F.regexp_replace(F.regexp_replace(text, "[:*]+$", ""), r"\s+", " "))


def section_title(text: Column) -> Column:
    """A title without its 'Table 1:'; null if it doesn't read like one."""
    t = clean_label(F.regexp_replace(F.regexp_replace(text, r"(?i)^table\s+\d+\s*:\s*", ""), r"(?i)^section\s+\d+\s*:\s*", ""))
    ok = F.char_length(t).between(*TITLE_LENGTHS) & t.rlike("(?i)[a-z]") & ~_bare(text).rlike(r"(?i)^hidden table\b") & ~t.rlike(FORMULA) & ~t.rlike("[=()]")
    return F.when(ok, t)


def is_table_title(text: Column) -> Column:
    return _bare(text).rlike(TABLE_TITLE)


def value_type(kind: Column, text: Column) -> Column:
    """int, float, bool, date or str, of numbers by kind and of text by its look."""
    t = _bare(text)
    by_text = F.when(t.rlike(BOOL_WORDS), "bool").when(t.rlike(INT_TEXT), "int").when(t.rlike(FLOAT_TEXT), "float").when(t.rlike(DATE_TEXT), "date").otherwise("str")
    return F.when(kind == "i", "int").when(kind == "f", F.when(text.rlike(r"\.0$"), "int").otherwise("float")).when(kind == "b", "bool").when(kind == "s", by_text).otherwise("str")


def is_identifier(text: Column) -> Column:
    t = _bare(text)
    return (F.char_length(t) <= LONG_IDENTIFIER) & t.rlike("(?i)[a-z]") & t.rlike(r"\d") & t.rlike(r"(?i)^[a-z0-9._/\- ]+$")


def is_data_like(text: Column) -> Column:
    t = _bare(text)
    solid = ~t.rlike(r"\s")
    return t.rlike(r"^\d") | t.rlike("(?i)^(nq|nd|lod)[<>]") | (solid & (is_identifier(t) | t.rlike(r"(?i)^[A-Z0-9._-]{7,}$")))


def is_label(text: Column) -> Column:
    t = _bare(text)
    unlike = t.rlike("[<>=%]") | t.rlike(r"(?i)\d(\.\d+)?e[+-]?\d+") | t.rlike(r"^\d+([./-]\d+)*$")
    return (t != "") & (F.char_length(t) <= LONG_LABEL) & ~unlike & (F.size(F.split(t, r"\s+")) <= LONG_LABEL_WORDS) & t.rlike("(?i)[a-z]")


def is_status(text: Column) -> Column:
    return F.upper(_bare(text)).isin(*STATUS_WORDS)


def is_header(text: Column) -> Column:
    return is_label(text) & ~is_data_like(text) & ~is_status(text)


def is_version(text: Column) -> Column:
    return _bare(text).rlike(VERSION_TEXT) | text.rlike(r"(?i)\b(rev|revision)\b")


def is_placeholder(text: Column) -> Column:
    return text.isNull() | F.lower(_bare(text)).isin(*PLACEHOLDERS)


def normal(text: Column) -> Column:
    return F.lower(_bare(text))


def is_weak(text: Column) -> Column:
    """A value too common to find a field by."""
    n = normal(text)
    return (F.char_length(n) <= 2) | n.rlike(r"^\d+([./:-]\d+)*$") | n.rlike(WEAK_WORDS)


def header_score(kind: Column, text: Column) -> Column:
    """From -2 to 2: how much a cell looks like a column header."""
    t = _bare(text)
    worst = t.rlike("[<>=%]") | t.rlike(r"^\d+([./-]\d+)*$") | t.rlike("(?i)^(true|false|yes|no|ok|nq|nd)$") | t.rlike(r"(?i)^[A-Z0-9._-]{7,}$")
    return F.when((kind != "s") | (t == ""), 0).when(F.char_length(t) > LONG_HEADER, -1).when(worst, -2).when(t.rlike("(?i)[a-z]"), 2).otherwise(0)


def header_footer_sections(raw: Column) -> Column:
    """struct(left, center, right) of a page header or footer code; text before any &L, &C or &R is center."""
    mark, stop = "\ue000", "\ue001"  # private characters, for && and before each section
    safe = F.replace(raw, F.lit("&&"), F.lit(mark))
    parts = F.split(F.regexp_replace(safe, "&([LCR])", stop + "$1"), stop)

    def part(letter: str) -> Column:
        own = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(letter)), lambda p: F.substr(p, F.lit(2)))
        text = F.concat(F.element_at(parts, 1), F.array_join(own, "")) if letter == "C" else F.array_join(own, "")
        text = F.replace(text, F.lit(mark), F.lit("&"))
        for code in ('&"[^"]*"', "(?i)&K[0-9A-F]{6}", r"&\d+", "&[BIESUXY]", "&[PTNDAFZG]"):
            text = F.regexp_replace(text, code, "")
        return _bare(text)

    return F.struct(part("L").alias("left"), part("C").alias("center"), part("R").alias("right"))


def fuzzy_share(a: Column, b: Column) -> Column:
    """How many words of two slugs agree (equal, or one begins the other), over the larger number of words; 1 if equal."""
    x, y = F.split(a, "_"), F.split(b, "_")
    hits = F.size(F.filter(x, lambda t: F.exists(y, lambda u: (t == u) | t.startswith(u) | u.startswith(t))))
    return F.when(a == b, 1.0).otherwise(hits / F.greatest(F.size(x), F.size(y)))
