"""Numbers that a number format shows as dates, times of day or durations. All Columns, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What of a number format's first section is no code (quoted text, brackets but for elapsed time, escaped
#: characters), the letters of dates and times, and elapsed time. Read alike by Python and Java.
FORMAT_TEXT = r'"[^"]*"|\[(?!(?:[hH]+|[mM]+|[sS]+)\])[^\]]*\]|[\\_].'
DATE_LETTERS = r"[dmyhsDMYHS]"
ELAPSED = r"\[(?:[hH]+|[mM]+|[sS]+)\]"
#: Day numbers of the first and after the last day that there is, and how many days a duration may last.
FIRST_DAY, END_DAY, MOST_DAYS = -693_593, 2_958_466, 999_999_999
DAY_MS = 86_400_000


def _codes(code: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(code, r"^[^;]*", 0), FORMAT_TEXT, "")


def is_date_format(code: Column) -> Column:
    """Whether a number format shows dates or times: its first section has one of their letters, but in quotes, brackets or escaped."""
    return _codes(code).rlike(DATE_LETTERS)


def is_duration_format(code: Column) -> Column:
    """Whether a number format shows elapsed time, such as [h]:mm."""
    return _codes(code).rlike(ELAPSED)


def _day_ms(serial: Column) -> Column:
    return F.bround((serial - F.floor(serial)) * DAY_MS).try_cast("long")


def serial_date(serial: Column) -> Column:
    """The timestamp of a spreadsheet's day number (1900 system), to the millisecond; null outside the years 1 to 9999.

    The system has a 29 February 1900, so day numbers below 60 count from a day later.
    """
    day = F.floor(serial).try_cast("int") + F.when((serial > 0) & (serial < 60), 1).otherwise(0)
    at = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(day, F.lit(0), F.lit(0), _day_ms(serial) / 1000)
    return F.when((serial >= FIRST_DAY) & (serial < END_DAY), at)


def _clock(ms: Column, hours: str) -> Column:
    part = lambda unit, most: F.pmod(F.floor(ms / unit), F.lit(most))
    shown = F.format_string(f"{hours}:%02d:%02d", part(3_600_000, 24), part(60_000, 60), part(1_000, 60))
    return F.concat(shown, F.when(F.pmod(ms, F.lit(1_000)) != 0, F.format_string(".%03d000", F.pmod(ms, F.lit(1_000)))).otherwise(""))


def shown_date(serial: Column) -> Column:
    """kind, text, ts of a number that a format shows as a date: below 1 a time of day, as text; #VALUE! where no date is."""
    ms, at = _day_ms(serial), serial_date(serial)
    whole = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format(at, "SSS") != "000", F.date_format(at, ".SSSSSS")).otherwise(""))
    none = F.lit(None).cast("timestamp_ntz")
    return (
        F.when((serial >= 0) & (serial < 1) & (ms < DAY_MS), F.struct(F.lit("s").alias("kind"), _clock(ms, "%02d").alias("text"), none.alias("ts")))
        .when(at.isNotNull(), F.struct(F.lit("t").alias("kind"), whole.alias("text"), at.alias("ts")))
        .otherwise(F.struct(F.lit("e").alias("kind"), F.lit("#VALUE!").alias("text"), none.alias("ts")))
    )


def shown_duration(serial: Column) -> Column:
    """kind, text, ts of a number of days that a format shows as elapsed time: `2 days, 3:00:00`, as text."""
    ms = F.bround(serial * DAY_MS).try_cast("long")
    days = F.floor(ms / DAY_MS)
    lead = F.when(days == 0, "").otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")))
    none = F.lit(None).cast("timestamp_ntz").alias("ts")
    return F.when(F.abs(serial) <= MOST_DAYS, F.struct(F.lit("s").alias("kind"), F.concat(lead, _clock(ms, "%d")).alias("text"), none)).otherwise(F.struct(F.lit("e").alias("kind"), F.lit("#VALUE!").alias("text"), none))
