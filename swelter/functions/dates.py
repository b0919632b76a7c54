"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of "no date" in admission files.
BLANK_DATES = ("", "na", "nan", "n/a", "null")

# Tried in this order; the first two are the documented formats, the rest stand in for
# free-form date inference.
DATE_FORMATS = (
    "yyyy-M-d",
    "M/d/yyyy",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d'T'H:m:s",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "M/d/yyyy h:m:s a",
    "M/d/yyyy h:m a",
    "yyyyMMdd",
    "yyyy/M/d",
    "M-d-yyyy",
    "M.d.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "d MMMM yyyy",
)

# Tried last: years of two digits, 69 to 99 in the 20th century as in POSIX.
SHORT_YEAR_FORMATS = ("M/d/yy", "M/d/yy H:m:s", "M/d/yy H:m", "M/d/yy h:m:s a", "M/d/yy h:m a", "M-d-yy")
FIRST_SHORT_YEAR = 1969

# Fixed value: eight-digit dates of the 20th and 21st century, not inside a longer number.
DATE_TOKEN = r"(?<!\d)(19\d{6}|20\d{6})(?!\d)"

# Fixed value: day number of 1970-01-01 in the proleptic day count used by .mat files.
DATENUM_EPOCH = 719529


def strip(text: Column) -> Column:
    """Remove any white space at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_date_safe(text: Column) -> Column:
    """Timestamp without zone, or NULL when the text is blank or no known date.

    Fractions of a second and the zone behind a time are cut off: the clock time counts.
    """
    clean = strip(text)
    plain = F.regexp_replace(clean, r"(\d:\d\d)(\.\d+)?\s*(Z|UTC|[+-]\d\d:?\d\d)?$", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)\s*a\.?m\.?$", " AM"), r"(?i)\s*p\.?m\.?$", " PM")
    parse = lambda fmt: F.try_to_timestamp(plain, F.lit(fmt)).cast("timestamp_ntz")
    short = F.coalesce(*map(parse, SHORT_YEAR_FORMATS))
    early = F.year(short) >= FIRST_SHORT_YEAR + 100
    short = F.when(early, short - F.make_ym_interval(F.lit(100))).otherwise(short)
    return F.when(~F.lower(clean).isin(*BLANK_DATES), F.coalesce(*map(parse, DATE_FORMATS), short))


def to_yyyymmdd(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def from_yyyymmdd(value: Column) -> Column:
    return F.try_to_timestamp(value.cast("bigint").cast("string"), F.lit("yyyyMMdd")).cast("date")


def datenum_to_date(value: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(value) - DATENUM_EPOCH).cast("int"))


def parse_dates_mixed(number: Column, text: Column) -> Column:
    """Date from a day number where there is one, otherwise from ISO text."""
    iso = strip(text)
    from_text = F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(iso, F.lit("yyyyMMdd")).cast("date"),
        F.try_to_timestamp(iso).cast("date"),
    )
    return F.coalesce(datenum_to_date(number), from_text)


def dates_from_strings(df: DataFrame, text: str, order: str) -> DataFrame:
    """Distinct valid dates found anywhere in ``text``, with where each was first seen.

    Columns: ``d``, ``first_row`` (value of ``order``) and ``first_pos`` (match number in it).
    """
    found = df.select(
        F.col(order).alias("first_row"),
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DATE_TOKEN), F.lit(1))).alias("first_pos", "token"),
    ).select("first_row", "first_pos", F.try_to_timestamp("token", F.lit("yyyyMMdd")).cast("date").alias("d"))
    first = F.min(F.struct("first_row", "first_pos")).alias("at")
    return found.where(F.col("d").isNotNull()).groupBy("d").agg(first).select("d", "at.first_row", "at.first_pos")


def admit_parts(d: Column) -> dict[str, Column]:
    """Year, month, day of year and weekday (Sunday = 1) of an admission date."""
    return {
        "admit_year": F.year(d),
        "admit_month": F.month(d),
        "admit_dayofyear": F.dayofyear(d),
        "admit_weekday": F.dayofweek(d),
    }


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def length_of_stay(admit: Column, discharge: Column, long_days: int = 3) -> dict[str, Column]:
    """Whole days between two timestamps and the two flags derived from it.

    A negative stay counts as missing and sets ``invalid_length_of_stay``; a missing date does not.
    """
    raw = F.datediff(discharge, admit) - F.when(
        _second_of_day(discharge) < _second_of_day(admit), F.lit(1)
    ).otherwise(F.lit(0))
    los = F.when(raw >= 0, raw.cast("double"))
    return {
        "length_of_stay_days": los,
        "long_stay_3plus": (los >= long_days).cast("double"),
        "invalid_length_of_stay": F.coalesce((raw < 0).cast("double"), F.lit(0.0)),
    }


def in_season(d: Column, months: tuple[int, ...] = (5, 6, 7, 8, 9)) -> Column:
    return F.month(d).isin(*months)
