"""SCL-D: dates from text, day first. All are column expressions; the current year is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: month names as statements print them.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
TOKEN = r"\d{1,2}[-/ ](?:[A-Za-z]{3}|\d{1,2})[-/ ]\d{2,4}"


def _day(day: Column, month: Column, year: Column) -> Column:
    """``dd-Mon-yyyy`` of the parts."""
    return F.concat_ws("-", F.lpad(day, 2, "0"), F.initcap(F.lower(F.substring(month, 1, 3))), year.cast("string"))


def generic(s: Column) -> Column:
    """A full date in any of the usual orders, day before month, as DateType."""
    forms = [(r"^\d{1,2}[-/ ][A-Za-z]{3}[-/ ]\d{4}$", "d-MMM-yyyy", True), (r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$", "d-M-yyyy", True), (r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$", "yyyy-M-d", True)]
    out = None
    for pattern, form, _ in forms:
        t = F.try_to_timestamp(F.regexp_replace(s, r"[/ .]", "-"), F.lit(form)).cast("date")
        out = F.when(s.rlike(pattern), t) if out is None else out.when(s.rlike(pattern), t)
    return out


def smart_date(raw: Column, hint: Column | None = None, this_year: int = 2024) -> Column:
    """SCL-D1: ``dd-Mon-yyyy`` text or null. Full dates stay; short years are of this century; a single-digit year or none is
    the hint's or this one; bare years and times are no dates."""
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "­", ""))
    year = F.nullif(F.regexp_extract(F.trim(F.coalesce(hint if hint is not None else F.lit(""), F.lit(""))), r"^(20\d{2})(?:\s|$)", 1), F.lit(""))
    year = F.coalesce(year.cast("int"), F.lit(this_year))
    part = lambda p, k: F.regexp_extract(s, p, k)
    short, dm = r"^(\d{1,2})-([A-Za-z]{3})-(\d{1,2})$", r"^(\d{1,2})[\s\-]([A-Za-z]{3,9})$"
    month = F.lower(F.substring(part(dm, 2), 1, 3)).isin([m.lower() for m in MONTHS])
    short_year = F.when(F.length(part(short, 3)) == 2, part(short, 3).try_cast("int") + 2000).otherwise(year)
    return (
        F.when(F.length(s) < 4, None)
        .when(s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), s)
        .when(s.rlike(short), _day(part(short, 1), part(short, 2), short_year))
        .when(s.rlike(dm) & month, _day(part(dm, 1), part(dm, 2), year))
        .when(s.rlike(r"^20\d{2}$") | s.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), None)
        .otherwise(F.date_format(generic(s), "dd-MMM-yyyy"))
    )


def tabular_date(raw: Column) -> Column:
    """SCL-D2: ISO text; what cannot be read stays as it is."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.date_format(generic(s), "yyyy-MM-dd"), s)


def month_first(raw: Column) -> Column:
    """SCL-D3: month-first slashed date after a leading serial number."""
    token = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.date_format(F.try_to_timestamp(token, F.lit("M/d/yyyy")), "dd-MMM-yyyy")


def split_day_month(token: Column, year: Column) -> Column:
    """SCL-D4: ``dd-mm-`` and the statement's year."""
    p = r"^(\d{2})-(\d{2})-?$"
    d = F.make_date(year.cast("int"), F.regexp_extract(token, p, 2).try_cast("int"), F.regexp_extract(token, p, 1).try_cast("int"))
    return F.when(token.rlike(r"^\d{2}-(0[1-9]|1[0-2])-?$") & year.isNotNull(), F.date_format(d, "dd-MMM-yyyy"))


def is_date(raw: Column) -> Column:
    """SCL-D5: whether the text is a date in one of the four printed forms."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$|^\d{1,2}/\d{1,2}/\d{4}$|^\d{2}-[A-Za-z]{3}-\d{2}$|^\d{4}-\d{2}-\d{2}$")


def find_date(text: Column) -> Column:
    """SCL-D6: the first date token inside a text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), TOKEN, 0), F.lit(""))


def month_bucket(date: Column) -> Column:
    """SCL-D7: ``yyyy-MM`` or Unknown."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("Unknown"))


def front_end_date(raw: Column) -> Column:
    """SCL-D8: ISO text of a day-first date, null if it cannot be read."""
    return F.date_format(generic(F.trim(F.coalesce(raw, F.lit("")))), "yyyy-MM-dd")
