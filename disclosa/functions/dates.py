"""Dates: windows, period ends, date texts, month tokens of URLs."""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once, strip

#: First letters of the months in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Month names as they stand in URLs.
NAMED = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def month_window(ts: Column) -> Column:
    """struct(year, month) of the calendar month before; null stays null."""
    before = F.add_months(ts.cast("date"), -1)
    return F.when(ts.isNotNull(), F.struct(F.year(before).alias("year"), F.month(before).alias("month")))


def previous_month_end(ts: Column) -> Column:
    return F.date_sub(F.trunc(ts.cast("date"), "month"), 1)


def previous_quarter_end(ts: Column) -> Column:
    return F.date_sub(F.trunc(ts.cast("date"), "quarter"), 1)


def subtract_months(ts: Column, n: int) -> Column:
    """First day of the month n months back."""
    return F.trunc(F.add_months(ts.cast("date"), -n), "month")


def month_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def month_range(ts: Column, year: int, month: int) -> Column:
    """The rows of a month as a half-open range, which scans can push down
    (year(ts) = y they cannot)."""
    lo = dt.datetime(year, month, 1)
    hi = dt.datetime(year + month // 12, month % 12 + 1, 1)
    return (ts >= F.lit(lo).cast("timestamp_ntz")) & (ts < F.lit(hi).cast("timestamp_ntz"))


def _month(name: Column) -> Column:
    at = F.position(F.lower(F.substring(name, 1, 3)), F.lit(MONTHS))
    return F.when((F.length(name) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _fitting(text: Column, pattern: str, of: Callable[[Column, Column, Column], Column]) -> Column:
    """``of`` the first three groups of the pattern's first match; where nothing fits
    null, without a group being taken or a date tried."""
    n = min(3, re.compile(pattern).groups)
    groups = F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, n + 1)))
    return F.when(F.rlike(text, F.lit(pattern)), once(groups, lambda g: of(*(F.get(g, F.lit(k)) for k in range(n)))))


def parse_date(text: Column) -> Column:
    """A date in a text, day first: 31.12.2025, 31-12-2025, 2025-12-31, 31 December
    2025, 31-Jan-26, November 30, 2025; Dec'25, Jan-2026 and Jan 2026 are the
    month's end.  Null where none of these is found."""
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    dmy = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
    named = r"\b(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}|\d{2})\b"
    american = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
    ended = r"\b([A-Za-z]{3,9})(?:['‘’]|[\s,-]+)(\d{4}|\d{2})\b"
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)

    def day_first(d, m, y):
        d, m = d.try_cast("int"), m.try_cast("int")
        return F.when((m > 12) & (d <= 12), _date(y, d, m)).otherwise(_date(y, m, d))

    return once(F.regexp_replace(strip(text.cast("string")), r"(\d+)(?:st|nd|rd|th)\b", "$1"), lambda t: F.coalesce(
        _fitting(t, iso, _date),
        _fitting(t, dmy, day_first),
        _fitting(t, named, lambda d, m, y: _date(year(y), _month(m), d)),
        _fitting(t, american, lambda m, d, y: _date(y, _month(m), d)),
        _fitting(t, ended, lambda m, y: F.last_day(_date(year(y), _month(m), F.lit("1")))),
    ))


def parse_date_by(text: Column, hint: Column) -> Column:
    """By one of the hints DD.MM.YYYY, DD-MM-YYYY, DD Month YYYY (with ordinal),
    Mon YYYY (the month's end), else any date; the hint is a column."""
    t = strip(text.cast("string"))
    found = parse_date(t)

    def leading(mark):
        p = rf"^(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})"
        return F.coalesce(_fitting(t, p, lambda d, m, y: _date(y, m, d)), found)

    return F.when(hint == "DD.MM.YYYY", leading(r"\.")).when(hint == "DD-MM-YYYY", leading("-")).when(hint == "Mon YYYY", F.last_day(found)).otherwise(found)


def parse_date_as(text: Column, hint: str) -> Column:
    return parse_date_by(text, F.lit(hint))


def any_date(text: str | None) -> dt.date | None:
    """Any wording, day first; a month and year alone is the month's end.  Parts
    that the text lacks come from 1 January 2000, so results do not depend on
    today."""
    from dateutil import parser

    t = re.sub(r"(\d+)(?:st|nd|rd|th)\b", r"\1", (text or "").strip())
    if iso := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        t = f"{iso[3]}.{iso[2]}.{iso[1]}"
    ended = re.fullmatch(r"([A-Za-z]{3,9})(?:['‘’-]|,?\s+)(\d{4}|\d{2})", t)
    if ended:
        t = f"{ended[1]} {ended[2] if len(ended[2]) == 4 else '20' + ended[2]}"
    t = re.sub(r"(\d{1,2})-([A-Za-z]{3,9})-(\d{2})$", r"\1-\2-20\3", t)
    try:
        found = parser.parse(t, dayfirst=True, fuzzy=True, default=dt.datetime(2000, 1, 1)).date() if t else None
    except (ValueError, OverflowError):
        return None
    return month_end(found) if found and ended else found


def month_end(day: dt.date) -> dt.date:
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


@functools.lru_cache(maxsize=1 << 16)
def _known_date(text: str | None) -> dt.date | None:
    """``any_date``; a worker remembers some texts, for the same wordings come again and again."""
    return any_date(text)


@F.pandas_udf(T.DateType())
def parse_date_fuzzy(texts: pd.Series) -> pd.Series:
    """``any_date`` for what ``parse_date`` leaves null."""
    return texts.map(_known_date)


def with_dates(df: DataFrame, text: str, day: str) -> DataFrame:
    """Adds the date in ``text``: by ``parse_date`` on the JVM, and only for texts that it
    leaves null and that are not blank by ``any_date`` in Arrow workers."""
    found = df.withColumn(day, parse_date(F.col(text)))
    missed = F.col(day).isNull() & (strip(F.coalesce(F.col(text).cast("string"), F.lit(""))) != "")
    return found.where(~missed).unionByName(found.where(missed).withColumn(day, parse_date_fuzzy(F.col(text).cast("string"))))


def url_month(url: Column) -> Column:
    """struct(year, month, token, family) of the first month and year in a URL:
    a named month with a year of 2 to 4 digits, else 20YY and a month number."""
    named = rf"(?i)({NAMED})([-_%20\s]??)(\d{{2,4}})"
    numeric = r"(20\d{2})[^0-9]{0,3}(0?[1-9]|1[0-2])"
    y, m = F.regexp_extract(url, named, 3), F.regexp_extract(url, named, 1)
    year = F.when(F.length(y) == 4, y.try_cast("int")).otherwise(y.try_cast("int") + 2000)
    by_name = F.struct(year.alias("year"), _month(m).alias("month"), F.regexp_extract(url, named, 0).alias("token"), F.lit("named").alias("family"))
    by_number = F.struct(F.regexp_extract(url, numeric, 1).try_cast("int").alias("year"), F.regexp_extract(url, numeric, 2).try_cast("int").alias("month"), F.regexp_extract(url, numeric, 0).alias("token"), F.lit("numeric").alias("family"))
    return F.when(url.rlike(named), by_name).when(url.rlike(numeric), by_number)


def month_token(token: Column, year: Column, month: Column) -> Column:
    """A token for another month in the same style: case and length of the name,
    separator, width of the year; numbers get a padded month."""
    first = F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")), F.lit("yyyy-MM-dd"))
    name, digits = F.regexp_extract(token, r"([A-Za-z]{3,9})", 1), F.regexp_extract(token, r"(\d{2,4})$", 1)
    full = F.date_format(first, "MMMM")
    styled = F.when(name == F.lower(name), F.lower(full)).when(name == F.upper(name), F.upper(full)).when(F.length(name) == 3, F.date_format(first, "MMM")).otherwise(full)
    sep = F.regexp_extract(token, r"[A-Za-z]([-_%20\s]??)\d{2,4}$", 1)
    width = F.when(F.length(digits) == 4, year.cast("string")).otherwise(F.substring(year.cast("string"), 3, 2))
    numeric = F.concat(year.cast("string"), F.regexp_extract(token, r"^20\d{2}([^0-9]{0,3})", 1), F.lpad(month.cast("string"), 2, "0"))
    return F.when(F.length(name) >= 3, F.concat(styled, sep, width)).otherwise(numeric)


def promoted_url(url: Column, now: Column) -> Column:
    """The URL for last month where its token is of the month before that, else null."""
    at, old, new = url_month(url), subtract_months(now, 2), subtract_months(now, 1)
    fits = (at["year"] == F.year(old)) & (at["month"] == F.month(old))
    return F.when(fits, F.replace(url, at["token"], month_token(at["token"], F.year(new), F.month(new))))


def end_of_month(ts: Column) -> Column:
    return F.last_day(ts.cast("date"))


def report_window(today: Column) -> tuple[Column, Column]:
    """From the 15th of last month to the end of the 15th of this month."""
    first = F.trunc(today.cast("date"), "month")
    return F.date_add(F.add_months(first, -1), 14), F.date_add(first, 15)


def scheduled_window(now: Column) -> tuple[Column, Column]:
    """The thirty days before and the day after."""
    return now - F.expr("INTERVAL 30 DAYS"), now + F.expr("INTERVAL 1 DAY")
