"""Row predicates and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import month_range
from disclosa.functions.text import normalise, strip

#: Texts that make a row a header when they are all of a cell.
HEADER_WORDS = (
    "portfolio", "lender", "amount", "outstanding", "aum", "dlg", "name", "partner", "regulated entity",
    "business segment", "cohort", "set", "total no", "s.no", "s no", "serial", "sr", "particulars",
    "portfolio name", "lender name",
)
#: Words of total rows.
TOTAL_WORDS = ("total", "grand total", "sum", "aggregate", "overall", "combined", "consolidated")


def shown_names(master: DataFrame) -> DataFrame:
    """Sources under the names that reports show."""
    return master.select(F.col("id").alias("lsp_id"), F.col("name").alias("lsp"), F.col("brand_name").alias("brand"), F.coalesce("dlg_url", F.lit("NA")).alias("url"))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Amounts and as-on years with 0 for null."""
    return raw.withColumns({"amount": F.coalesce("amount", F.lit(0.0)), "as_on_year": F.coalesce(F.year("as_on_timestamp"), F.lit(0))})


def scraped_between(df: DataFrame, start: dt.datetime, end: dt.datetime, col: str = "scrape_timestamp") -> DataFrame:
    """Both ends belong to it; the bounds reach the scan."""
    return df.where(F.col(col).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def equal_where_given(df: DataFrame, zero_counts: bool = False, **values) -> DataFrame:
    """Equality on each given value; None, '' and (unless ``zero_counts``) 0 give no filter."""
    for c, v in values.items():
        if v is not None and (v or (zero_counts and v == 0 and v is not False)):
            df = df.where(F.col(c) == v)
    return df


def active_rows(df: DataFrame, active_only: bool = True) -> DataFrame:
    """Active rows, or only the inactive ones; null is neither."""
    return df.where(F.col("active") == F.lit(active_only))


def containing(df: DataFrame, text: str | None, *cols: str) -> DataFrame:
    """Any of the columns contains the text, ignoring case; % and _ keep their meaning."""
    if not text:
        return df
    found = F.lit(False)
    for c in cols:
        found = found | F.col(c).ilike(f"%{text}%")
    return df.where(found)


def logged_between(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None, col: str = "log_timestamp") -> DataFrame:
    """From start to end, each optional; an end at midnight leaves out its day."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast("timestamp_ntz"))
    return df


def in_month(df: DataFrame, year: int, month: int, col: str = "scrape_timestamp") -> DataFrame:
    return df.where(month_range(F.col(col), year, month))


def scraped_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a scrape time, one row with the number of those without)."""
    return df.where(F.col("scrape_timestamp").isNotNull()), df.agg(F.count_if(F.col("scrape_timestamp").isNull()).alias("n_null"))


def keep_by_rule(cells: Column, column: str, value: str, ignore_case: bool = False) -> Column:
    """The cell equals the value; a missing column is ''."""
    cell = normalise(F.try_element_at(cells, F.lit(column)), ignore_case)
    return cell == F.lit(value.strip().lower() if ignore_case else value.strip())


def drop_by_rule(cells: Column, column: str, value: str | None = None, regex: str | None = None, ignore_case: bool = False) -> Column:
    """Whether a row stays when rows with this value or pattern go."""
    if regex is not None:
        return ~normalise(F.try_element_at(cells, F.lit(column))).rlike(("(?i)" if ignore_case else "") + regex)
    return ~keep_by_rule(cells, column, value or "", ignore_case)


def raw_total(cells: Column, forced: Column) -> Column:
    """A cell has the word total, unless the row is forced in."""
    return ~forced & F.exists(F.map_values(cells), lambda x: F.coalesce(x.rlike(r"(?i)\btotal\b"), F.lit(False)))


def header_row(portfolio: Column, lender: Column) -> Column:
    is_word = lambda x: F.coalesce(normalise(x, True).isin(*HEADER_WORDS), F.lit(False))
    return is_word(portfolio) | is_word(lender)


def total_row(lsp_name: Column, lender: Column, portfolio: Column) -> Column:
    """Needs a portfolio; its text or the lender's starts with a total word, or any
    text of the row (the source's name too) contains one."""
    starts = "^(?:" + "|".join(TOTAL_WORDS) + ")"
    anywhere = "|".join(TOTAL_WORDS)
    some = normalise(portfolio, True).rlike(starts) | normalise(lender, True).rlike(starts)
    for x in (lsp_name, lender, portfolio):
        some = some | F.coalesce(F.lower(x).rlike(anywhere), F.lit(False))
    return (F.coalesce(portfolio, F.lit("")) != "") & some


def empty_row(lender: Column, portfolio: Column, amount: Column) -> Column:
    """Nothing at all, or an amount of neither lender nor portfolio."""
    return lender.isNull() & portfolio.isNull()


def missing_fields(**cols: Column) -> Column:
    """Names of the empty columns; 0 counts as empty."""
    empty = lambda x: x.isNull() | (x.cast("string") == "") | F.coalesce(x.cast("string").try_cast("double") == 0, F.lit(False))
    return F.array_compact(F.array(*(F.when(empty(c), F.lit(n)) for n, c in cols.items())))


def asset_url(url: Column) -> Column:
    return url.rlike(r"(?i)\.(jpg|jpeg|png|gif|svg|webp|css|js|ico|zip|mp4)(\?|#|$)")


def bad_href(href: Column) -> Column:
    h = normalise(href, True)
    return (h == "") | h.rlike(r"^(mailto:|tel:|javascript:|whatsapp:|intent:)") | h.isin("#", "/#", "#/")


def same_site(origin: Column, candidate: Column) -> Column:
    """The same host and port, or a relative candidate."""
    net = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return (net(candidate) == "") | (net(candidate) == net(origin))
