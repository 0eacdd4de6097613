"""Crawl statuses: domains, ranks and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import month_window

#: Crawl statuses by rising severity.
STATUSES = ("Completed", "Partial", "Stale", "NoData", "Missing", "Error")
#: Audit actions.
ACTIONS = (
    "INSERT_LSP", "UPDATE_LSP", "DELETE_LSP", "INSERT_USER", "UPDATE_USER", "DELETE_USER", "RESET_PWD", "LOGIN",
    "LOGOUT", "URL_FINDER", "LSP_SUMMARY", "CRAWL", "INSERT_DLG_RAW", "UPDATE_DLG_RAW", "DELETE_DLG_RAW",
)
#: Kinds of lending service providers.
LSP_TYPES = (
    "Bank", "NBFC", "NBFC-AA", "NBFC-FinTech", "Lending Tech With In-house NBFC",
    "Lending Tech Without In-house NBFC", "Marketplace", "Multiproduct", "Other",
)


def severity(status: Column) -> Column:
    """1 (Completed) to 6 (Error); null if unknown."""
    out = F.lit(None).cast("int")
    for k, s in enumerate(STATUSES, 1):
        out = F.when(status == s, k).otherwise(out)
    return out


def of_severity(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, s in enumerate(STATUSES, 1):
        out = F.when(rank == k, s).otherwise(out)
    return out


def row_offence(portfolio: Column, amount: Column, as_on: Column, scraped: Column) -> Column:
    """What is wrong with a row: Partial, Stale, or null."""
    w = month_window(scraped)
    late = (F.year(as_on) != w["year"]) | (F.month(as_on) != w["month"])
    return F.when(portfolio.isNull() | amount.isNull(), "Partial").when(as_on.isNull() | F.coalesce(late, F.lit(False)), "Stale")


def manual_status(portfolio: Column, amount: Column, as_on: Column, scraped: Column) -> Column:
    return F.coalesce(row_offence(portfolio, amount, as_on, scraped), F.lit("Completed"))


def set_status(offence: Column, pos: Column) -> Column:
    """Aggregate: the first offence by position decides; none is Completed."""
    return F.coalesce(F.min_by(offence, F.when(offence.isNotNull(), pos)), F.lit("Completed"))


def staleness(status: Column, as_on_year: Column, as_on_month: Column, year: Column, month: Column) -> Column:
    """Completed, Partial and Stale become Stale where the as-on month is missing
    or not the window's."""
    late = as_on_year.isNull() | (as_on_year != year) | (as_on_month != month)
    return F.when(status.isin("Completed", "Partial", "Stale") & late, "Stale").otherwise(status)


def fetch_status(url: Column, failed: Column) -> Column:
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "Missing").when(failed, "Error")


def empty_month_message(rows: Column, year: Column, month: Column, today: Column) -> Column:
    """Said where nothing is there although the month's 8th has come."""
    open_from = F.make_date(year, month, F.lit(8))
    return F.when((rows == 0) & (today >= open_from), "No data scraped for this month. Please click rescrape to try again")
