"""Amounts in rupees, lakhs and crores as Column expressions; money is double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: From here on an amount is taken to be in rupees; rupees in a crore.
RUPEES_FROM, CRORE, LAKHS = 100_000, 10_000_000, 100
#: Characters that are misread digits, and the digits.
MISREAD = ("OoIl|SsBb/", "0011155887")


def parse_amount(x: Column) -> Column:
    """The first signed decimal, currency marks, commas and white space aside."""
    t = x.cast("string")
    for mark in ("₹", "INR", "Rs.", "Rs", ","):
        t = F.replace(t, F.lit(mark), F.lit(""))
    t = F.regexp_replace(t, r"(?U)\s+", "")
    return F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def to_crores(x: Column) -> Column:
    """Full rupees to crores; smaller and negative amounts stay."""
    return F.when(x >= RUPEES_FROM, F.round(x / F.lit(CRORE), 4)).otherwise(x)


def from_unit(x: Column, unit: Column) -> Column:
    """Crores of an amount in the unit that a source states (rupees if unknown)."""
    u = F.lower(F.coalesce(unit, F.lit("rupees")))
    return F.when(u.isin("crore", "crores", "cr"), x).when(u.isin("lakh", "lakhs"), x / LAKHS).otherwise(x / CRORE)


def lakh_headers(headers: Column) -> Column:
    return F.exists(headers, lambda h: h.rlike(r"(?i)\blakhs?\b"))


def scale_lakhs(x: Column, headers: Column) -> Column:
    return F.when(lakh_headers(headers), F.round(x / LAKHS, 4)).otherwise(x)


def coerce(text: Column, number: Column) -> Column:
    """Numbers as they are; texts parsed and scaled."""
    return F.coalesce(number, to_crores(parse_amount(text)))


def recover(lender: Column, portfolio: Column, amount: Column) -> tuple[Column, Column, Column]:
    """(lender, portfolio, amount): an amount that slid into the portfolio
    column, or else into the lender column, is put back."""
    in_portfolio = amount.isNull() & strip(portfolio).rlike(r"^[0-9₹]")
    a = F.when(in_portfolio, to_crores(parse_amount(portfolio))).otherwise(amount)
    in_lender = a.isNull() & lender.rlike(r"[0-9]") & ~strip(lender).rlike(r"^[0-9]{1,3}$")
    b = F.when(F.coalesce(in_lender, F.lit(False)), to_crores(parse_amount(lender))).otherwise(a)
    return (
        F.when(F.coalesce(in_lender, F.lit(False)), F.lit("")).otherwise(lender),
        F.when(F.coalesce(in_portfolio, F.lit(False)), F.lit("")).otherwise(portfolio),
        b,
    )


def ocr_digits(raw: Column) -> Column:
    """Digits misread as letters repaired; null below three digits; of several
    dots the first stays."""
    t = F.regexp_replace(F.translate(raw, *MISREAD), r"[^0-9.,-]", "")
    t = F.regexp_replace(t, r"^[.,]+|[.,]+$", "")
    first, rest = F.substring_index(t, ".", 1), F.regexp_replace(t, r"^[^.]*", "")
    joined = F.when(F.length(rest) > 0, F.concat(first, F.lit("."), F.replace(rest, F.lit("."), F.lit("")))).otherwise(t)
    return F.when(F.length(F.regexp_replace(t, r"[^0-9]", "")) >= 3, joined)


def ocr_amount(raw: Column) -> Column:
    return F.replace(ocr_digits(raw), F.lit(","), F.lit("")).try_cast("double")
