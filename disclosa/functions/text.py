"""Text normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Spark's trim strips spaces only.
_EDGES = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, for which ``x`` is evaluated once, however often it is used there."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def normalise(x: Column, lower: bool = False) -> Column:
    """Null becomes '', the ends are stripped, optionally small letters."""
    out = strip(F.coalesce(x.cast("string"), F.lit("")))
    return F.lower(out) if lower else out


def filled(x: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(x.cast("string")), F.lit(""))


def without_placeholder(x: Column, dashes: bool = False) -> Column:
    """Null for '', 'None' and, with ``dashes``, one to three dashes."""
    bad = strip(x).isin("", "None")
    if dashes:
        bad = bad | strip(x).rlike(r"^-{1,3}$")
    return F.when(x.isNotNull() & ~bad, x)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, ignoring case, dots match line ends; rupee
    signs in the text read as '?'.  Null without a match."""
    plain = F.translate(text, "₹₨", "??")
    found = F.regexp_extract(plain, f"(?is){pattern}", group)
    return F.when(F.rlike(plain, F.lit(f"(?is){pattern}")), strip(found))


def portfolio_hint(line: Column) -> Column:
    """The first 'Portfolio <n>' of a line in title case."""
    return F.nullif(F.initcap(F.regexp_extract(line, r"(?i)(portfolio\s+\d+)", 1)), F.lit(""))


def safe_int(x: Column) -> Column:
    return strip(x.cast("string")).try_cast("int")


def safe_double(x: Column) -> Column:
    return strip(x.cast("string")).try_cast("double")


def parse_bool(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x.cast("string"), F.lit("none")))).isin("true", "1", "t", "yes", "y")


def status_of(x: Column, known: tuple[str, ...]) -> Column:
    """A known status, else null."""
    return F.when(strip(x).isin(*known), strip(x))
