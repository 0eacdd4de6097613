"""Numbered tables and wordings of reports, as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import parse_date
from disclosa.functions.text import strip

#: The columns of a numbered table, those an amount may have moved to,
#: and the wordings of dates, totals and portfolio lines.
LENDER_COLUMN, AMOUNT_COLUMN, SPARE_COLUMNS = 1, 5, (3, 4, 5, 7, 8)
REPORT_DATE = r"(?i)date of data as on ([0-9]{1,2}(?:st|nd|rd|th)? [A-Za-z]+,? ?[0-9]{4})"
GRAND_TOTAL = r"(?is)total of\s+(\d+)\s+portfolios.*?amounting to\s+INR\s+([0-9.,]+)\s*Cr"
PORTFOLIO_LINE = r"(?i)^(portfolio\s*\d+)\s+([0-9,\s]+?)(?:\s+(?:yes|no))?\s*$"
REPAIRS = ((r"(?i)portfoliol", "Portfolio 1"), (r"(?i)portfolioi(?![a-z])", "Portfolio 1"), (r"(?i)(portfolio)(\d)", "$1 $2"))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _column(rules: Column, name: str, otherwise: int) -> Column:
    """The place that a rule 'col_N' names, else the usual one."""
    named = F.regexp_extract(F.get_json_object(rules, f"$.field_map.{name}"), r"^col_(\d+)$", 1)
    return F.coalesce(named.try_cast("int"), F.lit(otherwise))


def numbered_rows(tables: DataFrame) -> DataFrame:
    """Rows of numbered tables (source_id, row_no, cells array<string>, page_text,
    rules_json) in which cells may have moved: source_id, row_no, lender, amount, as_on.

    The lender stands in its column, else in the nearest filled one to the left that
    is no number; the amount in its column, else, if there is a lender, in the first
    spare one that holds a number.  Header and total rows, and rows without an amount,
    go; the date is the page's.
    """
    cells, rules = F.col("cells"), F.col("rules_json")
    lender_at, amount_at = _column(rules, "lender", LENDER_COLUMN), _column(rules, "amount", AMOUNT_COLUMN)
    cell = lambda at: strip(F.coalesce(F.get(cells, at), F.lit("")))
    digits = lambda at: F.regexp_extract(F.replace(cell(at), F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    first, own = F.lower(cell(F.lit(0))), cell(lender_at)
    left = F.filter(F.transform(F.reverse(F.slice(cells, 1, F.greatest(lender_at, F.lit(0)))), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    amount = F.coalesce(digits(amount_at), F.when(own != "", F.coalesce(*(digits(F.lit(c)) for c in SPARE_COLUMNS))))
    rows = tables.where(F.exists(cells, lambda x: x != "") & ~first.startswith("sl") & ~first.startswith("total") & (F.lower(own) != "lender"))
    as_on = parse_date(_filled(F.regexp_extract("page_text", REPORT_DATE, 1)))
    rows = rows.select("source_id", "row_no", F.coalesce(_filled(own), F.get(left, 0)).alias("lender"), amount.alias("amount"), as_on.alias("as_on"))
    return rows.where("amount is not null")


def grand_totals(docs: DataFrame) -> DataFrame:
    """'total of N portfolios ... amounting to INR X Cr' of texts (source_id, lsp_name,
    text, rules_json) as a row that later filters must keep (``force_include``)."""
    part = lambda k: _filled(F.regexp_extract("text", GRAND_TOTAL, k))
    spec = "$.field_map.as_on"
    constant = F.coalesce(F.get_json_object("rules_json", f"{spec}.constant"), F.get_json_object("rules_json", spec))
    amount = F.replace(part(2), F.lit(","), F.lit("")).try_cast("double")
    rows = docs.select("source_id", "lsp_name", F.lit(None).cast("string").alias("lender"), F.concat(F.lit("Grand Total ("), part(1), F.lit(" portfolios)")).alias("portfolio"), amount.alias("amount"), parse_date(constant).alias("as_on"), F.lit(True).alias("force_include"))
    return rows.where("amount is not null")


def report_text_rows(docs: DataFrame) -> DataFrame:
    """Lines 'Portfolio n amount [Yes|No]' of reports' texts (source_id, text, as_on),
    misread labels repaired: source_id, pos, lender, amount, as_on."""
    rows = docs.select("source_id", "as_on", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    for wrong, right in REPAIRS:
        line = F.regexp_replace(line, wrong, right)
    rows = rows.withColumn("line", line).where(F.col("line").rlike(PORTFOLIO_LINE))
    amount = F.regexp_replace(F.regexp_extract("line", PORTFOLIO_LINE, 2), r"[,\s]", "").try_cast("double")
    label = F.regexp_replace(F.regexp_extract("line", PORTFOLIO_LINE, 1), r"\s+", " ")
    return rows.select("source_id", "pos", label.alias("lender"), amount.alias("amount"), "as_on").where("amount is not null")
