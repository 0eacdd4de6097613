"""From resolved rows to clean ones, and the status of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disclosa.functions.amounts import parse_amount, scale_lakhs, to_crores
from disclosa.functions.dates import parse_date
from disclosa.functions.status import row_offence, set_status
from disclosa.functions.text import without_placeholder
from disclosa.operators.filters import empty_row, header_row, raw_total, total_row
from disclosa.operators.windows import forward_fill, keep_first, sum_rows


def typed(rows: DataFrame) -> DataFrame:
    """amount_text and as_on_text of resolved rows to amount (crores) and as_on;
    rows that are normalised already (flag ``pre_normalised``) keep theirs."""
    amount = to_crores(scale_lakhs(parse_amount(F.col("amount_text")), F.col("headers")))
    pre = F.coalesce(F.col("pre_normalised"), F.lit(False)) if "pre_normalised" in rows.columns else F.lit(False)
    own = F.col("amount") if "amount" in rows.columns else F.lit(None).cast("double")
    day = F.col("as_on") if "as_on" in rows.columns else F.lit(None).cast("date")
    return rows.withColumns({
        "lender": without_placeholder(F.col("lender")),
        "portfolio": without_placeholder(F.col("portfolio"), dashes=True),
        "amount": F.when(pre, to_crores(own)).otherwise(amount),
        "as_on": F.when(pre, day).otherwise(parse_date(F.col("as_on_text"))),
    })


#: What a rule may fill from above.
FILLABLE = ("lender", "portfolio", "amount", "as_on")


def cleaned(rows: DataFrame, fill: list[str] = (), source: str = "source_id", pos: str = "row_pos") -> DataFrame:
    """Rows without totals, empty rows, repeats, headers and sums; then blanks of
    the columns ``fill``, and of those that a row's array ``fill`` names, filled from
    above.  Forced rows stay; sums are sought among rows of a name, so without one none."""
    forced = F.coalesce(F.col("force_include"), F.lit(False)) if "force_include" in rows.columns else F.lit(False)
    if "cells" in rows.columns:
        rows = rows.where(~F.coalesce(raw_total(F.col("cells"), forced), F.lit(False)))
    rows = rows.where(~empty_row(F.col("lender"), F.col("portfolio"), F.col("amount")) | forced)
    rows = keep_first(rows, [source, "lsp_name", "lender", "portfolio", "amount", "as_on"], [F.col(pos)])
    rows = rows.where(forced | ~(header_row(F.col("portfolio"), F.col("lender")) | total_row(F.col("lsp_name"), F.col("lender"), F.col("portfolio"))))
    named = F.coalesce(F.col("lsp_name"), F.lit("")) != ""
    rows = sum_rows(rows, [source, "lsp_name"]).where(forced | ~(F.col("is_sum") & named)).drop("is_sum")
    if "fill" in rows.columns:
        own = [c for c in FILLABLE if c in rows.columns and c not in fill]
        rows = forward_fill(rows, own, [source], [F.col(pos)], "__filled")
        rows = rows.withColumns({c: F.when(F.array_contains("fill", c), F.col(f"{c}__filled")).otherwise(F.col(c)) for c in own}).drop("fill", *(f"{c}__filled" for c in own))
    return forward_fill(rows, list(fill), [source], [F.col(pos)]) if fill else rows


def statuses(sources: DataFrame, rows: DataFrame, source: str = "source_id", pos: str = "row_pos", scraped: str = "scrape_ts") -> DataFrame:
    """(source_id, status): Error where extraction failed, NoData without rows
    (filtered out or never there), else by the first offending row."""
    judged = rows.withColumn("offence", row_offence(F.col("portfolio"), F.col("amount"), F.col("as_on"), F.col(scraped)))
    found = judged.groupBy(source).agg(set_status(F.col("offence"), F.col(pos)).alias("status"))
    failed = F.col("error").isNotNull() if "error" in sources.columns else F.lit(False)
    status = F.when(failed, "Error").otherwise(F.coalesce("status", F.lit("NoData")))
    return sources.join(found, source, "left").select(source, status.alias("status"))


def carried_amounts(lines: DataFrame, by: list[str], order: list) -> DataFrame:
    """Typed lines (kind 'amount' or 'portfolio'): each portfolio without an
    amount of its own takes one that stands alone since the portfolio before."""
    w = Window.partitionBy(*by).orderBy(*order)
    seg = lines.withColumn("segment", F.coalesce(F.sum(F.when(F.col("kind") == "portfolio", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*by, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == "amount", F.col("amount")), ignorenulls=True).over(within)
    return seg.withColumn("amount", F.coalesce(F.when(F.col("kind") == "portfolio", F.col("amount")), last)).where(F.col("kind") == "portfolio").drop("segment")
