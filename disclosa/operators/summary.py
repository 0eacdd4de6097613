"""Monthly summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import month_label, month_window
from disclosa.functions.status import STATUSES, of_severity, severity, staleness
from disclosa.functions.text import normalise, status_of

from .windows import forward_fill, forward_fill_parts, latest_filled


def distinct(x: Column, where: Column | None = None) -> Column:
    """Aggregate: the number of distinct values of a small group.  A set in the
    aggregate's buffer, so rows are neither expanded nor shuffled for each of several."""
    return F.size(F.collect_set(x if where is None else F.when(where, x)))


def portfolios_or_lenders(pair: Column, has_portfolio: Column, lender: Column) -> Column:
    """Distinct (lender, portfolio) pairs with a portfolio; without any, distinct lenders."""
    pairs = distinct(pair, has_portfolio)
    return F.when(pairs > 0, pairs).otherwise(distinct(lender)).cast("int")


def monthly_summary(raw: DataFrame, order: list[str]) -> DataFrame:
    """One row for each source and month window.

    The window and the aggregate group alike, so one shuffle serves both.  It is asked for,
    for where nothing of the fill is wanted the rows' groups, which are about as many as
    they, would be gathered before it in the tasks that sort for the raw rows' joins.  Rows
    without a scrape time drop out; ``order`` decides the lender fill and ties.
    """
    rows = raw.where(F.col("scrape_timestamp").isNotNull()).withColumn("w", month_window(F.col("scrape_timestamp")))
    rows = rows.withColumns({"scrape_year": F.col("w.year"), "scrape_month": F.col("w.month")}).drop("w")
    keys = ["lsp_id", "scrape_year", "scrape_month"]
    rows = forward_fill(rows.repartition(*keys), ["lender"], keys, order, "_filled")
    lender, portfolio = normalise(F.col("lender_filled"), True), normalise(F.col("portfolio"))
    own = F.nullif(normalise(F.col("lender"), True), F.lit(""))
    tie = F.struct(*order)
    as_on = F.max("as_on_timestamp")
    out = rows.groupBy(*keys).agg(
        F.coalesce(latest_filled(F.col("lsp_name"), F.col("scrape_timestamp"), tie), F.concat(F.lit("LSP-"), F.first("lsp_id").cast("string"))).alias("name"),
        distinct(own).cast("int").alias("total_lenders"),
        portfolios_or_lenders(F.struct(lender, portfolio), portfolio != "", F.nullif(lender, F.lit(""))).alias("total_portfolios"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
        latest_filled(F.col("dlg_url"), F.col("scrape_timestamp"), tie).alias("dlg_url"),
        F.year(as_on).alias("as_on_year"),
        F.month(as_on).alias("as_on_month"),
        F.coalesce(of_severity(F.max(severity(status_of(F.col("complete"), STATUSES)))), F.lit("Missing")).alias("status"),
        F.max("scrape_timestamp").alias("last_crawl_date"),
    )
    return out.withColumn("status", staleness(F.col("status"), F.col("as_on_year"), F.col("as_on_month"), F.col("scrape_year"), F.col("scrape_month")))


def day_parts(raw: DataFrame) -> DataFrame:
    """What a day of a source keeps to be merged: its distinct (lender, portfolio) pairs,
    exact texts stripped, lenders in small letters, with sums and counts of their rows.
    A day is made once; months and totals come from days (``merged_days``)."""
    keys = [F.col("lsp_id"), F.to_date("scrape_timestamp").alias("day"), normalise(F.col("lender"), True).alias("lender"), normalise(F.col("portfolio")).alias("portfolio")]
    rows = raw.where(F.col("scrape_timestamp").isNotNull())
    return rows.groupBy(*keys).agg(F.sum("amount").alias("amount"), F.count("*").alias("n_rows"))


def merged_days(days: DataFrame, by: list, names: list[str]) -> DataFrame:
    """Exact distinct lenders, portfolios and pairs of ``by`` (columns named ``names``)
    from stored days.  Equal pairs of several days are merged first, so a group's values
    are spread over tasks and no task holds a set of them."""
    pairs = days.groupBy(*[c.alias(n) for c, n in zip(by, names)], "lender", "portfolio").agg(F.sum("amount").alias("amount"), F.sum("n_rows").alias("n_rows"))
    amounts = pairs.groupBy(*names).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"), F.sum("n_rows").alias("n_rows"), F.count_if((F.col("lender") != "") | (F.col("portfolio") != "")).alias("pairs"))
    for col, name in (("lender", "lenders"), ("portfolio", "portfolios")):
        own = pairs.where(F.col(col) != "").select(*names, col).distinct().groupBy(*names).agg(F.count("*").alias(name))
        amounts = amounts.join(own, names, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return amounts


def graph_rollup(summary: DataFrame) -> DataFrame:
    """Sums for each 'YYYY-MM'."""
    label = month_label(F.col("scrape_year"), F.col("scrape_month")).alias("month_year")
    zero = lambda c, z: F.coalesce(F.sum(c), F.lit(z))
    return summary.groupBy(label).agg(zero("total_lenders", 0).alias("total_lenders"), zero("total_portfolios", 0).alias("total_portfolios"), zero("total_amount", 0.0).alias("total_amount"))


def running_totals(rows: DataFrame) -> DataFrame:
    """Totals over a result; null counts add nothing."""
    zero = lambda c, z: F.coalesce(F.sum(c), F.lit(z))
    return rows.agg(zero("total_portfolios", 0).alias("total_portfolios"), zero("total_amount", 0.0).alias("total_amount"), zero("total_lenders", 0).alias("total_lenders"))


def raw_totals(raw: DataFrame, by: list[str], order: list, part: Column | None = None, part_order: Column | None = None) -> DataFrame:
    """Totals of the raw pages: exact texts count, a null lender may stand in a pair.
    With ``part`` the fill goes part by part (``forward_fill_parts``)."""
    rows = forward_fill(raw, ["lender"], by, order, "_filled") if part is None else forward_fill_parts(raw, ["lender"], by, part, order, part_order, "_filled")
    has = F.coalesce(normalise(F.col("portfolio")), F.lit("")) != ""
    pairs = F.count_distinct(F.when(has, F.struct("lender_filled", "portfolio")))
    lenders = F.count_distinct("lender_filled")
    return rows.agg(F.when(pairs > 0, pairs).otherwise(lenders).alias("total_portfolios"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"), lenders.alias("total_lenders"))


def amounts_of(df: DataFrame, by: list[str], amount: str = "amount") -> DataFrame:
    """The sum for each group, 0 without amounts."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"))


def lender_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct lenders of each group, ignoring case and blanks."""
    return df.groupBy(*by).agg(F.count_distinct(F.nullif(normalise(F.col("lender"), True), F.lit(""))).alias("lenders"))


def null_count(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias("n_null"))


def best_candidate(df: DataFrame, by: list[str], value: str = "url", score: str = "score", pos: str = "pos") -> DataFrame:
    """The value of the best score, the first on ties."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.col(score), -F.col(pos))).alias(value), F.max(score).alias(score))


def ocr_lines(words: DataFrame, least: float = 60.0) -> DataFrame:
    """Words of enough confidence joined to lines: text, mean confidence, box."""
    good = words.where((F.col("conf") >= least) & (F.trim("text") != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    return good.groupBy("page", "block_num", "par_num", "line_num").agg(
        joined.alias("line"), F.avg("conf").alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
    )
