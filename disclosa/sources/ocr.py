"""Recognised words and lines: portfolio amounts, units, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclosa.functions.amounts import from_unit, ocr_digits
from disclosa.functions.dates import previous_month_end, previous_quarter_end
from disclosa.functions.text import portfolio_hint
from disclosa.operators.sequences import within_keyword
from disclosa.operators.windows import context_before

#: Words that announce amounts, and the patterns of amounts and portfolios.
KEYWORDS = ("dlg", "default loss guarantee")
AMOUNT = r"(?i)(?:₹|INR|Rs\.?)?\s*([0-9OolI|S,/\.\-]{1}[0-9OolI|S,/\.\- ,]{2,})\s*(?:Cr|Crores?)?"
TOKEN, PORTFOLIO = r"([0-9OolI|S,/\.\-]+)", r"(?i)^\s*portfolio\s+\d+"


def line_amounts(pages: DataFrame) -> DataFrame:
    """Amounts of pages (source_id, page, lines array<string>): source_id, page, line_no,
    amount, amount_text, portfolio_hint, context_before.

    A line counts within three lines from a keyword or portfolio; a found amount ends
    that; at most one amount a line, and only with a portfolio.  The context is the two
    lines before.
    """
    by, order = ["source_id", "page"], ["line_no"]
    rows = context_before(pages.select("source_id", "page", F.posexplode("lines").alias("line_no", "line")), by, order)
    line = F.col("line")
    own = line.rlike(PORTFOLIO)
    tokens = F.filter(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1)), lambda x: x.rlike(r"\d"))
    found = F.when(own & (F.size(tokens) > 0), F.slice(tokens, -1, 1)).otherwise(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(1)))
    keyword = own
    for k in KEYWORDS:
        keyword = keyword | F.lower(line).contains(k)
    hits = within_keyword(rows.withColumn("found", found), by, order, keyword, F.size("found") > 0)
    read = F.transform("found", lambda x: F.struct(ocr_digits(x).alias("text"), F.replace(ocr_digits(x), F.lit(","), F.lit("")).try_cast("double").alias("value")))
    first = F.get(F.filter(read, lambda x: x["value"].isNotNull()), 0)
    hits = hits.withColumns({"first": first, "portfolio_hint": portfolio_hint(line)}).where("first is not null and portfolio_hint is not null")
    return hits.select("source_id", "page", "line_no", F.col("first.value").alias("amount"), F.col("first.text").alias("amount_text"), "portfolio_hint", "context_before")


def words_in_band(words: DataFrame, by: list[str], min_conf: float = 60, top_pct: float | None = None, bottom_pct: float | None = None, slices: int | None = None) -> DataFrame:
    """Words (by..., text, conf, top, height, page_height) of at least ``min_conf`` in
    the band of a page that holds its table, with the ``slice`` of the band they start in.

    The band goes from top_pct to bottom_pct of the page; where one is not given, from
    the first to the last word that says portfolio, five hundredths of the page around,
    or over all of it.  A band has a slice for each 150 pixels, 12 at most.
    """
    high = F.max("page_height")
    sure = F.lower("text").contains("portfolio") & (F.col("conf") >= max(10, min_conf // 2))
    pad = F.floor(high * F.lit(0.05))
    low, top = F.min(F.when(sure, F.col("top"))), F.max(F.when(sure, F.col("top") + F.col("height")))
    at = lambda pct, own: own if pct is None else F.floor(F.lit(max(0.0, min(100.0, pct)) / 100) * high)
    y0 = at(top_pct, F.coalesce(F.greatest(F.lit(0), low - pad), F.lit(0)))
    y1 = at(bottom_pct, F.coalesce(F.least(high, top + pad), high))
    band = words.groupBy(*by).agg(y0.alias("y0"), F.greatest(y0 + 10, F.least(high, y1)).alias("y1"))
    n = F.lit(slices) if slices else F.greatest(F.lit(1), F.least(F.lit(12), F.ceil((F.col("y1") - F.col("y0")) / 150)))
    inside = (F.col("conf") >= min_conf) & (F.col("top") >= F.col("y0")) & (F.col("top") + F.col("height") <= F.col("y1"))
    place = F.least(n - 1, F.floor((F.col("top") - F.col("y0")) / ((F.col("y1") - F.col("y0")) / n))).cast("int")
    return words.join(band, by).where(inside).withColumn("slice", place).drop("y0", "y1")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Lines that slices of a page repeat, the first of each."""
    w = Window.partitionBy("source_id", "page", "line").orderBy("slice", "line_no")
    return lines.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def fallback_day(scraped: Column, quarterly: bool = False) -> Column:
    return previous_quarter_end(scraped) if quarterly else previous_month_end(scraped)


def in_crores(found: DataFrame, unit: Column, as_on: Column, lender: Column) -> DataFrame:
    """Recognised amounts with a portfolio, in crores by their unit (rupees if it names
    neither crores nor lakhs)."""
    rows = found.where(F.col("portfolio_hint").isNotNull())
    return rows.withColumns({"lender": lender, "portfolio": F.col("portfolio_hint"), "amount": F.round(from_unit(F.col("amount"), unit), 4), "as_on": as_on})


def normalised(found: DataFrame, unit: Column, as_on: Column, scraped: Column, lender: Column, quarterly: bool = False) -> DataFrame:
    """Recognised amounts in crores; without a date the end of the month or quarter before."""
    rows = in_crores(found, unit, F.coalesce(as_on, fallback_day(scraped, quarterly)), lender)
    return rows.select("source_id", "lender", "portfolio", "amount", "as_on", scraped.alias("scrape_ts"))
