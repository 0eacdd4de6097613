"""From fetched pages to clean rows and a status for each source, in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import parse_date
from disclosa.functions.status import fetch_status
from disclosa.operators.filters import raw_total
from disclosa.operators.mutations import placeholder
from disclosa.operators.normalise import cleaned, statuses, typed
from disclosa.shared import stored
from disclosa.sources import ocr
from disclosa.sources.fetch import looks_like_pdf, strategy
from disclosa.sources.html import html_table_rows, page_text
from disclosa.sources.lines import text_rows
from disclosa.sources.report import grand_totals, numbered_rows, report_text_rows
from disclosa.sources.rules import interpreted, row_stays, with_specs

#: What the branches have in common.
ROW = ("source_id", "row_pos", "lsp_name", "lender", "portfolio", "amount", "as_on", "scrape_ts", "force_include", "error", "fill")


def dispatched(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources (source_id, lsp_name, dlg_url, parse_hint, rules_json) with the record of
    their rules, their pages (source_id, content_type, body, scrape_ts, error) and the
    strategy they go to."""
    page = pages.withColumnRenamed("error", "fetch_error").select("source_id", "content_type", "body", "scrape_ts", "fetch_error")
    return with_specs(sources).join(page, "source_id", "left").withColumn("strategy", strategy(F.col("parse_hint"), looks_like_pdf(F.col("content_type"), F.col("dlg_url"))))


def _rows(found: DataFrame) -> DataFrame:
    """Columns ROW; what a branch lacks is null."""
    kinds = dict(source_id="long", row_pos="long", amount="double", as_on="date", scrape_ts="timestamp_ntz", force_include="boolean", fill="array<string>")
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ROW])


def _cells() -> Column:
    return F.map_from_entries(F.transform(F.array_distinct("headers"), lambda h: F.struct(h, F.get("vals", (F.array_position("headers", h) - 1).cast("int")))))


def _tables(ready: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Rows of HTML tables and of reports, by each source's rules: which table, which
    captions, which rows, which columns."""
    asked = F.coalesce("spec.page_lender.regex", "spec.page_as_on.regex").isNotNull()  # no other text is read
    pages = ready.where("strategy in ('html_table', 'auto') and spec.error is null").withColumn("page_text", page_text(F.when(asked, F.col("body"))))
    pages = pages.select("source_id", "lsp_name", "scrape_ts", "spec", "body", "page_text")
    tables = html_table_rows(pages, "body", "spec.table_index", "spec.skip_captions")
    tables = tables.withColumn("row_pos", F.col("table_no").cast("long") * 1_000_000 + F.col("row_no"))
    if reports is not None:
        of = ready.where("strategy = 'pdf_table'").join(reports.withColumnRenamed("as_on", "report_day"), "source_id").withColumn("page_text", F.lit(None).cast("string"))
        tables = tables.unionByName(of.withColumn("cells", _cells()), allowMissingColumns=True)
    tables = tables.where(row_stays(F.col("spec"), F.col("cells")) & ~F.coalesce(raw_total(F.col("cells"), F.lit(False)), F.lit(False)))
    found = typed(interpreted(tables)).withColumn("fill", F.col("spec.fill"))
    return found if reports is None else found.withColumn("as_on", F.coalesce("as_on", "report_day"))


def _texts(ready: DataFrame) -> list[DataFrame]:
    """Rows of the text layouts; a page without any is read for its grand total."""
    texts = ready.where("strategy = 'plain_text'").withColumn("text", page_text("body"))
    more = texts.select("source_id", "scrape_ts", F.col("spec.fill").alias("fill"))
    parsed = text_rows(texts).join(more, "source_id")
    totals = grand_totals(texts.join(parsed.where("error is null").select("source_id").distinct(), "source_id", "left_anti"))
    return [parsed, totals.join(more, "source_id").withColumn("row_pos", F.lit(0))]


def _recognised(ready: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of recognised lines (source_id, page, lines), of sources that are PDFs and
    say how to read them; units, days and lenders are those of the rules."""
    own = ready.where("strategy = 'ocr_simple'").withColumn("error", _ocr_error())
    good = own.where("error is null").select("source_id", "lsp_name", "scrape_ts", "spec", "rules_json")
    found = ocr.line_amounts(lines.join(good.select("source_id"), "source_id", "left_semi")).join(good, "source_id")
    spec, day = F.col("spec"), F.coalesce(F.get_json_object("rules_json", "$.field_map.as_on.constant"), F.get_json_object("rules_json", "$.field_map.as_on"))
    fallback = F.get_json_object("rules_json", "$.field_map.as_on.fallback")
    monthly, quarterly = (ocr.fallback_day(F.col("scrape_ts"), q) for q in (False, True))
    ended = F.when(fallback == "previous_month_end", monthly).when(fallback == "previous_quarter_end", quarterly)
    lender = F.get_json_object("rules_json", "$.field_map.lender.constant")
    rows = ocr.in_crores(found, spec["ocr"]["unit"], F.coalesce(parse_date(day), ended), lender)
    failed = own.where("error is not null").select("source_id", "lsp_name", "error")
    return rows.withColumn("row_pos", F.col("page").cast("long") * 1_000_000 + F.col("line_no")).unionByName(failed, allowMissingColumns=True)


def _ocr_error() -> Column:
    pdf = looks_like_pdf(F.col("content_type"), F.col("dlg_url"))
    return F.when(~F.coalesce(pdf, F.lit(False)), "parse_hint=ocr_simple requires a PDF disclosure").otherwise(F.col("spec.ocr.error"))


def scraped(sources: DataFrame, pages: DataFrame, fill: list[str] = (), reports: DataFrame | None = None, lines: DataFrame | None = None, numbered: DataFrame | None = None, report_texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, statuses) of all sources: dispatcher, parser, field rules, types,
    clean-up, status.

    HTML pages go through their tables and each source's rules, text ones through the
    layouts, reports (source_id, row_pos, headers, vals, as_on: ``report_table_rows``)
    through the rules again, recognised ``lines`` (source_id, page, lines) through the
    amounts, numbered tables and texts of reports (``numbered_rows``,
    ``report_text_rows``) through theirs; a page of the text branch without rows is read
    for its grand total.  Columns that a source's rules fill, and those of ``fill`` for
    all, are filled from above.  A source without a URL is Missing, one whose page or
    rules failed is Error.
    """
    all_pages = stored(dispatched(sources, pages).withColumn("missing", fetch_status(F.col("dlg_url"), F.col("fetch_error").isNotNull())), "pages")
    ready = all_pages.where("missing is null")
    there = {r["strategy"] for r in ready.select("strategy").distinct().collect()}  # of five; only these are planned
    broken = ready.where("strategy in ('html_table', 'auto', 'pdf_table') and spec.error is not null")
    parts = [broken.select("source_id", "lsp_name", F.col("spec.error").alias("error"))]
    if there & {"html_table", "auto"} or reports is not None:
        parts.append(_tables(ready, reports).withColumn("force_include", F.lit(False)))
    if "plain_text" in there:
        parts += _texts(ready)
    if "ocr_simple" in there:
        none = ready.sparkSession.createDataFrame([], "source_id long, page int, lines array<string>")
        parts.append(_recognised(ready, none if lines is None else lines))
    of = ready.where("strategy = 'pdf_table'").select("source_id", "lsp_name", "scrape_ts", F.col("spec.fill").alias("fill"))
    if numbered is not None:
        parts.append(numbered_rows(numbered).withColumn("row_pos", F.col("row_no")).join(of, "source_id"))
    if report_texts is not None:
        parts.append(report_text_rows(report_texts).withColumn("row_pos", F.col("pos")).join(of, "source_id"))
    rows = stored(reduce(DataFrame.unionByName, map(_rows, parts)), "scraped")  # read three times below; pages are parsed once
    failed = rows.where("error is not null").groupBy("source_id").agg(F.min("error").alias("error"))
    clean = cleaned(rows.where("error is null"), list(fill))
    found = statuses(sources.select("source_id").join(failed, "source_id", "left"), clean)
    known = all_pages.select("source_id", "missing").join(found, "source_id").select("source_id", F.coalesce("missing", "status").alias("status"))
    return clean.drop("error"), known


def raw_rows(sources: DataFrame, rows: DataFrame, known: DataFrame, scraped_at: Column) -> DataFrame:
    """What a crawl leaves in the raw table: rows with their source's status, and for a
    source without rows one placeholder."""
    of = sources.select(F.col("source_id"), "lsp_name", "dlg_url").join(known, "source_id")
    names = ["lsp_id", "lsp_name", "lender", "portfolio", "amount", "as_on_timestamp", "scrape_timestamp", "complete", "dlg_url"]
    found = rows.drop("lsp_name").join(of, "source_id").select(F.col("source_id").alias("lsp_id"), "lsp_name", "lender", "portfolio", "amount", F.col("as_on").cast("timestamp_ntz").alias("as_on_timestamp"), F.col("scrape_ts").alias("scrape_timestamp"), F.col("status").alias("complete"), F.coalesce("dlg_url", F.lit("NA")).alias("dlg_url"))
    none = of.join(rows.select("source_id").distinct(), "source_id", "left_anti")
    empty = none.select(F.col("source_id").alias("id"), F.col("lsp_name").alias("name"), "dlg_url", "status")
    return found.select(*names).unionByName(placeholder(empty, F.col("status"), scraped_at).select(*names))
