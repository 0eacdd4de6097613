"""Fetching pages: requests, dispatch, content kinds."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import promoted_url

SCHEMA = "source_id long, url string, status_code int, content_type string, body binary, fetch_mode_used string, error string"


def fetch(url: str, timeout: float = 40, attempts: int = 3) -> tuple[int, str, bytes]:
    """GET with waits of 1 to 12 seconds that double between attempts."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.status, r.headers.get("Content-Type", ""), r.read()
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(min(12, 2**k))
    raise AssertionError


def fetched(sources: DataFrame, get=fetch) -> DataFrame:
    """Sources (source_id, url) with their pages; a failure is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b.itertuples():
                try:
                    code, kind, body = get(s.url)
                    out.append((s.source_id, s.url, code, kind, body, "requests", None))
                except Exception as why:  # noqa: BLE001
                    out.append((s.source_id, s.url, None, None, None, "requests", str(why)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"status_code": "Int32"})

    return sources.select("source_id", "url").mapInPandas(run, SCHEMA)


def fetch_mode(hint: Column) -> Column:
    return F.when(F.lower(F.coalesce(hint, F.lit("auto"))) == "playwright", "playwright").otherwise("requests")


def looks_like_pdf(content_type: Column, url: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("application/pdf") | F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))


def starts_as_pdf(body: Column) -> Column:
    return F.substring(body.cast("string"), 1, 5) == "%PDF-"


def remote_pdf(status_code: Column, content_type: Column, body: Column) -> Column:
    """Whether an address leads to a PDF: it answers, and says so or begins like one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce((status_code < 400) & (kind.contains("application/pdf") | F.coalesce(starts_as_pdf(body), F.lit(False))), F.lit(False))


def promoted(master: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Sources (id, dlg_url, ...) whose URL names the month before last, moved to last
    month's where ``pages`` (url, status_code, content_type, body) has a PDF there;
    adds ``promoted``.  The changed rows are the update of the stored sources."""
    there = pages.where(remote_pdf(F.col("status_code"), F.col("content_type"), F.col("body"))).select(F.col("url").alias("found_url")).distinct()
    rows = master.withColumn("candidate", promoted_url(F.col("dlg_url"), now))
    met = rows.join(there, rows["candidate"] == there["found_url"], "left")
    url = F.coalesce("found_url", "dlg_url")
    return met.withColumns({"dlg_url": url, "promoted": F.col("found_url").isNotNull()}).drop("candidate", "found_url")


def strategy(parse_hint: Column, is_pdf: Column) -> Column:
    """Which parser a page goes to; unknown hints are auto."""
    h = F.lower(F.coalesce(parse_hint, F.lit("auto")))
    return F.when(h == "plain_text", "plain_text").when(h == "ocr_simple", "ocr_simple").when((h == "pdf_table") | is_pdf, "pdf_table").when(h == "html_table", "html_table").otherwise("auto")
