"""Tables of reports whose cells were already taken out of the file."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import any_date

#: Wordings of a page's date, the first that fits counts.
DATED = (
    r"date of data as on\s+([0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s*[0-9]{4})",
    r"as\s+on\s+([0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s*[0-9]{4})",
    r"as\s+on\s+([A-Za-z]+\s+[0-9]{1,2}(?:st|nd|rd|th)?,?\s*[0-9]{4})",
    r"as\s+on\s+([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})",
    r"as\s+on\s+([A-Za-z]{3,9}['‘’-]\s*[0-9]{2,4})",
    r"as\s+of\s+([0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s*[0-9]{4})",
    r"as\s+of\s+([A-Za-z]+\s+[0-9]{1,2}?,?\s*[0-9]{4})",
)


def number(text: str) -> float | None:
    try:
        return float(re.sub(r"[,\s]", "", text))
    except ValueError:
        return None


def page_date(text: str | None) -> dt.date | None:
    for pattern in DATED:
        if (m := re.search(pattern, text or "", re.I)) and (found := any_date(m[1])):
            return found
    return None


def header_of(row: list[str | None]) -> list[str]:
    """Blank and repeated headers become col_i."""
    out: list[str] = []
    for i, x in enumerate(row):
        name = re.sub(r"\s+", " ", x or "").strip()
        out.append(name if name and name not in out else f"col_{i}")
    return out


def split_row(row: list[str | None]) -> list[list[str]]:
    """Cells that hold a line for each of several rows, taken apart.

    A line that names a kind of loan belongs to the line after it; Total lines go.
    """
    cells = [[x.strip() for x in (c or "").split("\n") if x.strip()] for c in row]
    cells = [[x for x in c if not re.match("total", x, re.I)] if len(c) > 1 else c for c in cells]
    joined = []
    for c in cells:
        out: list[str] = []
        for x in c:
            if out and re.search(r"\bloans?$", out[-1], re.I) and not re.search(r"\d", out[-1]):
                out[-1] = f"{out[-1]} {x}"
            else:
                out.append(x)
        joined.append(out)
    n = max((len(c) for c in joined), default=0)
    if n <= 1 or sum(len(c) == n for c in joined) < 2:
        return [[" ".join(c) for c in joined]]
    return [[c[k] if len(c) == n else (c[0] if len(c) == 1 else "") for c in joined] for k in range(n)]


def report_rows(pages: list[tuple[str, list[list[list[str | None]]]]]) -> list[tuple[list[str], list[str], dt.date | None]]:
    """(headers, values, date) of a report's pages, each (text, tables).

    A table as wide as the one before and without a header of its own goes on
    with that header; the first date found holds for later pages.
    """
    headers, as_on, out = None, None, []
    for text, tables in pages:
        as_on = as_on or page_date(text)
        for table in tables:
            rows = [r for r in table if any((x or "").strip() for x in r)]
            if not rows:
                continue
            words = [x for x in rows[0] if (x or "").strip()]
            is_head = all(number(x) is None for x in words) and any(re.search(r"lender|portfolio|amount|name|outstanding|dlg", x, re.I) for x in words)
            if is_head or headers is None or len(headers) != len(rows[0]):
                headers, rows = header_of(rows[0]), rows[1:]
            for row in rows:
                out += [(headers, v, as_on) for v in split_row(row) if any(v)]
    return out


SCHEMA = "source_id long, row_pos int, headers array<string>, vals array<string>, as_on date"
#: Reports parsed before their rows leave a Python worker, so that its memory is theirs.
REPORTS = 128


def report_table_rows(reports: DataFrame) -> DataFrame:
    """Rows of reports (source_id, pages array<struct<text, tables array<array<array<string>>>>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        kinds = (pa.int64(), pa.int32(), texts, texts, pa.date32())
        for b in batches:
            for k in range(0, b.num_rows, REPORTS):
                part = b.slice(k, REPORTS)
                found = []
                for source, pages in zip(part.column(0).to_pylist(), part.column(1)):
                    rows = report_rows([(p["text"], p["tables"]) for p in pages.as_py()])
                    found += [(source, i, *row) for i, row in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate(kinds)], ["source_id", "row_pos", "headers", "vals", "as_on"])

    return reports.select(F.col("source_id").cast("long"), "pages").mapInArrow(run, SCHEMA)
