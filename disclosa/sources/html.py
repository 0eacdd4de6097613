"""HTML pages as text and as table rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = {"script", "style", "noscript"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_text(html: str | bytes | None) -> str:
    """Text of a page, a line for each piece; no scripts, styles or blank lines."""
    parser = _Text()
    parser.feed(html.decode("utf-8", "replace") if isinstance(html, bytes) else html or "")
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for x in "\n".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


class _Tables(HTMLParser):
    """Grids of the tables of a page: rows of (text, is_head, columns, rows, in_thead)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.stack, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"rows": [], "head": False})
            self.tables.append(self.stack[-1]["rows"])
            self.cell = None
        elif not self.stack:
            return
        elif tag == "thead":
            self.stack[-1]["head"] = True
        elif tag == "tr":
            self.stack[-1]["rows"].append([])
            self.cell = None
        elif tag in ("td", "th"):
            span = lambda k: max(1, int(m[0])) if (m := re.match(r"\d+", a.get(k) or "")) else 1
            self.cell = [[], tag == "th", span("colspan"), span("rowspan"), self.stack[-1]["head"]]
            if not self.stack[-1]["rows"]:
                self.stack[-1]["rows"].append([])
            self.stack[-1]["rows"][-1].append(self.cell)

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag == "table":
            self.stack.pop()
            self.cell = None
        elif tag == "thead":
            self.stack[-1]["head"] = False
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0].append(data)


def _text(cell) -> str:
    return re.sub(r"\s+", " ", " ".join(cell[0])).strip()


def _spread(rows: list, widest: int) -> list[list[str]]:
    """Cells put in every column and row that they span."""
    down: dict[int, tuple[str, int]] = {}
    out = []
    for row in rows:
        line, cells = [], iter(row)
        pending = next(cells, None)
        while pending is not None or len(line) in down:
            at = len(line)
            if at in down:
                text, left = down.pop(at)
                line.append(text)
                if left > 1:
                    down[at] = text, left - 1
                continue
            text = _text(pending)
            for k in range(min(pending[2], widest)):
                line.append(text)
                if pending[3] > 1:
                    down[at + k] = text, pending[3] - 1
            pending = next(cells, None)
        out.append(line)
    return out


def table_rows(html: str | None, table_index: int | None = None, skip_captions: bool = False) -> list[tuple[int, int, list[str], list[str]]]:
    """(table, row, headers, values) of the data rows of a page's tables.

    Headers are the head's last row, else the first row if it has a header cell
    or is not all numbers, else col_0, col_1, ...; a row that is one spanning
    header cell is a caption (left out before the header), one spanning cell
    later on a note; blank rows drop out.
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for t, rows in enumerate(parser.tables):
        if table_index is not None and t != table_index:
            continue
        rows = [r for r in rows if r]
        if skip_captions:
            while rows and len(rows[0]) == 1 and rows[0][0][2] > 1:
                rows = rows[1:]
        if not rows:
            continue
        wide = max(sum(c[2] for c in r) for r in rows)
        notes = [len(r) == 1 and (r[0][2] > 1 and r[0][2] >= wide) for r in rows]
        grid = _spread(rows, wide)
        head = [i for i, r in enumerate(rows) if all(c[4] for c in r)]
        numeric = all(re.fullmatch(r"[\d.,%\s-]+", x or "-") for x in grid[0])
        if head:
            headers, first = grid[head[-1]], head[-1] + 1
        elif any(c[1] for c in rows[0]) or not numeric:
            headers, first = grid[0], 1
        else:
            headers, first = [f"col_{i}" for i in range(wide)], 0
        headers = [h or f"col_{i}" for i, h in enumerate(headers)]
        n = 0
        for i in range(first, len(rows)):
            values = grid[i][: len(headers)] + [""] * (len(headers) - len(grid[i]))
            if notes[i] or not any(values):
                continue
            out.append((t, n, headers, values))
            n += 1
    return out


_ROW = T.StructType().add("table_no", "integer").add("row_no", "integer").add("headers", T.ArrayType(T.StringType())).add("vals", T.ArrayType(T.StringType()))
#: Pages parsed before their rows leave a Python worker, so that its memory is theirs.
PAGES = 128


def html_table_rows(pages: DataFrame, html: str = "html", table_index: int | str | None = None, skip_captions: bool | str = False) -> DataFrame:
    """Each page's columns with the rows of its tables; cells are also a map, in
    which the last of equal headers wins.  ``table_index`` and ``skip_captions`` are
    values, or the names of columns that hold a page's own."""
    keep = [c for c in pages.columns if c != html]
    index = F.col(table_index) if isinstance(table_index, str) else F.lit(table_index)
    skip = F.col(skip_captions) if isinstance(skip_captions, str) else F.lit(skip_captions)
    given = pages.select(F.col(html).cast("string").alias("html__"), index.cast("int").alias("index__"), skip.cast("boolean").alias("skip__"), *(F.col(f"`{c}`") for c in keep))
    kinds = T.StructType([pages.schema[c] for c in keep] + _ROW.fields)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                part = b.slice(i, PAGES)
                found = [table_rows(h, x, bool(s)) for h, x, s in zip(*(part.column(k).to_pylist() for k in range(3)))]
                own = [part.column(k).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))) for k in range(3, part.num_columns)]
                of = [[r[k] for x in found for r in x] for k in range(4)]
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, kind) for x, kind in zip(of, (pa.int32(), pa.int32(), texts, texts)))], [*keep, *_ROW.names])

    rows = given.mapInArrow(run, kinds)
    last = F.filter(F.transform("headers", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.size(F.filter(F.slice("headers", x["i"] + 2, F.size("headers")), lambda y: y == x["h"])) == 0)
    cells = F.map_from_entries(F.transform(last, lambda x: F.struct(x["h"], F.get("vals", x["i"]))))
    return rows.withColumn("cells", cells)
