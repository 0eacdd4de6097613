"""State machines over ordered lines, as windows: what a line means by those before it.

Each keeps a state that some lines reset; so lines fall into segments, and within a
segment the state is a count, a parity or a distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _count(where: Column, w: Window) -> Column:
    return F.coalesce(F.sum(where.cast("int")).over(w), F.lit(0))


def pairs_in_runs(lines: DataFrame, by: list[str], order: list, col: str, number: Column, amount: Column, stop: Column | None = None) -> DataFrame:
    """A number line and the amount line after it, both consumed: rows of the amounts with
    ``label``.  A line that is both (``number``) is a label where none is open, else an
    amount; any other line closes an open label.  From the first ``stop`` line on nothing
    counts.

    Lines that are no number end a segment, and within one the numbers take turns: gaps
    and islands with parity.
    """
    n, a = F.coalesce(number, F.lit(False)), F.coalesce(amount, F.lit(False))
    rows = lines if stop is None else lines.withColumn("stop__", _count(F.coalesce(stop, F.lit(False)), _upto(by, order))).where("stop__ = 0").drop("stop__")
    rows = rows.withColumns({"seg__": _count(~n, _before(by, order)), "label": F.lag(col).over(Window.partitionBy(*by).orderBy(*order))})
    turn = _count(n, _before([*by, "seg__"], order)) % 2
    return rows.withColumn("turn__", turn).where((n | a) & (F.col("turn__") == 1)).drop("seg__", "turn__")


def without_next(lines: DataFrame, by: list[str], order: list, kind: str, mark: str, item: str) -> DataFrame:
    """The ``item`` lines but those that follow a ``mark`` line with no other item
    between: a mark is consumed by the next item.  Lines of other kinds do not count."""
    w = Window.partitionBy(*by).orderBy(*order)
    marks = lines.where(F.col(kind).isin(mark, item)).withColumn("last__", F.lag(kind).over(w))
    return marks.where((F.col(kind) == item) & (F.col("last__").isNull() | (F.col("last__") == item))).drop("last__")


def nth_with_nth(a: DataFrame, b: DataFrame, by: list[str], order: list) -> DataFrame:
    """Two ordered lists of each group side by side, as far as the shorter goes: the rows
    of ``a`` with the columns of ``b`` that it lacks.

    Both are merged: behind texts that are taken apart the planner thinks ``b`` small, and
    a broadcast of it goes whole through the driver."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = lambda df: df.withColumn("n__", F.row_number().over(w))
    more = [c for c in b.columns if c not in a.columns]
    return n(a).join(n(b).select(*by, "n__", *more).hint("merge"), [*by, "n__"]).drop("n__")


def within_keyword(lines: DataFrame, by: list[str], order: list, keyword: Column, hit: Column, size: int = 3) -> DataFrame:
    """The ``hit`` lines that a keyword announces: one that stands on a ``keyword`` line or
    less than ``size`` lines below it.  A hit consumes its keyword, and a new keyword line
    starts anew."""
    k, h = F.coalesce(keyword, F.lit(False)), F.coalesce(hit, F.lit(False))
    rows = lines.withColumn("seg__", _count(k, _upto(by, order)))
    own = [*by, "seg__"]
    rows = rows.withColumns({"far__": F.row_number().over(Window.partitionBy(*own).orderBy(*order)), "used__": _count(h, _before(own, order))})
    return rows.where(h & (F.col("seg__") > 0) & (F.col("far__") <= size) & (F.col("used__") == 0)).drop("seg__", "far__", "used__")


def carried_headers(rows: DataFrame, by: list[str], table: list[str], row: str, cells: str, is_header: Column, day: str | None = None) -> DataFrame:
    """Rows of cells with the ``headers`` that hold for them, without the header rows.

    A table's first row is its header if it looks like one (``is_header``), if it is the
    group's first or if it is not as wide as the table before; otherwise the table goes on
    with the header before.  ``day``, where given, is the first one found up to a row's
    table.  Tables are few, so only their first rows are windowed over a group.
    """
    head = Window.partitionBy(*by, *table).orderBy(row)
    placed = rows.withColumn("n__", F.row_number().over(head))
    firsts = placed.where("n__ = 1").select(*by, *table, F.size(cells).alias("wide__"), F.col(cells).alias("head__"), is_header.alias("is__"), *([F.col(day).alias("day__")] if day else []))
    w = Window.partitionBy(*by).orderBy(*table)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = F.lag("wide__").over(w)
    firsts = firsts.withColumn("own__", F.coalesce(F.col("is__"), F.lit(False)) | wide.isNull() | (wide != F.col("wide__")))
    firsts = firsts.withColumn("headers", F.last(F.when(F.col("own__"), F.col("head__")), ignorenulls=True).over(upto))
    if day:
        firsts = firsts.withColumn("first__", F.first("day__", ignorenulls=True).over(upto))
    found = placed.join(firsts.select(*by, *table, "headers", "own__", *(["first__"] if day else [])), [*by, *table]).where("not own__ or n__ > 1")
    out = found.drop("n__", "own__")
    return out.withColumn(day, F.col("first__")).drop("first__") if day else out
