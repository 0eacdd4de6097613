"""Ordered operators: fills, carries, first and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclosa.functions.text import filled


def _upto(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward_fill(df: DataFrame, cols: list[str], by: list[str], order: list, suffix: str = "") -> DataFrame:
    """The last value that is not blank, itself included; a leading gap stays."""
    w = _upto(by, order)
    return df.withColumns({c + suffix: F.last(F.when(filled(F.col(c)).isNotNull(), F.col(c)), ignorenulls=True).over(w) for c in cols})


def forward_fill_parts(df: DataFrame, cols: list[str], by: list[str], part: Column, order: list, part_order: Column, suffix: str = "") -> DataFrame:
    """``forward_fill`` of long histories: rows are ordered in parts (``part`` ascends
    or descends with ``order``, as ``part_order`` says; null is a part too), so a task
    holds one part of a group, and only the last values of parts go over them."""
    rows = df.withColumn("part__", part)
    filled_in = [f"{c}__in" for c in cols]
    w = Window.partitionBy(*by, "part__").orderBy(*order)
    last = {n: F.last(F.when(filled(F.col(c)).isNotNull(), F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c, n in zip(cols, filled_in)}
    rows = rows.withColumns(last).withColumn("end__", F.lead(F.lit(1)).over(w).isNull())
    ends = rows.where("end__").select(*(F.col(c).alias(f"{c}__of") for c in by), F.col("part__").alias("part__of"), *filled_in)
    of = Window.partitionBy(*(f"{c}__of" for c in by)).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("part__", F.col("part__of")).select(*(f"{c}__of" for c in by), "part__of", *(F.last(n, ignorenulls=True).over(of).alias(f"{n}_before") for n in filled_in))
    same = F.col("part__").eqNullSafe(F.col("part__of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__of"))
    met = rows.join(carried, same, "left").withColumns({c + suffix: F.coalesce(n, f"{n}_before") for c, n in zip(cols, filled_in)})
    return met.drop("part__", "part__of", "end__", *filled_in, *(f"{n}_before" for n in filled_in), *(f"{c}__of" for c in by))


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def first_of_all(df: DataFrame, order: list) -> DataFrame:
    """The first row: a top-k, so no task sorts all rows."""
    return df.orderBy(*order).limit(1)


def latest(df: DataFrame, by: list[str], order: list[str], ties: list[str] = ()) -> DataFrame:
    """The first row of each group in descending order, nulls first."""
    w = Window.partitionBy(*by).orderBy(*(F.desc_nulls_first(c) for c in order), *ties)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def latest_filled(x: Column, ts: Column, tie: Column) -> Column:
    """Aggregate: the value of the latest row in which it is not blank."""
    return F.max_by(x, F.when(filled(x).isNotNull(), F.struct(F.coalesce(ts, F.lit("0001-01-01").cast("timestamp_ntz")), tie)))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of equal keys, nulls being equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def sum_rows(df: DataFrame, by: list[str], amount: str = "amount", within: float = 0.05) -> DataFrame:
    """Adds is_sum: of a group of over two amounts, the row equals the sum of the others."""
    w = Window.partitionBy(*by)
    a = F.col(amount)
    near = F.abs(2 * a - F.sum(a).over(w)) <= within
    return df.withColumn("is_sum", F.coalesce(near & (F.count(a).over(w) > 2), F.lit(False)))


def segment_carry(df: DataFrame, by: list[str], order: list, heading: Column, cols: list[str]) -> DataFrame:
    """Values carried down from where they stand to the next heading."""
    seg = df.withColumn("segment", F.sum(F.when(heading, 1).otherwise(0)).over(_upto(by, order)))
    w = _upto([*by, "segment"], order)
    return seg.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})


def context_before(df: DataFrame, by: list[str], order: list, col: str = "line") -> DataFrame:
    """The two lines before, joined by ' | '."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("context_before", F.nullif(F.concat_ws(" | ", F.lag(col, 2).over(w), F.lag(col, 1).over(w)), F.lit("")))
