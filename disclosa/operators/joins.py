"""Joins between disclosure tables.

Which side is broadcast is left to the planner, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosa.shared import stored


def with_master(summary: DataFrame, master: DataFrame) -> DataFrame:
    """Summaries with their source; sources without one and the reverse drop out."""
    m = master.select(F.col("id").alias("lsp_id"), F.col("name").alias("master_name"), "brand_name", "lsp_type", "home_url", "active")
    return summary.join(m, "lsp_id")


def with_minute_audit(summary: DataFrame, audit: DataFrame) -> DataFrame:
    """Left join with audit rows of the source in the minute of its last crawl;
    several in the minute give several rows."""
    a = audit.select("lsp_id", F.date_trunc("minute", "log_timestamp").alias("minute"), F.col("id").alias("audit_id"), "user_id", "action_taken")
    return summary.withColumn("minute", F.date_trunc("minute", "last_crawl_date")).join(a, ["lsp_id", "minute"], "left").drop("minute")


def audit_with_source(audit: DataFrame, master: DataFrame) -> DataFrame:
    m = master.select(F.col("id").alias("lsp_id"), F.col("name").alias("lsp_name"))
    return audit.join(m, "lsp_id", "left")


def _null_safe(rows: DataFrame, target: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) an equal in the target, nulls being
    equal: in structs nulls are, and as one key the target is dealt by it once, for its
    distinct keys and for the join.  Floating-point keys go as their texts, which differ as
    they do (0.0 and -0.0 do not); as numbers a join would deal them again."""
    floats = {k for df in (rows, target) for k, kind in df.dtypes if kind in ("double", "float")}
    key = F.struct(*((F.col(k).cast("double") + 0.0).cast("string").alias(k) if k in floats else F.col(k) for k in keys))
    return rows.join(target.select(key.alias("__keys")).distinct(), key == F.col("__keys"), how)


def null_safe_anti(changes: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Changes without an equal in the target, nulls being equal."""
    return _null_safe(changes, target, keys, "left_anti")


def null_safe_semi(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return _null_safe(rows, target, keys, "left_semi")


def lookup(users: DataFrame, username: str, roles: DataFrame) -> DataFrame:
    """The user of that name in one of the roles."""
    return users.where(F.col("username") == username).join(roles.select("role"), "role", "left_semi")


def scraped_sources(master: DataFrame, raw: DataFrame) -> DataFrame:
    return master.join(raw.select(F.col("lsp_id").alias("id")), "id", "left_semi")


def duplicate_sources(new: DataFrame, master: DataFrame) -> DataFrame:
    """New sources that exist: any of name, brand (crosswise too) or home page of
    one of the same kind.  An OR of equalities is a union of equi-joins here, so
    it hashes instead of looping over all pairs."""
    pairs = [("name", "name"), ("name", "brand_name"), ("brand_name", "name"), ("brand_name", "brand_name"), ("home_url", "home_url")]
    hits = [new.join(master.select(F.col(b).alias(a), "lsp_type").distinct(), [a, "lsp_type"], "left_semi").select(*new.columns) for a, b in pairs]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def zip_lists(df: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """Lists side by side, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    zipped = F.arrays_zip(F.slice(a, 1, n).alias(names[0]), F.slice(b, 1, n).alias(names[1]))
    return df.withColumn("pair", F.explode(zipped)).select(*[c for c in df.columns if c not in (a, b)], f"pair.{names[0]}", f"pair.{names[1]}")


#: Pages that end within so many rows are a top-k of one task.
SHALLOW = 10_000


def page(df: DataFrame, order: list, number: int | None, size: int | None) -> DataFrame:
    """A page of the ordered rows; without number or size all of them.

    A deep page does not pass all rows before it through one task: rows are dealt by
    ranges of the order, the ranges are counted, and only those of the page are sorted.
    """
    if not number or not size:
        return df.orderBy(*order)
    start = (number - 1) * size
    if start + size <= SHALLOW:
        return df.orderBy(*order).offset(start).limit(size)
    ranged = stored(df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range__"], r["count"]) for r in ranged.groupBy("range__").count().collect())  # a row a partition
    at, wanted, skipped = 0, [], 0
    for k, n in sizes:
        if at + n > start and at < start + size:
            skipped = start - at if not wanted else skipped
            wanted.append(k)
        at += n
    return ranged.where(F.col("range__").isin(wanted)).drop("range__").orderBy(*order).offset(skipped).limit(size)
