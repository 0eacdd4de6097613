"""Which labelled documents a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, id_text, stored


def remainder(folds: int, id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` documents of each class, and how
    many labelled documents each class has.

    ``learn`` is a condition on doc_id.  Only ids with both a row in ``docs`` and a
    label are drawn from; rows without a label or id are left out; of contradicting
    labels of an id the mean counts (1 from 0.5 on), of several texts the least.
    The sample takes the lowest hashes of the ids, so it is the same in every run
    and texts of any length are in it.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null").where(learn)
    own = own.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    there = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    own = stored(own.join(there.hint("merge"), "doc_id"), "labels")
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [tuple(r) for y in (0, 1) for r in own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    dropped(own)
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")  # at most 2 * per_class
    rows = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), counts


def collected(features: DataFrame, class_bytes: int) -> pa.Table:
    """The rows (doc_id, y, n_bytes, ...) of a sample by hash, of each class until
    those before have ``class_bytes`` together: what the driver holds for a fit.  A
    text of any length counts whole, and the first one always."""
    by_hash = F.xxhash64("doc_id")
    w = Window.partitionBy("y").orderBy(by_hash, "doc_id")  # over the bounded sample
    before = F.coalesce(F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = features.withColumn("hash", by_hash).withColumn("before", before).where(F.col("before") < class_bytes).drop("before", "n_bytes")
    return rows.toArrow().sort_by([("hash", "ascending"), ("doc_id", "ascending")]).combine_chunks()


def released() -> None:
    """Give memory that a fit no longer needs back, for the driver goes on to other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)
