"""Corpus pipeline: quality, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame that is written and reread as the next one's ``docs``;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosa.llm import nearcopies, packing, quality, substrings, toxicity
from disclosa.llm.common import dropped, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Every row is judged by its
    text: repeated rows each, null and empty texts as ones without words; an empty
    table stays empty."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.  Every row is judged by its text:
    repeated rows each, null and empty texts are not toxic; an empty table stays empty."""
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the least doc_id; of rows of one id
    and text the one least in its other columns.  Rows of one id with different
    texts are documents of their own; null and empty texts are copies of each
    other; rows without an id stay; an empty table stays empty."""
    return nearcopies.keep_first(docs)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document of a smaller id
    has; a text that loses nothing stays as it is (null and empty ones too), one
    that loses all goes.  Rows without an id neither lose nor remove anything;
    n_chars follows the text; an empty table stays empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # by place, so that no name can clash
    held = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    cut = substrings.drop_repeats(docs.select("doc_id", "text", held.alias("row")), carry=["row"], as_is=True)
    kept = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    column = {c: F.col(f"carried.row.c{i}").alias(c) for i, c in enumerate(others)}
    column |= {"doc_id": F.col("doc_id"), "text": F.when(~F.col("carried.row.no_text"), F.col("kept")).alias("text")}
    if "n_chars" in others:
        changed = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long"))
        column["n_chars"] = F.coalesce(changed, F.col(f"carried.row.c{others.index('n_chars')}")).alias("n_chars")
    return kept.select(*(column[c] for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece.  Every row is packed:
    repeated ones each, null and empty texts as just their end; an empty table
    gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("substrings", substrings_stage),
    ("packing", packing_stage),
]

#: Fitted models, sketches and token ids are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  The table of a stage goes when the next one's is
    written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
