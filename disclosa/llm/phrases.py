"""Mining of collocations: phrases whose words stand together more often than their parts
would suggest.

Texts are cut into pieces and equal pieces become one with a multiplicity.  Tasks count
the weighted n-grams of what they read in duckdb and deal the counts to hash buckets;
each bucket is summed in duckdb, which spills what does not fit its memory.  Phrases that
are frequent enough then send requests to where their parts were counted.
"""

from __future__ import annotations

import os
import tempfile
from itertools import pairwise
from urllib.parse import urlparse

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disclosa.shared import shared_dir

from .common import answered, blocks, stored, utf8

#: Bytes of pieces that a task counts at once (and words, where a piece has more), of text
#: to a bucket, and of duckdb's memory.
CHUNK, WORDS, BUCKET, MEMORY = 3 << 20, 1 << 19, 8 << 20, "160MB"

#: Bytes as they count: A-Z lower-cased, what ends a piece as line end, tab as blank.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_BYTES[9] = 32


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of a language, words joined by one blank, and
    how often each occurs.  Null text is empty, null lang ``und``."""

    def cut(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off, CHUNK):
                text = _BYTES[raw[off[i] : off[j]]]
                texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(off[i : j + 1] - off[i]), pa.py_buffer(text))
                parts = pc.split_pattern(texts, "\n")
                lang = b.column(0).slice(i, j - i).take(pc.list_parent_indices(parts))
                part = pc.utf8_trim(pc.list_flatten(parts), " ")
                while pc.any(twice := pc.match_substring(part, "  ")).as_py():
                    part = pc.if_else(twice, pc.replace_substring(part, "  ", " "), part)
                found = pa.table({"lang": lang, "piece": part}).filter(pc.not_equal(part, ""))
                found = found.group_by(["lang", "piece"]).aggregate([([], "count_all")])
                yield from found.select(["lang", "piece", "count_all"]).rename_columns(["lang", "piece", "m"]).cast(pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])).to_batches(max_chunksize=50_000)

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(cut, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


class Scratch:
    """A duckdb with bounded memory.  What does not fit is spilled to a folder of its own
    under ``folder``, which is gone with it, as Spark's spilled files are with their task."""

    def __init__(self, folder: str | None):
        self.dir = tempfile.TemporaryDirectory(prefix="spill-", dir=folder, ignore_cleanup_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.dir.name, "preserve_insertion_order": False})

    def __enter__(self):
        return self.db

    def __exit__(self, *_):
        self.db.close()
        self.dir.cleanup()


def _folder(docs: DataFrame) -> str | None:
    """The shared folder where it is mounted; else each worker's own."""
    at = urlparse(shared_dir(docs.sparkSession))
    return at.path if at.scheme in ("", "file") else None


def _made(folder: str | None) -> str | None:
    if folder:
        os.makedirs(folder, exist_ok=True)
    return folder


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n_words, f) of all phrases of up to ``longest`` words that occur
    ``least`` times within pieces of a language, overlaps included; and a row a language
    and bucket without phrase, whose f is of all words, so that they add up to n.

    A task sends each bucket one row a chunk and language, its phrases compressed.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets, folder = 1 + size // BUCKET, _folder(docs)

    def count(batches):
        zstd = zstandard.ZstdCompressor(3)
        with Scratch(_made(folder)) as db:
            held, held_bytes = [], 0

            def flush():
                chunk = pa.Table.from_batches(held).combine_chunks()
                parts = pc.split_pattern(chunk.column("piece").chunk(0), " ")
                words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
                for at in range(0, len(words), WORDS):
                    found = pa.concat_tables([grams(chunk, words, owner, at, n) for n in range(1, longest + 1)])  # noqa: F841 (read by duckdb)
                    counted = db.sql(f"SELECT (hash(lang, phrase) % {n_buckets})::INT AS bucket, lang, phrase || chr(10) AS phrase, sum(m)::BIGINT AS f FROM found GROUP BY lang, phrase").to_arrow_table().combine_chunks()
                    del found
                    if counted.num_rows:
                        yield dealt(counted)
                    del counted
                    pa.default_memory_pool().release_unused()

            def dealt(counted):
                """A row for each bucket and language: its phrases, a line each, and counts."""
                lang = counted.column("lang").chunk(0).dictionary_encode()
                names = lang.dictionary.to_pylist()
                key = counted.column("bucket").to_numpy().astype(np.int64) * len(names) + lang.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                ids, first = np.unique(key[order], return_index=True)
                raw, off = utf8(counted.column("phrase").chunk(0).take(pa.array(order)))
                f, cut = counted.column("f").to_numpy()[order].astype("<i8"), [*first.tolist(), len(order)]
                cols = [pa.array(ids // len(names), pa.int32()), pa.array([names[i] for i in (ids % len(names)).tolist()], pa.string())]
                cols.append(pa.array([zstd.compress(raw[off[i] : off[j]].tobytes()) for i, j in pairwise(cut)], pa.binary()))
                cols.append(pa.array([zstd.compress(f[i:j].tobytes()) for i, j in pairwise(cut)], pa.binary()))
                return pa.RecordBatch.from_arrays(cols, ["bucket", "lang", "phrases", "f"])

            def grams(chunk, words, owner, at, n):
                """The phrases of n words that begin at one of WORDS words from ``at`` on."""
                size = max(0, min(WORDS, len(words) - at - n + 1))
                whole = owner[at : at + size] == owner[at + n - 1 : at + n - 1 + size]
                phrase = pc.binary_join_element_wise(*(words.slice(at + k, size) for k in range(n)), " ")
                of = pa.array(owner[at : at + size][whole])
                return pa.table({"lang": chunk.column("lang").take(of), "phrase": phrase.filter(pa.array(whole)), "m": chunk.column("m").take(of)})

            for b in batches:
                held.append(b)
                held_bytes += b.nbytes
                if held_bytes >= CHUNK:
                    yield from flush()
                    held, held_bytes = [], 0
            if held:
                yield from flush()

    def total(batches):
        zstd = zstandard.ZstdDecompressor()

        def added(db, held):
            if held:
                rows = pa.concat_tables(held)  # noqa: F841 (read by duckdb)
                db.execute("INSERT INTO own SELECT * FROM rows")
                held.clear()

        def shut(db, held):
            added(db, held)
            found = db.sql(f"""
                WITH s AS (SELECT lang, phrase, sum(f)::BIGINT AS f FROM own GROUP BY lang, phrase), n AS (SELECT *, (len(phrase) - len(replace(phrase, ' ', '')) + 1)::INT AS n_words FROM s)
                SELECT lang, phrase, n_words, f FROM n WHERE f >= {least}
                UNION ALL SELECT lang, NULL, 0, sum(f)::BIGINT FROM n WHERE n_words = 1 GROUP BY lang
            """).to_arrow_table()
            db.execute("TRUNCATE own")
            return found.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])).to_batches(max_chunksize=50_000)

        with Scratch(_made(folder)) as db:
            db.execute("CREATE TEMP TABLE own (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            last, held, held_rows = None, [], 0
            for b in batches:
                for bucket, lang, phrases, f in zip(*(c.to_pylist() for c in b.columns)):
                    if bucket != last and last is not None:
                        yield from shut(db, held)
                        held_rows = 0
                    last = bucket
                    values = np.frombuffer(zstd.decompress(f), "<i8")
                    lines = pc.list_flatten(pc.split_pattern(pa.array([zstd.decompress(phrases)[:-1].decode()]), "\n"))
                    held.append(pa.table({"lang": pa.repeat(lang, len(values)), "phrase": lines, "f": values}))
                    held_rows += len(values)
                    if held_rows >= WORDS:
                        added(db, held)
                        held_rows = 0
            if last is not None:
                yield from shut(db, held)

    counts = pieces(docs, text_col, lang_col).mapInArrow(count, "bucket int, lang string, phrases binary, f binary")
    return counts.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(total, "lang string, phrase string, n_words int, f long")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``longest`` words and occurs a times, ``least`` at least.  Cut in
    two, its parts occur l and r times, and its score is floor(1000000 a a / (l r)) at the
    cut where that is lowest (of equal ones the first).  Candidates that lie in a longer
    one with 100 f >= ``percent`` a go.  Order: score, then a, both descending, then
    phrase.  Exact: decimals of 38 digits.

    Null text is empty, null lang ``und``; repeated rows count each; other columns are not
    read; an empty table gives no rows.
    """
    counted = stored(phrase_counts(docs, longest, least, text_col, lang_col), "counts")
    n = counted.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    found = counted.where("n_words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "n_words")
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = found.select("lang", "phrase", "a", "w", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("part")))
    asks = stored(cuts.select("lang", "phrase", "a", "k", F.inline(sides)), "asks")
    parts = answered(asks, counted.where("phrase is not null").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"], asks.count())
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    pairs = parts.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    exact = "cast({} as decimal(18,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {exact.format('a')} * {exact.format('a')}) div ({exact.format('l')} * {exact.format('r')})")
    scored = pairs.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    inside = found.where("n_words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < percent * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
