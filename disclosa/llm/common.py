"""What the operators share: shared folders, Arrow text access, hashing of words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosa.shared import dropped, fresh_dir, stored  # noqa: F401 (for the operators)

U64 = np.uint64


def released(run):
    """``run`` for mapInArrow, after which a worker gives back what it has freed: workers
    stay for later tasks, and what they keep adds to their executor's memory."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return out


def rows_where(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of ``docs`` for which ``judge`` (from bytes and offsets of texts, null
    as empty, to booleans) is true, judged in place; any column names."""
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(at).fill_null("") if b.column(at).null_count else b.column(at))
            good = [judge(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return placed.mapInArrow(released(run), placed.schema).toDF(*docs.columns)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), null text as empty; other columns never travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about ``most`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, in place where it can be."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE, _GRAM = 0x9E3779B97F4A7C15 | 1, U64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, U64(base), np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits, underscore and bytes of other characters.
PUNCT = np.array([not (chr(b).isalnum() or b == 95) if b < 128 else False for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def fold(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals (in UTF-8) made small."""
    out = _LOWER[raw]
    if len(raw) > 1:
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        hit = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
        out[hit] += 0x20
    return out


class Words:
    """Words of consecutive documents: byte spans, 64-bit hashes, and ``ptr``
    so that document d owns words ptr[d]:ptr[d+1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, hashed: bool = True):
        self.raw = raw
        n = len(raw)
        inside = ~separators[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        if hashed:
            self.prefix = self._prefix()
            self.hashes = self.span_hash(self.starts, self.ends)

    def _prefix(self) -> np.ndarray:
        power, self._inverse = _powers(max(1, len(self.raw) + 1))
        out = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * power[: len(self.raw)], out=out[1:])
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of k consecutive words, ptr): those of document d are ptr[d]:ptr[d+1]."""
        h = self.hashes if hashes is None else hashes
        n = len(h) - k + 1
        counts = np.maximum(np.diff(self.ptr) - k + 1, 0)
        ptr = np.concatenate([[0], np.cumsum(counts)])
        if n <= 0 or not ptr[-1]:
            return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
        at = np.repeat(self.ptr[:-1] - ptr[:-1], counts) + np.arange(ptr[-1])
        out = h[:n].copy()
        for j in range(1, k):
            out *= _GRAM
            out += h[j : n + j]
        return mix(out[at]), ptr


def owners(ptr: np.ndarray) -> np.ndarray:
    """The document of each word or gram."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def answered(asks: DataFrame, answers: DataFrame, on: list[str], total: int) -> DataFrame:
    """``asks`` (a stored table of about ``total`` rows) left joined with ``answers``
    (unique by ``on``): requests travel to their answers.

    A key that more than one in 1024 requests name (and more than 256) is answered by
    broadcast instead, so no task gets more of a hot key; of such keys there are fewer
    than 1024 at any size.
    """
    often = asks.groupBy(*on).count().where(F.col("count") > max(256, total // 1024)).drop("count").collect()
    if not often:
        return asks.join(answers, on, "left")
    keys = F.broadcast(asks.sparkSession.createDataFrame(often, asks.select(*on).schema))
    hot = F.broadcast(answers.join(keys, on, "left_semi"))
    return asks.join(keys, on, "left_anti").join(answers, on, "left").unionByName(asks.join(keys, on, "left_semi").join(hot, on, "left"))
