"""Removal of passages that repeat across documents, by level-wise doubling.

Windows of half the length are looked up first: of each window, the half-length
run of least hash.  Only windows whose run occurs in more than one document are
extended to the full length and looked up again, now for the smallest document
that holds them.  Documents are dealt into chunks; a chunk sends each distinct
hash once, to the range of hashes that it falls into, and gets back one bit for
it, so copies are pre-aggregated and no hash gathers more than one entry a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U64, Words, mix, stored, utf8

#: Text bytes of a chunk: the unit that a task holds in memory; chunks whose texts have
#: as many hashes as a part, the unit of the other side; and chunks of a task.  A chunk
#: sends a row to each part, so rows grow as bytes / CHUNK * bytes / (CHUNK * PART) until
#: a row holds one hash; larger executors take a larger chunk (``chunk_bytes``).
CHUNK, PART, TASK = 4 << 20, 4, 8
_HASHES = "part long, chunk long, hashes binary, docs binary, bits binary"
_BITS = "chunk long, part long, bits binary"


class Level:
    """Distinct hashes of a chunk's windows at one length, ordered by part, first
    document and hash, so that bits can be sent back in the same order."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, parts: int):
        """``docs`` ascend."""
        order = np.argsort(hashes, kind="stable")
        h, d = hashes[order], docs[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.hash, self.low = h[first], d[first]
        self.high = d[np.append(first[1:], len(h)) - 1] if len(first) else d[first]
        self.part = ((self.hash >> U64(17)) % U64(parts)).astype(np.int64)
        rank = np.lexsort((self.hash, self.low, self.part))
        self.hash, self.low, self.high, self.part = (x[rank] for x in (self.hash, self.low, self.high, self.part))
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = back[np.cumsum(new) - 1]
        self.parts, at = np.unique(self.part, return_index=True)
        self.cut = np.append(at, len(self.part))

    def bits(self, rows: dict[int, bytes]) -> np.ndarray:
        """The bit of each entry, from those of each part."""
        out = np.zeros(len(self.hash), bool)
        for p, a, b in zip(self.parts.tolist(), self.cut[:-1], self.cut[1:]):
            out[a:b] = np.unpackbits(np.frombuffer(rows[p], np.uint8), count=b - a)
        return out


class Chunk:
    """The documents of a chunk in the order of their ids, and their windows."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.table, self.ids = table, table["doc_id"].to_pylist()
        self.raw, self.offsets = utf8(table["text"])
        self.window, self.words = window, Words(self.raw, self.offsets, SPACE)
        known = np.array([x is not None for x in self.ids], bool)
        self.value = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        n = np.maximum(np.diff(self.words.ptr) - window + 1, 0) * known
        self.ptr = np.concatenate([[0], np.cumsum(n)])
        self.owner = np.repeat(np.arange(len(n)), n)
        self.start = np.repeat(self.words.ptr[:-1] - self.ptr[:-1], n) + np.arange(self.ptr[-1])

    def least_halves(self) -> np.ndarray:
        """For each window the least hash of its half-length runs."""
        half = (self.window + 1) // 2
        grams, ptr = self.words.grams(half)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        low, n = grams.copy(), self.window - half
        for k in range(1, n + 1):
            np.minimum(low[: len(low) - k], grams[k:], out=low[: len(low) - k])
        return low[ptr[self.owner] + self.start - self.words.ptr[self.owner]]

    def whole(self, windows: np.ndarray) -> np.ndarray:
        grams, ptr = self.words.grams(self.window)
        return grams[ptr[self.owner[windows]] + self.start[windows] - self.words.ptr[self.owner[windows]]]


def _rows(level: Level, chunk: int, more: bool):
    """Rows for the parts: hashes with their first document, or with a bit for
    those in more than one document."""
    rows = []
    for p, a, b in zip(level.parts.tolist(), level.cut[:-1], level.cut[1:]):
        docs = np.diff(level.low[a:b], prepend=0).tobytes() if more else None
        bits = None if more else np.packbits(level.low[a:b] != level.high[a:b]).tobytes()
        rows.append((p, chunk, level.hash[a:b].tobytes(), docs, bits))
    return rows


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(fields, cols)})


def _entries(table: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Chunks and sizes of the rows, all hashes, and each one's place among the distinct."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    flat = np.concatenate(hashes)
    return table["chunk"].to_pylist(), [len(x) for x in hashes], flat, np.unique(flat, return_inverse=True)[1]


def _by_chunk(df: DataFrame):
    return df.groupBy("chunk")


def _dealt(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, carry: list[str]) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text[, carried]), TASK chunks to a task, and the number of parts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.struct(*(f"`{c}`" for c in carry)).alias("carried")] * bool(carry))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    tasks = max(-(-chunks // TASK), min(chunks, docs.sparkSession.sparkContext.defaultParallelism))
    # a row's place in the scan spreads repeated rows; results do not depend on the chunk
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(chunks))).repartition(tasks, "chunk"), -(-chunks // PART)


def _repeated(table: pa.Table) -> pa.Table:
    """Of a part's hashes, a bit for those in more than one document."""
    chunks, sizes, _, place = _entries(table)
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["bits"].to_pylist(), sizes)])
    bits = ((np.bincount(place) > 1) | (np.bincount(place, flags) > 0))[place]
    part, at = table["part"][0].as_py(), np.cumsum([0, *sizes])
    return _table([(c, part, np.packbits(bits[a:b]).tobytes()) for c, a, b in zip(chunks, at[:-1], at[1:])], _BITS)


def _half_level(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """The bits of each chunk's half-length runs."""

    def halves(table: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        return _table(_rows(Level(c.least_halves(), c.value[c.owner], parts), table["chunk"][0].as_py(), False), _HASHES)

    return _by_chunk(texts).applyInArrow(halves, _HASHES).groupBy("part").applyInArrow(_repeated, _BITS)


def _survivors(c: Chunk, bits: dict[int, bytes], parts: int) -> tuple[np.ndarray, Level]:
    """Windows whose half repeats, and their hashes at full length."""
    level = Level(c.least_halves(), c.value[c.owner], parts)
    alive = np.flatnonzero(level.bits(bits)[level.entry])
    return alive, Level(c.whole(alive), c.value[c.owner[alive]], parts)


def drop_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, keep_text: bool = True, carry: list[str] = (), as_is: bool = False) -> DataFrame:
    """Remove every word of a window of ``window`` words that also starts in a
    document with a smaller id.

    Words are runs of characters other than space and 0x09-0x0D, unchanged;
    windows are judged on the input.  Returns doc_id, n_words, n_removed,
    kept_sha256 and, with ``keep_text``, kept (the words left, joined by one
    space).  The document with the smallest id keeps a passage.  Rows of one id
    are one document to each other and are judged each; rows without an id
    neither remove nor lose words; null and empty texts have no words; of other
    columns those in ``carry`` come along as the struct ``carried``, the rest is
    left out; with ``as_is`` kept is the unchanged text where nothing goes; an
    empty table gives no rows.

    Texts are shuffled once (the same exchange serves all three readings).
    Hashes have 64 bits; a word goes wrongly only where those of a half-length
    run and of the whole window, which are independent, both collide.
    """
    texts, parts = _dealt(docs, id_col, text_col, chunk_bytes, carry)

    def doubled(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _HASHES)
        chunk, bits = table["chunk"][0].as_py(), dict(zip(answers["part"].to_pylist(), answers["bits"].to_pylist()))
        _, level = _survivors(Chunk(table, window), bits, parts)
        # the answers so far go along, for the last reading needs them too
        return _table(_rows(level, chunk, True) + [(p, chunk, None, None, x) for p, x in bits.items()], _HASHES)

    def smallest(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        along = table.filter(pa.compute.is_null(table["hashes"]))
        out = [(c, -1 - part, x) for c, x in zip(along["chunk"].to_pylist(), along["bits"].to_pylist())]
        table = table.filter(pa.compute.is_valid(table["hashes"]))
        if len(table):
            chunks, sizes, _, place = _entries(table)
            docs = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table["docs"].to_pylist()])
            low = np.full(place.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, place, docs)
            bits, at = low[place] < docs, np.cumsum([0, *sizes])
            out += [(c, part, np.packbits(bits[a:b]).tobytes()) for c, a, b in zip(chunks, at[:-1], at[1:])]
        return _table(out, _BITS)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    fields = T._parse_datatype_string(schema).fields + [f for f in texts.schema if f.name == "carried"]

    def whole_table(out: list[tuple], table: pa.Table) -> pa.Table:
        found = _table(out, schema)
        return found.append_column("carried", table["carried"]) if "carried" in table.column_names else found

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return whole_table([], table)
        c, both = Chunk(table, window), list(zip(answers["part"].to_pylist(), answers["bits"].to_pylist()))
        alive, level = _survivors(c, {-1 - p: x for p, x in both if p < 0}, parts)
        smaller = level.bits({p: x for p, x in both if p >= 0})[level.entry] | (c.value[c.owner[alive]] > level.low[level.entry])
        w, out = c.words, []
        edge = np.zeros(len(w.starts) + 1, np.int64)
        hit = c.start[alive[smaller]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        keep = np.flatnonzero(~gone)
        size = np.diff(w.ptr)
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[w.ptr[1:]] - lost[w.ptr[:-1]]
        # bytes of kept words, and one byte before each that follows another
        of = np.repeat(np.arange(len(size)), size)[keep]
        later = np.zeros(len(keep), bool)
        later[1:] = of[1:] == of[:-1]
        inside = np.zeros(len(c.raw) + 1, np.int8)
        inside[w.starts[keep]] += 1
        inside[w.ends[keep]] -= 1
        mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
        raw = c.raw.copy()
        gap = w.starts[keep[later]] - 1
        mask[gap], raw[gap] = True, 0x20
        whole, at = raw[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[c.offsets]
        for d in range(len(size)):
            text = whole[at[d] : at[d + 1]]
            row = c.ids[d], int(size[d]), int(lost[d]), hashlib.sha256(text).hexdigest()
            if as_is and not lost[d]:
                text = c.raw[c.offsets[d] : c.offsets[d + 1]].tobytes()
            out.append((*row, text.decode("utf-8", "replace")) if keep_text else row)
        return whole_table(out, c.table)

    first = _half_level(texts, window, parts)
    second = _by_chunk(texts).cogroup(_by_chunk(first)).applyInArrow(doubled, _HASHES).groupBy("part").applyInArrow(smallest, _BITS)
    return _by_chunk(texts).cogroup(_by_chunk(second)).applyInArrow(removed, T.StructType(fields))


_STATE = "chunk long, docs binary, starts binary, hashes binary"
_SPANS = "doc_id long, n_words long, `start` long, `end` long"


def repeated_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """Where documents share passages: for each length ``window``, twice that, and
    so on, until no candidates survive, the runs of words [start, end) covered by
    windows of n_words words that occur in more than one document.

    Only windows that repeat at one length are extended: the next hash is made
    of those of a window and of the one that follows it, so texts are read for
    the first length alone.  Rows without an id, and null and empty texts, have
    no spans; rows of one id are one document.
    """
    spark = docs.sparkSession
    texts, parts = _dealt(docs, id_col, text_col, chunk_bytes, [])
    blob = lambda *xs: [np.ascontiguousarray(x).tobytes() for x in xs]

    def begin(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _STATE)
        c = Chunk(table, window)
        alive, _ = _survivors(c, dict(zip(answers["part"].to_pylist(), answers["bits"].to_pylist())), parts)
        own = c.owner[alive]
        # a row's place tells rows of one id apart
        place = c.start[alive] - c.words.ptr[own] + (own.astype(np.int64) << 32)
        return _table([(table["chunk"][0].as_py(), *blob(c.value[own], place, c.whole(alive)))], _STATE)

    def parsed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(table[k][0].as_py(), t) for k, t in (("docs", np.int64), ("starts", np.int64), ("hashes", np.uint64)))

    def hashed(table: pa.Table) -> pa.Table:
        d, _, h = parsed(table)
        order = np.argsort(d, kind="stable")
        return _table(_rows(Level(h[order], d[order], parts), table["chunk"][0].as_py(), False), _HASHES)

    def kept(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _STATE)
        d, s, h = parsed(table)
        order = np.argsort(d, kind="stable")
        level = Level(h[order], d[order], parts)
        ok = np.sort(order[level.bits(dict(zip(answers["part"].to_pylist(), answers["bits"].to_pylist())))[level.entry]])
        return _table([(table["chunk"][0].as_py(), *blob(d[ok], s[ok], h[ok]))] if len(ok) else [], _STATE)

    def spans(n: int):
        def run(table: pa.Table) -> pa.Table:
            d, s, _ = parsed(table)
            new = np.ones(len(s), bool)
            new[1:] = s[1:] - s[:-1] > n  # another row's places are farther off
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            word = s & 0xFFFFFFFF
            return _table([(int(d[a]), n, int(word[a]), int(word[b]) + n) for a, b in zip(first, last)], _SPANS.replace("`", ""))

        return run

    def extended(n: int):
        def run(table: pa.Table) -> pa.Table:
            d, s, h = parsed(table)
            at = np.minimum(np.searchsorted(s, s + n), len(s) - 1)
            ok = s[at] == s + n
            return _table([(table["chunk"][0].as_py(), *blob(d[ok], s[ok], mix(h[ok] * U64(0xD6E8FEB86659FD93) + h[at[ok]])))] if ok.any() else [], _STATE)

        return run

    state, n, found = stored(_by_chunk(texts).cogroup(_by_chunk(_half_level(texts, window, parts))).applyInArrow(begin, _STATE), "windows"), window, None
    while True:
        bits = _by_chunk(state).applyInArrow(hashed, _HASHES).groupBy("part").applyInArrow(_repeated, _BITS)
        alive = stored(_by_chunk(state).cogroup(_by_chunk(bits)).applyInArrow(kept, _STATE), "windows")
        own = _by_chunk(alive).applyInArrow(spans(n), _SPANS)
        found = own if found is None else found.unionByName(own)
        if alive.isEmpty():
            return found
        state, n = stored(_by_chunk(alive).applyInArrow(extended(n), _STATE), "windows"), 2 * n
