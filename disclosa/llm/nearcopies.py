"""Near copies by order min-hash, verified by banded alignment.

A document is the sequence of its five-word shingles.  Each of TABLES sketches
takes the LEAST occurrence-labelled shingles that hash lowest, in the order of
the text, so documents collide when they share them in the same order.  The
similarity of two documents is L / (n + m - L), L being the longest common
subsequence of their shingles: the Jaccard measure where order counts.

Documents of a bucket are aligned with one of them, its pivot, so a group of
copies of any size takes as many alignments as it has members.  What this does
not settle goes through an exact prefix filter, and families of what passes it are
compared in blocks, by the shingles that they share.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, Words, blocks, dropped, fold, id_text, mix, released, stored, utf8

SHINGLE, SIMILARITY = 5, 0.8
#: With similarity 0.8 a sketch of 5 agrees in about a third of cases, and one of 28 in 99.999 %.
TABLES, LEAST = 28, 5
#: Documents aligned with one text in one go; documents and shingles of a family's block.
UNIT, BLOCK, BLOCK_SHINGLES = 64, 256, 500_000
#: Parts over which the members of a hot bucket and the edges of a hot node are dealt.
SALTS = 8
#: Counters of shingles that order them from rare to frequent (a fixed size; any order is right).
COUNTERS = 1 << 20
#: Documents of so many shingles have keys besides that miss no pair (see ``few``); shorter
#: ones are near no other, and no sketch of longer pairs misses more than 1 in 10,000.
FEW = range(4, 20)
_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RNG.integers(1, 2**63, 2 * TABLES, dtype=np.uint64) | U64(1)
_TOP = U64(2**64 - 1)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ptr; a text of fewer words than a shingle is one shingle."""
    grams, ptr = w.grams(SHINGLE)
    n = np.diff(w.ptr)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        one = np.array([int.from_bytes(hashlib.blake2b(w.hashes[w.ptr[d] : w.ptr[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in short], np.uint64)
        grams = np.insert(grams, ptr[short], one)
        count = np.diff(ptr)
        count[short] = 1
        ptr = np.concatenate([[0], np.cumsum(count)])
    return grams, ptr


def labelled(grams: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often they occurred before in the document."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((grams, doc))
    h, d = grams[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty(len(grams), np.uint64)
    out[order] = mix(h + nth.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return out


def sketch(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Keys (documents with shingles, TABLES) from labelled shingles."""
    n = np.diff(ptr)
    begin, count = ptr[:-1][n > 0], n[n > 0]
    owner = np.repeat(np.arange(len(begin)), count)
    keys = np.zeros((len(begin), TABLES), np.uint64)
    for t in range(TABLES if len(begin) else 0):
        v = h * _MULTIPLY[t]
        v ^= v >> U64(29)
        v *= _MULTIPLY[t + TABLES]
        v[v == _TOP] = U64(0)
        at = np.full((LEAST, len(begin)), len(h), np.int64)
        for k in range(LEAST):
            low = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero(v == low[owner])
            hit = hit[v[hit] != _TOP]
            at[k, owner[hit]] = hit  # of equal ones (a collision) the last
            v[hit] = _TOP
        at.sort(axis=0)
        values = np.append(h, U64(0))[at]
        key = np.full(len(begin), U64(t + 1), np.uint64)
        for k in range(LEAST):
            key = mix(key * U64(0xD6E8FEB86659FD93) + values[k])
        keys[:, t] = key
    return keys


def few(h: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """Keys of the documents with shingles from labelled ones; none if not of FEW.

    Of n labelled shingles a document shares ``need`` or more with any of SIMILARITY,
    so the k least shared ones are among the n - need + k least of either, and all
    choices of k of those are keys: every pair meets.
    """
    n = np.diff(ptr)
    begin, count = ptr[:-1][n > 0], n[n > 0]
    keys = [np.zeros(0, np.uint64)] * len(begin)
    for size in FEW:
        own = np.flatnonzero(count == size)
        if not len(own):
            continue
        least = np.sort(h[begin[own][:, None] + np.arange(size)], axis=1)
        found = []
        # near pairs share LEAST or more, but for 4 shingles with 5
        for k in [LEAST - 1] * (size <= LEAST) + [LEAST] * (size >= LEAST):
            need = max(k, int(np.ceil(SIMILARITY * size - 1e-9)))
            chosen = least[:, list(combinations(range(size - need + k), k))]
            key = np.full(chosen.shape[:2], U64(TABLES + k), np.uint64)
            for c in range(k):
                key = mix(key * U64(0xD6E8FEB86659FD93) + chosen[:, :, c])
            found.append(key)
        found = np.concatenate(found, axis=1)
        for r, d in enumerate(own):
            keys[d] = found[r]
    return keys


def sketches(rows: DataFrame) -> DataFrame:
    """From (doc_id, text): doc_id, mark (a hash of the text), digest (of the word
    sequence; of the text where it has no words), size (shingles), keys array<long>
    (null without words)."""

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(2))
            for i, j in blocks(off):
                own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                w = Words(fold(own), at, PUNCT)
                digest = [hashlib.blake2b(w.hashes[w.ptr[d] : w.ptr[d + 1]].tobytes() or b"text" + own[at[d] : at[d + 1]].tobytes(), digest_size=16).digest() for d in range(j - i)]
                grams, ptr = shingles(w)
                h = labelled(grams, ptr)
                none = np.diff(ptr) == 0
                keys = [np.concatenate(x).view(np.int64) for x in zip(sketch(h, ptr), few(h, ptr))]
                k = [None if e else keys[r] for e, r in zip(none, np.cumsum(~none) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(digest, pa.binary()), pa.array(np.diff(ptr), pa.int64()), pa.array(k, pa.list_(pa.int64()))], ["doc_id", "mark", "digest", "size", "keys"])

    return rows.select("doc_id", mark_of(), "text").mapInArrow(released(run), "doc_id long, mark long, digest binary, size long, keys array<long>")


def mark_of(text: str = "text"):
    """Column ``mark``: tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark")


def _salt(by: str):
    """One of SALTS parts, by a column."""
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int").alias("salt")


def _each_salt():
    """A row for each part, for the side of a join that has one row a key."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the ``root`` of their class so far, themselves if they have none."""
    met = members.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("known")), "rep", "left")
    return met.withColumn("root", F.coalesce("known", "rep")).drop("known")


def opened(members: DataFrame) -> DataFrame:
    """Members (key, rep, size, root) of the buckets whose members are not all of one
    class so far, with the bucket's pivot: key, rep, size, pivot, pivot_size.  A pivot
    is the least by hash, so it is the same in many buckets; the members of a large
    bucket are dealt over SALTS tasks."""
    own = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "size")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = own.where("lo <> hi").select("key", F.col("p.rep").alias("pivot"), F.col("p.size").alias("pivot_size"), _each_salt())
    return members.select("key", "rep", "size", _salt("rep")).join(own, ["key", "salt"]).drop("salt")


def unsettled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one class so far."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    met = pairs.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def pivot_pairs(held: DataFrame, least: float) -> DataFrame:
    """(a, b): a pivot and a member of lengths that may be similar."""
    fits = F.least("size", "pivot_size") >= F.lit(least) * F.greatest("size", "pivot_size") - 1e-9
    return held.where((F.col("rep") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))


def aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts (rep, text) have similarity ``least`` or
    more.  A text a goes once to every UNIT of its partners, a text b once to each
    of its pairs; a task holds one text and a batch."""
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(UNIT)).cast("int").alias("units"))
    firsts = n.join(texts, n["a"] == texts["rep"]).select("a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.lit(0).alias("kind"), "rep", "text")
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), "units").cast("int").alias("unit"))
    others = dealt.join(texts, dealt["b"] == texts["rep"]).select("a", "unit", F.lit(1).alias("kind"), "rep", "text")
    rows = firsts.unionByName(others).repartition("a", "unit").sortWithinPartitions("a", "unit", "kind")

    def run(batches):
        held = None  # the text a: its id, shingles and labelled shingles
        for b in batches:
            raw, off = utf8(b.column(3))
            first, kind, rep = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            out = []
            for i, j in blocks(off):
                grams, ptr = shingles(Words(fold(raw[off[i] : off[j]]), off[i : j + 1] - off[i], PUNCT))
                h = labelled(grams, ptr)
                for d in range(i, j):
                    own = grams[ptr[d - i] : ptr[d - i + 1]], h[ptr[d - i] : ptr[d - i + 1]]
                    if not kind[d]:
                        held = first[d], *(x.copy() for x in own)
                    elif held is None or held[0] != first[d]:
                        raise ValueError(f"the text of {first[d]} is missing")
                    elif similarity(held[1], own[0], least, (held[2], own[1])) >= least:
                        out.append((first[d], rep[d]))
            x = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return rows.select("a", "kind", "rep", "text").mapInArrow(released(run), "a long, b long")


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(key, rep, size): of the n labelled shingles of a text the rarest ones, one
    more than may be missing in a text of similarity ``least``, so of two such texts
    at least one is the same (a prefix filter: exact in any one order of shingles).
    """

    def labels(b):
        raw, off = utf8(b.column(1))
        for i, j in blocks(off):
            grams, ptr = shingles(Words(fold(raw[off[i] : off[j]]), off[i : j + 1] - off[i], PUNCT))
            yield i, labelled(grams, ptr), ptr

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, h, _ in labels(b):
                total += np.bincount((h & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["at", "n"])

    counted = texts.select("rep", "text").mapInArrow(released(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    total = np.zeros(COUNTERS, np.int64)
    total[np.asarray(counted["at"])] = np.asarray(counted["n"])
    sent = texts.sparkSession.sparkContext.broadcast(total)

    def run(batches):
        for b in batches:
            rep = np.asarray(b.column(0))
            for i, h, ptr in labels(b):
                n = np.diff(ptr)
                most = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, sent.value[(h & U64(COUNTERS - 1)).astype(np.int64)], doc))
                take = order[np.arange(len(h)) - np.repeat(ptr[:-1], n) < np.repeat(most, n)]
                for k in range(0, len(take), 1 << 16):
                    x = take[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64)), pa.array(rep[i + doc[x]]), pa.array(n[doc[x]])], ["key", "rep", "size"])

    return texts.select("rep", "text").mapInArrow(released(run), "key long, rep long, size long")


def groups(batches, keys: list[str]):
    """Tables of the runs of equal keys in a stream that is sorted by them."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not len(table):
            continue
        k = np.stack([np.asarray(table[c], np.int64) for c in keys])
        at = np.append(0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1)
        if len(at) > 1:
            table = table.combine_chunks()
        for x, y in zip(at[:-1], at[1:]):
            yield table.slice(x, y - x)
        held = table.slice(at[-1])
    if held is not None and len(held):
        yield held.combine_chunks()


def sharing(labels: np.ndarray, ptr: np.ndarray, root: np.ndarray, block: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of documents of different classes that share labelled shingles enough to
    have similarity ``least``; of two blocks those across them.

    Postings give the number that a document shares with all others at once.  A pair
    is left out if pairs before it connect its classes that surely are similar: what
    they share stands in the same order, and one shingle less would do.
    """
    n, size, out = len(root), np.diff(ptr), []
    root = np.unique(root, return_inverse=True)[1]
    two = block.any() and not block.all()
    at = np.unique(labels, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(at, kind="stable")
    if two:
        order = order[block[owner[order]]]
    posted, cut = owner[order], np.searchsorted(at[order], np.arange(at.max() + 2 if len(at) else 1))
    for i in np.flatnonzero(~block) if two else range(n):
        may = root != root[i]
        may &= block if two else np.arange(n) > i
        if not may.any():
            continue
        mine = at[ptr[i] : ptr[i + 1]]
        a, b = cut[mine], cut[mine + 1]
        where = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        share = np.bincount(posted[where], minlength=n)
        for j in np.flatnonzero(may & (share >= least * (size[i] + size - share) - 1e-9)):
            if root[i] != root[j]:
                out.append((i, j))
                both, x, y = np.intersect1d(labels[ptr[i] : ptr[i + 1]], labels[ptr[j] : ptr[j + 1]], return_indices=True)
                sure = len(both) - 1 >= least * (size[i] + size[j] - len(both) + 1)
                if sure and (np.diff(y[np.argsort(x)]) > 0).all():
                    root[root == root[j]] = root[i]
    return out


def family_pairs(families: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a family's documents (family, rep, root, size) of different
    classes that share enough labelled shingles.  Families are cut into blocks of about
    BLOCK documents or BLOCK_SHINGLES, and each pair of blocks meets, as shingles of 32
    bits: no pair is left out."""

    def label(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off):
                grams, ptr = shingles(Words(fold(raw[off[i] : off[j]]), off[i : j + 1] - off[i], PUNCT))
                h = (labelled(grams, ptr) >> U64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h[x:y].tobytes() for x, y in zip(ptr, ptr[1:])], pa.binary())], ["rep", "labels"])

    labels = texts.select("rep", "text").mapInArrow(released(label), "rep long, labels binary")
    n = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("g"))
    rows = families.join(n, "family").join(labels, "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def run(batches):
        for t in groups(batches, ["family", "lo", "hi"]):
            rep, root = (np.asarray(t[c], np.int64) for c in ("rep", "root"))
            raw, off = utf8(t["labels"])
            found = sharing(raw.view(np.uint32), off // 4, root, np.asarray(t["own"]) != np.asarray(t["lo"]), least)
            x = rep[np.array(found, np.int64).reshape(-1, 2)]
            for k in range(0, max(1, len(x)), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16), 0]), pa.array(x[k : k + (1 << 16), 1])], ["a", "b"])

    return rows.select("family", "lo", "hi", "own", "rep", "root", "labels").mapInArrow(released(run), "a long, b long")


def common_in_order(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence if it is ``least`` or more, else
    something smaller.

    Equal ends are cut off.  What is left goes through a bit-parallel alignment
    in a band: a subsequence of ``least`` elements leaves its diagonal by no more
    than the elements that may stay unmatched.
    """
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(np.argmin(same))
    x, y, n = x[head:], y[head:], n - head
    same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    least = max(0, least - head - tail)
    if not len(x) or not len(y) or least > min(len(x), len(y)):
        return head + tail
    return head + tail + _aligned(x, y, least)


def _aligned(x: np.ndarray, y: np.ndarray, least: int) -> int:
    band_up, band_down = len(y) - least, len(x) - least
    place: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        place[v] = place.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    state, rows, step = full, x.tolist(), 64
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        lo, hi = max(0, i - band_down), min(len(y), i + len(part) + band_up)
        if lo >= hi:
            continue
        mask = (1 << (hi - lo)) - 1
        v = (state >> lo) & mask
        for s in part:
            u = v & (place.get(s, 0) >> lo)
            v = ((v + u) | (v - u)) & mask
        state = (state & ~(mask << lo)) | v << lo
    return len(y) - (state & full).bit_count()


def similarity(x: np.ndarray, y: np.ndarray, least: float, labels: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """L / (n + m - L), or something below ``least`` where it is below; ``labels``
    are the labelled shingles of both where they are known."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return 0.0
    p, q = labels or (labelled(x, np.array([0, n])), labelled(y, np.array([0, m])))
    common, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    if len(common) < need:
        return len(common) / (n + m - len(common))  # an upper bound
    if (np.diff(j[np.argsort(i)]) > 0).all():
        size = len(common)  # the bound is reached: all that is common stands in the same order
    else:
        size = common_in_order(x, y, need)
    return size / (n + m - size)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b), root being the least of its
    component, by alternating large and small stars until there are only stars.
    Tables of finished rounds go.  Groups are aggregated before they are shuffled, and
    the edges of a hot node are dealt over SALTS tasks; nothing is broadcast, for the
    driver would hold what each round sends."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up > 0 and n > up)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").select("u", "v", _salt("v")).join(low.select("u", "m", _each_salt()).hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("u", "v", _salt("v")).join(low.select("u", "m", _each_salt()).hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, stored(small, "stars")
        dropped(last)


def linked(first: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(node, root) of the classes of representatives (rep, doc_id, mark, size, keys)
    that have links; rows: (doc_id, text).

    Every pair that shares a sketch is decided: aligned, ruled out by the number of
    shingles it shares, or of one class by other links.  First each document is
    aligned with the pivots of its buckets, which are few.  Buckets whose members are still of several classes are taken
    apart by the prefix filter; families are the components of what shares one of
    its buckets, and their pairs of different classes are aligned if they share
    enough shingles.  Each step lets every pair of similarity ``least`` pass, so
    nothing is capped.  Its tables go when the classes are known.
    """
    kept: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        kept.append(stored(df, name))
        return kept[-1]

    def more(pairs: DataFrame) -> DataFrame:
        links.append(held(aligned(held(pairs, "pairs"), texts, least), "links"))
        if links[-1].isEmpty() and len(links) > 1:
            return roots
        return held(components(reduce(DataFrame.unionByName, links)), "roots")

    def finished() -> DataFrame:
        out = stored(roots, "roots")
        for df in kept:
            dropped(df)
        return out

    links: list[DataFrame] = []
    members = held(opened(first.select("rep", "size", F.explode("keys").alias("key"), F.col("rep").alias("root"))), "buckets")
    placed = first.select("rep", "doc_id", "mark").join(members.select("rep").distinct(), "rep")
    found = rows.select("doc_id", mark_of(), "text").join(placed.hint("merge"), ["doc_id", "mark"]).dropDuplicates(["rep"])
    texts = held(found.select("rep", "text"), "texts")
    roots = more(pivot_pairs(members, least).distinct())
    rest = opened(rooted(members.where("rep <> pivot").select("key", "rep", "size"), roots))
    left = held(texts.join(rest.select("rep").distinct().hint("merge"), "rep"), "texts")
    if left.isEmpty():
        return finished()
    members = held(opened(rooted(prefixes(left, least), roots)), "prefixes")
    family = components(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    family = rooted(family.select(F.col("node").alias("rep"), F.col("root").alias("family")), roots)
    family = held(family.join(first.select("rep", "size"), "rep"), "families")
    in_family = left.join(family.select("rep"), "rep", "left_semi")
    roots = more(unsettled(family_pairs(family, in_family, least), roots))
    return finished()


def row_classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", kept: list[DataFrame] | None = None) -> DataFrame:
    """For each row with an id: doc_id, mark (``mark_of``), copy_of, class_id and
    class_mark: the row of least (doc_id, mark) stands for its class.  Tables that the
    result reads are added to ``kept``."""
    rows = id_text(docs, id_col, text_col).where("doc_id is not null")
    every = stored(sketches(rows), "sketches")
    groups = every.groupBy("digest").agg(F.min(F.struct("doc_id", "mark", "size", "keys")).alias("least"), F.count("*").alias("n"))
    # 64 bits of the digest name a representative
    rep = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long").alias("rep")
    named = stored(groups.select("digest", rep, "n", "least.*"), "representatives")
    roots = linked(named.where("keys is not null").select("rep", "doc_id", "mark", "size", "keys"), rows, least)
    if kept is not None:
        kept += [every, named, roots]
    head = F.struct("doc_id", "mark").alias("head")
    known = named.select("digest", "rep", "n", head).join(roots.withColumnRenamed("node", "rep"), "rep", "left").where("root is not null or n > 1")
    heads = known.where("root is not null").groupBy("root").agg(F.min("head").alias("first"))
    known = known.join(heads, "root", "left").select("digest", F.col("head.doc_id").alias("copy_of"), F.coalesce("first", "head").alias("head"))
    met = every.select("doc_id", "mark", "digest").join(known.hint("merge"), "digest", "left")
    return met.select("doc_id", "mark", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("head.mark", "mark").alias("class_mark"))


def near_copies(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near copies of every document: doc_id, copy_of, class_id.

    Words are runs of letters, digits, underscores and non-ASCII characters,
    small letters; documents of equal word sequences (texts, where there are no
    words, so empty and null texts are copies of each other) are copies:
    copy_of is the least id among them.  Classes are the components of links of
    similarity ``least`` or more; class_id is the least doc_id of a class.  A
    text of fewer than five words is one shingle.  Each input row gives a row:
    repeated rows are copies, rows of one id with different texts are judged
    each; a row without an id is a class of its own (null); other columns are
    left out; an empty table gives no rows.  Copies are one entry from the start;
    see ``linked`` for the rest.
    """
    nameless = id_text(docs, id_col, text_col).where("doc_id is null").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("copy_of", "class_id")])
    return row_classes(docs, least, id_col, text_col).select("doc_id", "copy_of", "class_id").unionByName(nameless)


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each class of near copies, all
    columns; rows without an id stay.

    The row of least doc_id, then of the least hash of its text, stays; of rows
    that are equal in both the one least in its other columns, in their order (maps
    are left out of it).  Every other row stays as it is; an empty table stays empty.
    """
    spare = [f"{c}_of_near_copies" for c in ("id", "mark")]
    kept: list[DataFrame] = []
    ids = row_classes(docs, least, kept=kept)
    n = ids.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id"), F.min("class_mark").alias("class_mark"))
    alone = (F.col("class_id") == F.col("doc_id")) & (F.col("class_mark") == F.col("mark"))
    odd = stored(n.where(~alone | (F.col("n") > 1)).select(F.col("doc_id").alias(spare[0]), F.col("mark").alias(spare[1]), alone.alias("stays_of_near_copies")), "fates")
    for df in kept:
        dropped(df)
    same = (F.col("doc_id") == odd[spare[0]]) & (mark_of() == odd[spare[1]])
    plain = docs.join(odd.hint("merge"), same, "left_anti")
    repeated = odd.where("stays_of_near_copies")
    if repeated.isEmpty():
        return plain
    order = [F.col(c) for c, f in zip(_quoted(docs), docs.schema) if "map<" not in f.dataType.simpleString()]
    many = docs.join(repeated.hint("merge"), same)
    many = many.groupBy(*spare).agg(F.min_by(F.struct(*[F.col(c) for c in _quoted(docs)]), F.struct(*order)).alias("row"))
    return plain.unionByName(many.select(*[F.col("row")[f.name].alias(f.name) for f in docs.schema]))


def _quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]
