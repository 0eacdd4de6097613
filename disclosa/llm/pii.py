"""Personal data: strict patterns find seeds, contexts of the seeds find more.

Seeds are e-mail addresses, IPs, card and phone numbers by their patterns.  The words
before a seed are lexical patterns; numbers and tokens that the strict patterns refuse are
candidates.  Patterns and values form a graph that Spark scores in rounds: a pattern is
as good as the share of its occurrences in the corpus that are followed by a known value
of a kind, a value as sure as its patterns together (noisy-or).  Values that become sure
count in the next round, and all their mentions are spans of the result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Words, answered, blocks, dropped, fold, mix, stored, utf8

KINDS = ("email", "ip", "card", "phone")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
LOCAL, DIGIT, PHONE = _class(_ALNUM + b"._%+-"), _class(b"0123456789"), _class(b"0123456789 ().-")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOOSE, HEX, AT = _class(b" ()-./"), _class(b"0123456789abcdefABCDEF:"), re.compile(rb" ?[\[(]at[\])] ?", re.I)
#: Words of contexts end at white space and at these.
CUTS = SPACE | _class(b":=\"'()[]<>,;")
#: A pattern takes part when it stands before this many different values; a value is sure
#: from this confidence on; patterns below this share count for nothing; rounds.
SUPPORT, SURE, LEAST, ROUNDS = 5, 0.8, 0.5, 3
#: Slots of the filter of patterns that the corpus is counted for (a power of two).
SLOTS = 1 << 21


def luhn(digits: bytes) -> bool:
    odd = sum(x - 48 for x in digits[-1::-2])
    return (odd + sum((2 * (x - 48)) // 10 + (2 * (x - 48)) % 10 for x in digits[-2::-2])) % 10 == 0


class Block:
    """The bytes of some consecutive texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off, self.data = raw, off, raw.tobytes()
        self.digits = np.flatnonzero(DIGIT[raw])
        self.doc = self.docs(self.digits)

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def runs(self, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index of runs of digits; ``linked``: digit i goes on in i + 1."""
        cut = np.flatnonzero(~linked)
        return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(self.digits) - 1]])

    def emails(self):
        at, end = np.flatnonzero(self.raw == 64), 0
        if not len(at):
            return
        other = np.flatnonzero(~LOCAL[self.raw])  # each @ is one of them
        before = np.searchsorted(other, at) - 1
        begin = np.where(before >= 0, other[before] + 1, 0)
        docs = self.docs(at)
        for p, s, d in zip(at.tolist(), np.maximum(begin, self.off[docs]).tolist(), docs.tolist()):
            s = max(s, end)
            if s < p and (m := DOMAIN.match(self.data, p, int(self.off[d + 1]))):
                end = m.end()
                yield 0, d, s, end

    def ips(self):
        if len(self.digits) < 4:
            return
        pos = self.digits
        first, last = self.runs((np.diff(pos) == 1) & (np.diff(self.doc) == 0))
        s, e, doc = pos[first], pos[last] + 1, self.doc[first]
        dotted = (s[1:] == e[:-1] + 1) & (doc[1:] == doc[:-1]) & (self.raw[np.minimum(e[:-1], len(self.raw) - 1)] == 46)
        new = np.concatenate([[True], ~dotted])
        begin = np.flatnonzero(new)
        chain = np.cumsum(new) - 1
        size = np.diff(np.append(begin, len(s)))[chain]
        j = np.arange(len(s)) - begin[chain]
        for i in np.flatnonzero((j % 4 == 0) & (size - j >= 4)).tolist():
            parts = [self.data[s[k] : e[k]].lstrip(b"0") for k in range(i, i + 4)]
            if all(len(x) < 3 or len(x) == 3 and int(x) <= 255 for x in parts):
                yield 1, int(doc[i]), int(s[i]), int(e[i + 3])

    def cards(self):
        if len(self.digits) < 16:
            return
        pos, gap, same = self.digits, np.diff(self.digits), np.diff(self.doc) == 0
        between = self.raw[pos[:-1] + 1]
        first, last = self.runs(same & ((gap == 1) | (gap == 2) & ((between == 32) | (between == 45))))
        n = last - first + 1
        for i in np.flatnonzero((n >= 16) & (n <= 19)).tolist():
            if luhn(self.raw[pos[first[i] : last[i] + 1]].tobytes()):
                yield 2, int(self.doc[first[i]]), int(pos[first[i]]), int(pos[last[i]]) + 1

    def phones(self):
        plus = np.flatnonzero(self.raw == 43)
        if not len(plus) or not len(self.digits):
            return
        docs = self.docs(plus)
        end = self.off[docs + 1]
        other = np.append(np.flatnonzero(~PHONE[self.raw]), len(self.raw))
        stop = np.minimum(other[np.minimum(np.searchsorted(other, plus + 2), len(other) - 1)], end)
        digit = np.append(DIGIT[self.raw], False)
        k = np.searchsorted(self.digits, stop)
        last = np.where(k > 0, self.digits[np.maximum(k - 1, 0)], -1)
        n = k - np.searchsorted(self.digits, plus)
        good = (plus + 1 < end) & digit[np.minimum(plus + 1, len(self.raw))] & (last >= plus + 3) & (n >= 8) & (n <= 15)
        for i in np.flatnonzero(good).tolist():
            yield 3, int(docs[i]), int(plus[i]), int(last[i]) + 1

    def seeds(self) -> list[tuple[int, int, int, int]]:
        """(kind, document, start, end) of the strict patterns, in bytes, in the order
        document, kind, start."""
        return sorted([*self.emails(), *self.ips(), *self.cards(), *self.phones()], key=lambda x: (x[1], x[0], x[2]))

    def candidates(self, seeds):
        """(kinds as bits, document, start, end) of what may be an identifier and touches
        no seed: numbers of 7 to 19 digits with up to two of ' ()-./' between, groups of
        hex digits with three colons, tokens with @ or (at)."""
        taken = np.array(sorted((s, e) for _, _, s, e in seeds), np.int64).reshape(-1, 2)
        high = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

        def free(s, e):
            k = np.searchsorted(taken[:, 0], e) - 1  # the last seed that begins before e
            return k < 0 or high[k] <= s

        found = []
        if len(pos := self.digits):
            gap, same, loose = np.diff(pos), np.diff(self.doc) == 0, np.append(LOOSE[self.raw], [False, False])
            one, two = loose[pos[:-1] + 1], loose[np.minimum(pos[:-1] + 2, len(loose) - 1)]
            first, last = self.runs(same & ((gap == 1) | (gap == 2) & one | (gap == 3) & one & two))
            n = last - first + 1
            for i in np.flatnonzero((n >= 7) & (n <= 19)).tolist():
                found.append(((8 if n[i] <= 15 else 0) | (4 if n[i] >= 12 else 0), int(self.doc[first[i]]), int(pos[first[i]]), int(pos[last[i]]) + 1))
        colon = np.flatnonzero(self.raw == 58)
        if len(colon) >= 3:
            inside = HEX[self.raw]
            flips = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
            s, e = flips[::2], flips[1::2]
            n = np.searchsorted(colon, e) - np.searchsorted(colon, s)
            d = self.docs(s)
            for i in np.flatnonzero((n >= 3) & (n <= 8) & (e - s - n >= 4) & (e - s <= 39) & (e <= self.off[d + 1])).tolist():
                found.append((2, int(d[i]), int(s[i]), int(e[i])))
        marks = [(p, p + 1) for p in np.flatnonzero(self.raw == 64).tolist()] + [m.span() for m in AT.finditer(self.data)]
        for p, q in marks:
            d = int(self.docs(np.array([p]))[0])
            lo, hi = max(int(self.off[d]), p - 64), min(int(self.off[d + 1]), q + 255)
            s = p - len(re.search(rb"[^\s@]*$", self.data[lo:p]).group())
            e = q + len(re.match(rb"[^\s@]*", self.data[q:hi]).group().rstrip(b".,;:!?)>]\"'"))
            s += len(self.data[s:p]) - len(self.data[s:p].lstrip(b"(<[\"'"))
            if s < p and q < e and e <= hi:
                found.append((1, d, s, e))
        end = -1
        for bits, d, s, e in sorted(found, key=lambda x: (x[2], -x[3])):
            if s >= end and free(s, e):
                end = e
                yield bits, d, s, e


def _plain(raw: np.ndarray) -> np.ndarray:
    """Text as contexts see it: small letters, digits as 0."""
    out = fold(raw)
    out[DIGIT[out]] = 48
    return out


class Contexts:
    """The words of a block and, for each, the keys of the patterns that end with it."""

    def __init__(self, block: Block):
        self.text = _plain(block.raw)
        self.words = Words(self.text, block.off, CUTS)
        h = self.words.hashes
        self.one = mix(h ^ U64(0x51))
        self.two = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            self.two[1:] = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
        starts = self.words.ptr[:-1]
        self.two[starts[starts < len(h)]] = 0  # the first word of a text has none before it

    def word(self, i: int) -> str:
        """A word as text; a very long one by its digest."""
        x = self.text[self.words.starts[i] : self.words.ends[i]].tobytes()
        return x.decode("utf-8", "replace") if len(x) <= 40 else f"#{hashlib.md5(x).hexdigest()}"

    def before(self, doc: int, start: int) -> list[tuple[int, str]]:
        """(key, text) of the patterns before a byte."""
        w, lo = self.words, int(self.words.ptr[doc])
        i = int(np.searchsorted(w.ends, start, "right")) - 1
        i = min(i, int(w.ptr[doc + 1]) - 1)
        if i < lo:
            return []
        out = [(_signed(self.one[i]), self.word(i))]
        if i > lo:
            out.append((_signed(self.two[i]), f"{self.word(i - 1)} {self.word(i)}"))
        return out


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


SPAN = "struct<kind:int,start:long,end:long>"
MENTION = "struct<kinds:int,seed:boolean,start:long,end:long,value:string,keys:array<long>,patterns:array<string>>"


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_md5, seeds (in the order kind, start; in code
    points), base_sha256 and found: seeds and candidates with the patterns before them."""

    def value(bits, data):
        return re.sub(rb"[^0-9]", b"", data).decode() if bits & 12 else data.decode("utf-8", "replace").lower()

    def run(batches):
        for b in batches:
            ids, column = b.column(0), b.column(1)
            raw, off = utf8(column)
            for i, j in blocks(off):
                block = Block(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                seeds = block.seeds()
                also = list(block.candidates(seeds))
                n, rows = j - i, {}
                chars = np.concatenate([[0], np.cumsum((block.raw & 0xC0) != 0x80)]) if seeds or also else None
                contexts = Contexts(block) if seeds or also else None
                for bits, seed, d, s, e in [(1 << k, True, d, s, e) for k, d, s, e in seeds] + [(k, False, d, s, e) for k, d, s, e in also]:
                    zero = chars[block.off[d]]
                    ahead = contexts.before(d, s)
                    own = rows.setdefault(d, ([], []))
                    at = int(chars[s] - zero), int(chars[e] - zero)
                    if seed:
                        own[0].append({"kind": bits.bit_length() - 1, "start": at[0], "end": at[1]})
                    own[1].append({"kinds": bits, "seed": seed, "start": at[0], "end": at[1], "value": value(bits, block.data[s:e]), "keys": [k for k, _ in ahead], "patterns": [t for _, t in ahead]})
                md5 = [hashlib.md5(block.data[block.off[d] : block.off[d + 1]]).digest() if rows.get(d, ([], []))[1] else None for d in range(n)]
                text = [",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in rows[d][0]) if d in rows else "" for d in range(n)]
                cols = [ids.slice(i, n), pa.array(md5, pa.binary()), pa.array([rows.get(d, ([], []))[0] for d in range(n)], _SPANS), pa.array([hashlib.sha256(t.encode()).hexdigest() if t else EMPTY for t in text]), pa.array([rows.get(d, ([], []))[1] for d in range(n)], _MENTIONS)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_md5", "seeds", "base_sha256", "found"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id long, text_md5 binary, seeds array<{SPAN}>, base_sha256 string, found array<{MENTION}>")


EMPTY = hashlib.sha256(b"").hexdigest()
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_MENTIONS = pa.list_(pa.struct([("kinds", pa.int32()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("keys", pa.list_(pa.int64())), ("patterns", pa.list_(pa.string()))]))


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): how often each of ``patterns`` (key) stands in the corpus, before
    whatever.  Tasks count what passes a filter of fixed size, the rest is exact."""
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    cells = patterns.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("bits")).collect()
    passes = np.zeros(SLOTS // 32, np.uint32)  # 256 kB
    for r in cells:
        passes[r["cell"]] = r["bits"]

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(0))
            for i, j in blocks(off):
                c = Contexts(Block(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                key = np.concatenate([c.one, c.two])
                at = (key & U64(SLOTS - 1)).astype(np.int64)
                key = key[(passes[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1]
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n")).join(patterns.select("key"), "key", "left_semi")


def bootstrapped(docs: DataFrame, found: DataFrame, support: int = SUPPORT, sure: float = SURE, least: float = LEAST, rounds: int = ROUNDS, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(values, patterns) after some rounds: the sure new values (value, kind, score) and
    the patterns that vouch for a kind (key, kind, score, pattern).

    A pattern takes part once ``support`` different values follow it.  Its score for a
    kind is the share that known values of the kind, each counted by its own score (a
    seed: 1), have of what follows it in the whole corpus: different seeds and candidates
    once each, so that copies do not count, other words at each occurrence.  A value's
    score is the noisy-or of its patterns from ``least`` on; it is known from ``sure`` on.
    """
    each = found.select(F.explode("found").alias("m")).select("m.*")
    edges = each.select("value", "seed", "kinds", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("patterns").alias("pattern"))))
    edges = stored(edges.groupBy("key", "value", "seed", "kinds").agg(F.count("*").alias("c"), F.min("pattern").alias("pattern")), "edges")
    known = edges.groupBy("key").agg(F.countDistinct("value").alias("values"), F.max("seed").alias("seeds"), F.sum("c").alias("c"), F.min("pattern").alias("pattern")).where((F.col("values") >= support) & F.col("seeds"))
    known = stored(known.drop("seeds"), "patterns")
    totals = stored(occurrences(docs, known, text_col).join(known, "key").select("key", (F.col("n") - F.col("c") + F.col("values")).alias("n")), "totals")
    kinds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.getbit("kinds", k) == 1))
    graph = edges.join(known.select("key"), "key", "left_semi").select("key", "value", "seed", kinds.alias("kind"))
    graph = stored(graph.groupBy("key", "value", "kind").agg(F.max("seed").alias("seed"), F.min("seed").alias("settled")), "graph")
    dropped(edges)
    total = graph.count()
    seeds = graph.where("seed").select("value", "kind").distinct().withColumn("label", F.lit(1.0))
    labels = seeds
    values = patterns = None
    for _ in range(rounds):
        held = answered(graph, labels, ["value", "kind"], total)
        scored = held.where("label is not null").groupBy("key", "kind").agg(F.sum("label").alias("hits"), F.count("*").alias("values")).where(F.col("values") >= support)
        scored = scored.join(totals, "key").withColumn("score", F.least(F.col("hits") / (F.col("n") + 1), F.lit(1.0))).where(F.col("score") >= least).select("key", "kind", "score")
        patterns = stored(scored, "scores")
        vouched = answered(graph.where("not settled").select("key", "value", "kind"), patterns, ["key", "kind"], total).where("score is not null")
        noisy = (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))))).alias("score")
        values = stored(vouched.groupBy("value", "kind").agg(noisy).where(F.col("score") >= sure), "values")
        more = values.select("value", "kind", F.col("score").alias("label"))
        labels = seeds.unionByName(more).groupBy("value", "kind").agg(F.max("label").alias("label"))
    best = values.groupBy("value").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"), F.max("score").alias("score"))
    return best, patterns.join(known, "key")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """Spans of personal data, a row for each input row: doc_id, base (the seeds), added
    (what the contexts found; touches no seed), base_sha256; spans are (kind, start, end)
    in code points, kind an index into KINDS, in the order kind, start.

    Null and empty texts have no spans; repeated rows repeat, and so does their evidence,
    but a pattern must stand before ``SUPPORT`` different values; a null doc_id stays;
    other columns are not read; an empty table gives no rows.
    """
    found = stored(mentions(docs, id_col, text_col), "mentions")
    values, _ = bootstrapped(docs, found, text_col=text_col, **scoring)
    texts = found.where(F.exists("found", lambda m: ~m["seed"])).select("text_md5", "found")
    texts = texts.groupBy("text_md5").agg(F.any_value("found").alias("found")).select("text_md5", F.inline("found"))
    new = stored(texts.where("not seed").select("text_md5", "value", "start", "end", "kinds"), "candidates")
    n = new.count()
    new = answered(new, values, ["value"], n).where("kind is not null and getbit(kinds, kind) = 1")
    new = stored(new.groupBy("text_md5").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")), "added")
    none = F.array().cast(f"array<{SPAN}>")
    asks = found.select("doc_id", "text_md5", F.col("seeds").alias("base"), "base_sha256")
    return answered(asks, new, ["text_md5"], asks.count()).select("doc_id", "base", F.coalesce("added", none).alias("added"), "base_sha256")


def spans_text(spans) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"], x["end"])), ",")
