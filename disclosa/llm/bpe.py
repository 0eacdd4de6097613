"""Byte-level BPE by prefix dynamic programming, and packing's token source.

For every prefix of a byte string there is exactly one token that can end its
encoding.  ``PrefixTable`` stores that token for each prefix: the encoding of
any prefix is read by walking back, an append only adds entries, and after an
edit entries are recomputed just until they agree with the old ones again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import id_text, utf8

#: Entries of the automaton and the trie of a process; bytes of a generation of a memo,
#: and of the one of parts between spaces; bytes from which a piece or part is encoded
#: by itself and not remembered.
MEMO, MEMO_BYTES, PARTS_BYTES, LONG = 250_000, 50_000_000, 100_000_000, 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PrefixBpe:
    """Ranks of byte-level BPE with the test for pairs of neighbouring tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for t, i in ranks.items():
            self.token[i] = t
        self.split: list[tuple[int, int] | None] = [None] * self.size
        self.merged: dict[tuple[int, int], int] = {}
        self.heads: dict[bytes, int] = {b"": 0}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(t) + 1):
                self.heads.setdefault(t[:k], len(self.heads))
            for cut in range(1, len(t)):
                left, right = ranks.get(t[:cut]), ranks.get(t[cut:])
                if left is not None and right is not None and left < i and right < i and self.adjacent(left, right):
                    self.split[i], self.merged[left, right] = (left, right), i
                    break
        self.longest = max(map(len, ranks))
        self.states = list(self.heads)
        self.go: dict[int, int] = {}
        self.endings: list[list[tuple[int, int]] | None] = [None] * len(self.states)
        self.apart: dict[int, bool] = {}
        self.size_of = list(map(len, self.token))
        self.trie: tuple[dict[int, int], list[int], list[int]] = ({}, [-1], [0])

    def step(self, state: int, byte: int) -> int:
        """The longest beginning of a token that ends with this byte."""
        s = self.states[state] + bytes((byte,))
        while s not in self.heads:
            s = s[1:]
        if len(self.go) >= 4 * MEMO:
            self.go.clear()
        self.go[state << 8 | byte] = out = self.heads[s]
        return out

    def ending(self, state: int) -> list[tuple[int, int]]:
        """(token, length) of the tokens that end where the state does, longest first."""
        s = self.states[state]
        self.endings[state] = out = [(self.rank[s[k:]], len(s) - k) for k in range(len(s)) if s[k:] in self.rank]
        return out

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart.

        Undoes merges from the latest to the earliest on either side of the
        boundary; a merge across it that ranks before the last undone one
        would have happened first.
        """
        split, merged, limit = self.split, self.merged, 1 << 62
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = split[left], split[right]
            # of equal-rank merges the left one goes first, so the right one is undone first
            if a is not None and (b is None or left > right):
                limit, left = left, a[1]
            elif b is not None:
                limit, right = right + 1, b[0]
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        """Entries of prefixes met before are found in a trie, new ones added to it."""
        t = self.rank.get(piece)
        if t is not None:
            return [t]
        if len(piece) > LONG:
            return self.encode_long(piece)
        trie, tokens, states = self.trie
        if len(tokens) >= 2 * MEMO:
            self.trie = trie, tokens, states = {}, [-1], [0]
        last, node, n = [-1], 0, len(piece)
        for i in range(n):
            at = trie.get(node << 8 | piece[i])
            if at is None:
                break
            node = at
            last.append(tokens[node])
        else:
            i = n
        if i < n:
            go, endings, apart, state = self.go, self.endings, self.apart, states[node]
            for i in range(i, n):
                x = piece[i]
                key = state << 8 | x
                state = go[key] if key in go else self.step(state, x)
                for t, k in endings[state] or self.ending(state):
                    left = last[i + 1 - k]
                    if left < 0:
                        break
                    pair = left << 20 | t
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) >= MEMO:
                            apart.clear()
                        ok = apart[pair] = self.adjacent(left, t)
                    if ok:
                        break
                else:
                    raise ValueError("a byte has no token")
                last.append(t)
                trie[node << 8 | x] = node = len(tokens)
                tokens.append(t)
                states.append(state)
        size, out = self.size_of, []
        while n:
            out.append(t := last[n])
            n -= size[t]
        out.reverse()
        return out

    def encode_long(self, piece: bytes) -> array:
        """The same for a piece of any length: four bytes for each entry and each id."""
        last = array("i", [-1])
        for _ in self.fill(piece, last, 0, 0):
            pass
        size, out, n = self.size_of, array("I"), len(piece)
        while n:
            out.append(t := last[n])
            n -= size[t]
        del last
        out.reverse()
        return out

    def fill(self, data: bytes, last, state: int, begin: int):
        """Adds the entries after the first ``begin`` bytes and yields each."""
        go, endings, apart = self.go, self.endings, self.apart
        for i in range(begin, len(data)):
            key = state << 8 | data[i]
            state = go[key] if key in go else self.step(state, data[i])
            for t, n in endings[state] or self.ending(state):
                left = last[i + 1 - n]
                if left < 0:
                    break
                pair = left << 20 | t
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) >= MEMO:
                        apart.clear()
                    ok = apart[pair] = self.adjacent(left, t)
                if ok:
                    break
            else:
                raise ValueError("a byte has no token")
            last.append(t)
            yield t


class PrefixTable:
    """last[i]: the token that ends the encoding of the first i bytes."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def _state(self, data: bytes, at: int) -> int:
        state = 0
        for x in data[max(0, at - self.bpe.longest) : at]:
            key = state << 8 | x
            state = self.bpe.go[key] if key in self.bpe.go else self.bpe.step(state, x)
        return state

    def append(self, more: bytes) -> None:
        """Exact: no entry of a shorter prefix changes."""
        begin, self.data = len(self.data), self.data + more
        for _ in self.bpe.fill(self.data, self.last, self._state(self.data, begin), begin):
            pass

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for bytes start:stop; returns how many entries were recomputed.

        An entry depends on the entries of the bytes its candidate tokens
        span, so once a longest token's worth of entries agrees, the rest does.
        """
        data, old, shift = self.data[:start] + new + self.data[stop:], self.last, len(new) - (stop - start)
        last, same, i = old[: start + 1], 0, start
        for t in self.bpe.fill(data, last, self._state(data, start), start):
            i += 1
            same = same + 1 if i > start + len(new) and old[i - shift] == t else 0
            if same >= self.bpe.longest:
                last += old[i - shift + 1 :]
                break
        self.data, self.last = data, last
        return i - start

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes."""
        i, out = len(self.data) if length is None else length, []
        while i:
            out.append(t := self.last[i])
            i -= len(self.bpe.token[t])
        return out[::-1]


def packed(ids) -> bytes:
    out = ids if isinstance(ids, array) else array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Unsafe(Exception):
    """A part between spaces that touches other white space."""


class Memo(dict):
    """Computes what is missing; holds at most two generations of ``most`` bytes (keys,
    values and what a dictionary needs), of which the older one goes when the younger is
    full.  Long keys are not held."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.older, self.held = compute, most, {}, 0

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.compute(key)
        if len(key) > LONG:
            return out
        if self.held >= self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = out
        self.held += 2 * len(key) + len(out) + 200
        return out


#: Characters by class: the first is one that every table of Unicode puts there.
CLASSES = {r"\p{L}": "a", r"\p{N}": "0", r"\s": "\t"}


def members(escape: str) -> str:
    """The characters that tiktoken itself takes for this class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(plain.encode_ordinary(every)).decode()


def stand_ins() -> dict[int, str]:
    """For the characters that ``regex`` puts in another class than tiktoken, whose
    tables of Unicode are older: one of tiktoken's class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own, theirs = {}, {}
    for escape, char in CLASSES.items():
        own |= dict.fromkeys(regex.findall(escape, every), char)
        theirs |= dict.fromkeys(members(escape), char)
    return {ord(c): theirs.get(c, "!") for c in own.keys() | theirs.keys() if own.get(c) != theirs.get(c)}


class TextEncoder:
    """Whole texts to packed little-endian uint32 ids.

    Splitting at single spaces cuts only where the pattern also does, because
    a piece takes at most one space and only at its front; texts where a part
    is empty or touches other white space go through the pattern as a whole.
    """

    def __init__(self, pattern: str, encode_piece):
        self.pattern, self.encode_piece, self.stand_ins = regex.compile(pattern), encode_piece, stand_ins()
        self.piece = lambda p: packed(encode_piece(p.encode("utf-8", "replace")))
        self.pieces = Memo(self.piece, MEMO_BYTES)
        self.spaced, self.bare = Memo(self.part, PARTS_BYTES), Memo(lambda p: self.part(p, ""), MEMO_BYTES)

    def split(self, text: str) -> list[str]:
        """The pieces that tiktoken makes of a text."""
        if text.isascii() or self.stand_ins.keys().isdisjoint(map(ord, set(text))):
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def part(self, part: str, lead: str = " ") -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise Unsafe
        pieces = self.split(lead + part)
        # a part of one piece is remembered as a part
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            return self.bare[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))
        except Unsafe:
            return self.by_pieces(text)


_LOADED: dict[tuple[int, str], TextEncoder] = {}


def loaded(data: bytes, pattern: str) -> TextEncoder:
    """One encoder for each process and vocabulary."""
    key = hash(data), pattern
    if key not in _LOADED:
        _LOADED.clear()
        bpe = PrefixBpe(read_ranks(data))
        _LOADED[key] = enc = TextEncoder(pattern, bpe.encode)
        enc.bpe = bpe
        gc.freeze()  # the vocabulary's objects need no further garbage collection
    return _LOADED[key]


#: Ids that are decoded at once.
DECODED = 1 << 16


def decoded(token: list[bytes], data: bytes):
    """The bytes of ids, some at a time."""
    for at in range(0, len(data), 4 * DECODED):
        yield b"".join(map(token.__getitem__, np.frombuffer(data[at : at + 4 * DECODED], "<u4").tolist()))


def decode(token: list[bytes], data: bytes) -> bytes:
    return b"".join(decoded(token, data))


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, n_tokens, ids (array<int>; only with ``keep_ids``),
    ids_sha256 (of ids as little-endian uint32) and decoded_sha256.  One row
    for each input row: repeated rows repeat, a null text is an empty one (no
    ids, digests of the empty string), a null doc_id stays null, other columns
    are left out, an empty table gives an empty result.

    A piece of any length takes about ten bytes of memory for each of its own, and memos
    hold a fixed number of bytes.  The vocabulary is read where the driver runs and broadcast: its size is
    fixed and does not follow the corpus.  No shuffle.
    """
    with open(vocab_path, "rb") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = loaded(vocab.value, pattern)
        token = enc.bpe.token
        for batch in batches:
            raw, off = utf8(batch.column(1))
            whole, n, sha_i, sha_d, ids = raw.tobytes(), [], [], [], []
            for i in range(len(off) - 1):
                data = enc.encode(whole[off[i] : off[i + 1]].decode("utf-8", "replace"))
                n.append(len(data) // 4)
                sha_i.append(hashlib.sha256(data).hexdigest())
                sha = hashlib.sha256()
                for some in decoded(token, data):
                    sha.update(some)
                sha_d.append(sha.hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(data, "<u4").astype(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64())]
            names = ["doc_id", "n_tokens"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sha_i, pa.string()), pa.array(sha_d, pa.string())], [*names, "ids_sha256", "decoded_sha256"])

    ids = "ids array<int>, " if keep_ids else ""
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
