"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays
within a document).  Documents go in descending length to the sequence of
lowest cost that has token capacity left; what does not fit goes on to the
next such sequence.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, utf8

#: Tokens packed together; bounds the memory of a task.
POOL = 4_000_000


def capacities(total: int, size: int) -> list[int]:
    """Sequence lengths that ``total`` tokens fill exactly: ``size`` as often as
    it fits, then the powers of two of the rest, which need no padding."""
    full, rest = divmod(total, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Equal lengths keep their order, equal costs go to the lower sequence.
    """
    room = capacities(sum(lengths), size)
    used, out, whole, rest = [0] * len(room), [], 0, []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= size:
            out.append((d, at, size, whole, 0))
            whole, at = whole + 1, at + size
        if n > at:
            rest.append((at - n, d, at))
    heap = [(0.0, s) for s in range(whole, len(room))]
    for left, d, at in sorted(rest):
        left = -left
        while left:
            cost, s = heapq.heappop(heap)
            n = min(left, room[s] - used[s])
            out.append((d, at, n, s, used[s]))
            used[s], at, left = used[s] + n, at + n, left - n
            if used[s] < room[s]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, s))
    return out


def byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in
    order, as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Characters that the pattern takes for white space (fixed values).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer runs of white space are cut out of texts of more characters than CUT; the
#: pattern's look ahead goes back over a run and fails beyond about 700,000.
RUN, CUT = 10_000, 100_000


class Tokenizer:
    """The vocabulary of a ``tokenizers`` file in the faster encoder of ``tiktoken``;
    both give the same ids (tested), for merges rank as ids do.  The file's added
    tokens are special tokens here: in a text they are one id."""

    def __init__(self, data: bytes, pattern: str):
        byte = byte_of()
        read = json.loads(data)
        self.ranks = {bytes(byte[c] for c in token): i for token, i in read["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.text = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.added)
        self.piece = None
        self.runs = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{RUN},}}")

    def _bytes(self, text: str) -> bytes:
        return self.text.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def _spaces(self, run: str) -> bytes:
        """A run of white space that is one piece."""
        if self.piece is None:
            self.piece = tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={})
        return np.asarray(self.piece.encode_ordinary(run), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32.  The pattern ends a piece before white space,
        and a run of it is one piece but for a last character that leads to the next."""
        if len(text) <= CUT:
            return self._bytes(text)
        out, at = [], 0
        for m in self.runs.finditer(text):
            end = m.end()
            if end < len(text) and not text.startswith(tuple(self.added), end):
                end -= 1
            out += [self._bytes(text[at : m.start()]), self._spaces(text[m.start() : end])]
            at = end
        return b"".join([*out, self._bytes(text[at:])])


_LOADED: dict[int, Tokenizer] = {}


def _tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """One for each process and vocabulary."""
    key = hash((data, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(data, pattern)
    return _LOADED[key]


def pack_documents(docs: DataFrame, vocab_path: str, pattern: str, size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, pool: int = POOL) -> DataFrame:
    """Pack whole documents, each ended by ``end_id``, into sequences of ``size`` tokens.

    One row for each piece: doc_id, start, length, ids (with ``keep_ids``),
    ids_crc32, doc_tokens, sequence_id, offset.  Sequences are filled to the
    last token; what is left of a pool of about ``pool`` tokens makes shorter
    sequences whose lengths are powers of two.  A null or empty text is a
    document of just ``end_id``; repeated rows are packed each; a null doc_id
    stays null; other columns are left out; an empty table gives no rows; white space
    of any length is encoded whole.

    Each task packs what it reads: no shuffle, and a task run again gives the
    same pieces.
    """
    with open(vocab_path, "rb") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc, next_id = _tokenizer(vocab.value, pattern), TaskContext.get().partitionId() << 40
        ids, packs, tokens = [], [], 0

        def flush():
            nonlocal next_id
            pieces = assign([len(x) // 4 for x in packs], size, linear, quadratic)
            cut = [packs[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            col = lambda x, t=pa.int64(): pa.array(x, t)
            cols = {"doc_id": col([ids[p[0]] for p in pieces]), "start": col([p[1] for p in pieces]), "length": col([p[2] for p in pieces])}
            if keep_ids:
                cols["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
            cols |= {"ids_crc32": col([zlib.crc32(x) for x in cut]), "doc_tokens": col([len(packs[p[0]]) // 4 for p in pieces]), "sequence_id": col([next_id + p[3] for p in pieces]), "offset": col([p[4] for p in pieces])}
            next_id += 1 + max(p[3] for p in pieces)
            table = pa.table(cols)
            ids.clear(), packs.clear()
            return table.to_batches(max_chunksize=20_000)

        for batch in batches:
            raw, off = utf8(batch.column(1))
            whole = raw.tobytes()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = whole[off[i] : off[i + 1]].decode("utf-8", "replace")
                packs.append(enc.encode(text) + end)
                ids.append(doc)
                tokens += len(packs[-1]) // 4
                if tokens >= pool:
                    yield from flush()
                    tokens = 0
        if packs:
            yield from flush()

    kept = "ids array<int>, " if keep_ids else ""
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, start long, length long, {kept}ids_crc32 long, doc_tokens long, sequence_id long, offset long")
