"""Encoding against tiktoken and tokenizers; packing invariants."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from disclosa.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        return bpe.loaded(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def texts():
    random.seed(5)
    parts = ["a", " ", "\n", "  ", "the", "é", "ß", "123", "'s", "!!", "\t", "😀", "中文", " ", "\x1c", "x" * 300, "ab" * 50, "<|endoftext|>"]
    yield from ("", " ", "\n", "a ", " a", "a  b", "word " * 2000, "z" * 5000, " " * 500)
    for _ in range(400):
        yield "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
    for _ in range(200):
        yield "".join(chr(random.choice([random.randint(32, 126), random.randint(0, 0x2FFF)])) for _ in range(40))


def test_equals_tiktoken_and_decodes(enc, tik):
    for x in texts():
        got = enc.encode(x)
        assert ids(got) == tik.encode_ordinary(x), repr(x)
        assert bpe.decode(enc.bpe.token, got) == x.encode()


def test_packing_ids_equal_tokenizers():
    tok = Tokenizer.from_file(JSON)
    with open(JSON, "rb") as f:
        fast = packing._tokenizer(f.read(), P.PATTERN)
    for x in texts():
        assert ids(fast.encode(x)) == tok.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u3000"])
def test_packing_of_long_white_space(space):
    tok = Tokenizer.from_file(JSON)
    with open(JSON, "rb") as f:
        fast = packing._tokenizer(f.read(), P.PATTERN)
    many = space * 1_000_000
    for x in (many * 3, f"{many}a", f"word{many}", f"a {many}b c{many}'s", f"{many}<|endoftext|>{many}x", f"x<|endoftext|>{many}"):
        assert ids(fast.encode(x)) == tok.encode(x, add_special_tokens=False).ids


def test_every_character_is_split_as_by_tiktoken(enc, tik):
    every = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x110000)) if i < 0x3400 or i in enc.stand_ins or i % 7 == 0]
    for around in ("{0}a", "{0}1", "{0}\u0301", "{0} {0}", "{0}'s", "b{0}", "'{0}!"):
        text = "\n".join(around.format(c) for c in every)
        assert ids(enc.encode(text)) == tik.encode_ordinary(text)
        one_by_one = tik.encode_ordinary_batch([around.format(c) for c in every[::5]])
        assert [ids(enc.encode(around.format(c))) for c in every[::5]] == one_by_one


def test_long_pieces_are_not_remembered(enc, tik):
    random.seed(8)
    text = "".join(random.choice("abcdefgh") for _ in range(300_000))
    before = len(enc.bpe.trie[1]), len(enc.spaced), len(enc.pieces), len(enc.bare)
    for x in (text, f"{text} {text[:5000]}!"):
        got = enc.encode(x)
        assert ids(got) == tik.encode_ordinary(x) and bpe.decode(enc.bpe.token, got) == x.encode()
    assert sum((len(enc.bpe.trie[1]), len(enc.spaced), len(enc.pieces), len(enc.bare))) <= sum(before) + 4


def test_memos_are_bounded_in_bytes():
    memo = bpe.Memo(lambda k: k.encode() * 3, 10_000)
    for i in range(5000):
        assert memo[str(i) * 10] == (str(i) * 10).encode() * 3
        assert sum(2 * len(k) + len(v) + 200 for k, v in memo.items()) <= 10_500
    assert memo["7" * 10] == ("7" * 10).encode() * 3 and memo["x" * 1000] and "x" * 1000 not in memo


def test_appends_prefixes_and_edits_are_exact(enc, tik):
    random.seed(6)
    alphabet = b"abcdefgh the and"
    for _ in range(150):
        data = bytes(random.choice(alphabet) for _ in range(random.randint(1, 300)))
        cut = random.randint(0, len(data))
        t = bpe.PrefixTable(enc.bpe, data[:cut])
        t.append(data[cut:])
        assert t.ids() == tik._core_bpe.encode_single_piece(data)
        assert t.ids(cut) == (tik._core_bpe.encode_single_piece(data[:cut]) if cut else [])
        a = random.randint(0, len(data))
        b = random.randint(a, len(data))
        new = bytes(random.choice(alphabet) for _ in range(random.randint(0, 9)))
        t.replace(a, b, new)
        assert t.data == data[:a] + new + data[b:] and t.last == bpe.PrefixTable(enc.bpe, t.data).last


def test_an_edit_recomputes_near_it_only(enc):
    t = bpe.PrefixTable(enc.bpe, b"the quick brown fox " * 500)
    assert t.replace(100, 101, b"Q") < 1000


ROWS = [(1, "ab c"), (1, "ab c"), (2, None), (3, ""), (None, "x"), (4, "y " * 5000)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "text", 1.5) for r in rows], "doc_id long, text string, `start` string, length double")


def test_encode_documents(spark, tik):
    got = bpe.encode_documents(table(spark), RANKS, P.PATTERN).collect()
    assert len(got) == len(ROWS)
    for r, (doc, text) in zip(got, ROWS):
        want = tik.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (doc, len(want), want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(table(spark, []), RANKS, P.PATTERN).count() == 0


def check_pieces(got, docs, size=1024):
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and (at == size or at & (at - 1) == 0)
    for doc, want in docs.items():
        rows = sorted(by_doc[doc], key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == want and {r.doc_tokens for r in rows} == {len(want)}


def test_pack_documents(spark, tik):
    docs = [(i, "word " * (37 * i % 900)) for i in range(40)] + [(100, None), (101, "")]
    got = packing.pack_documents(table(spark, docs), JSON, P.PATTERN, pool=5000).collect()
    check_pieces(got, {d: [*tik.encode_ordinary(t or ""), 0] for d, t in docs})
    assert packing.pack_documents(table(spark, []), JSON, P.PATTERN).count() == 0
    twice = packing.pack_documents(table(spark, [(1, "a"), (1, "a"), (None, "b")]), JSON, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 2), (1, 2)]


def test_added_tokens_are_one_id(spark):
    tok = Tokenizer.from_file(JSON)
    docs = list(enumerate(["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\ny", "<|endoftext", *texts()]))
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in docs}
    assert want[0] == [64, 220, 50256, 275, 0]
    check_pieces(packing.pack_documents(table(spark, docs), JSON, P.PATTERN).collect(), want)


def test_sequences_are_balanced_in_cost():
    random.seed(7)
    lengths = [random.randint(1, 900) for _ in range(2000)]
    pieces = packing.assign(lengths, 1024)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert sum(p[2] for p in pieces) == sum(lengths)
    full = sorted(cost.values())[5:-5]
    assert max(full) / min(full) < 2


def plain_assignment(lengths, size):
    """The rule word by word: sequences to fill exactly; longest first; always the
    cheapest sequence with room, the lower on ties."""
    total = sum(lengths)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
    used, cost, out, whole, rest = [0] * len(room), [0.0] * len(room), [], 0, []
    for d, n in enumerate(lengths):
        k = n // size
        out += [(d, i * size, size, whole + i, 0) for i in range(k)]
        for i in range(k):
            used[whole + i] = size
        whole += k
        if n % size:
            rest.append((n % size, d, k * size))
    for n, d, at in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            free = [s for s in range(whole, len(room)) if used[s] < room[s]]
            s = min(free, key=lambda s: (cost[s], s))
            take = min(n, room[s] - used[s])
            out.append((d, at, take, s, used[s]))
            used[s], cost[s], at, n = used[s] + take, cost[s] + take + take * take / 1024, at + take, n - take
    return out


def test_assignment_equals_the_plain_rule():
    r = random.Random(9)
    for size in (8, 64, 1024):
        for _ in range(30):
            lengths = [r.randint(1, size * 3 if r.random() < 0.2 else size) for _ in range(r.randint(0, 40))]
            assert packing.assign(lengths, size) == plain_assignment(lengths, size)


def test_a_very_long_text_is_packed_whole(spark, tik):
    text = "word and word " * 120_000
    got = packing.pack_documents(table(spark, [(1, text), (2, "x")]), JSON, P.PATTERN).collect()
    check_pieces(got, {1: [*tik.encode_ordinary(text), 0], 2: [*tik.encode_ordinary("x"), 0]})
