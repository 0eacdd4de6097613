"""The prefix trie against a plain one, over rebuilt and plain conversations."""

import hashlib
import random
import re
import zlib

import pytest

from disclosa.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)


def ordered(rows):
    """{conv_id: its turns}, null turns first and equal ones by digest."""
    out = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:15]
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def plain(convs):
    members, last = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    nodes = {}
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        at = sorted(c for c in m if len(convs[c]) == len(k))
        kids = sum(1 for x in members if len(x) == len(k) + 1 and x[: len(k)] == k)
        nodes[k] = [min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids, (len(m) - 1) * words, hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()]
    found = set()
    for k, (conv, depth, parent, n, kids, own, sha) in nodes.items():
        below = [v for x, v in nodes.items() if x[: len(k)] == k]
        found.add((conv, depth, parent, n, kids, sum(v[4] == 0 for v in below), sum(v[5] for v in below), sha))
    return found


def got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def some_rows(seed, ids, words=("a", "b b", "", " c\td\n", None)):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(words)) for c in ids for t in range(r.randint(1, 6))]
    rows += [(5, None, "user", "a"), (5, 2, "user", "a"), (5, 2, "user", "a"), (None, 0, "user", "lost")]
    r.shuffle(rows)
    return rows


@pytest.fixture
def in_blocks(spark):
    """Many small blocks: conversations lie across their borders."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rebuilt_trie(spark):
    rows = some_rows(1, [*range(45), 60, 61, 99, -3, -25, 1000])
    assert got(trie.rebuilt_trie(table(spark, rows))) == plain(rebuilt(rows))


def test_long_conversations_lie_in_several_blocks(spark, in_blocks):
    r = random.Random(2)
    rows = some_rows(2, range(20, 50)) + [(c, t, "user", r.choice("ab")) for c in (0, 7, 21, 41) for t in range(150)]
    rows += [(c, t, "user", "same") for c in (62, 63, 64, 65) for t in range(70)]
    assert got(trie.rebuilt_trie(table(spark, rows))) == plain(rebuilt(rows))


def test_plain_conversations_and_no_rows(spark):
    rows = some_rows(3, range(20))
    turns = trie.turn_digests(table(spark, rows))
    assert got(trie.prefix_trie(trie.prefixes(trie.own_turns(turns)))) == plain(ordered(rows))
    assert got(trie.rebuilt_trie(table(spark, []))) == set()


def test_many_equal_conversations_and_hot_parents(spark, in_blocks):
    """A node that very many point to is answered by broadcast, ids of its members come in chunks."""
    rows = [(c, t, "user", f"t{t}" if t < 3 else str(c)) for c in range(0, 14_000, 20) for t in range(4 if c % 3 else 3)]
    old, trie.CHUNK = trie.CHUNK, 7
    try:
        assert got(trie.rebuilt_trie(table(spark, rows))) == plain(rebuilt(rows))
    finally:
        trie.CHUNK = old
