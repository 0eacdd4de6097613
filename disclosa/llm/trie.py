"""Prefix trie of conversations, rolled up to all ancestors by pointer jumping.

A node is a distinct beginning of conversations, known by a digest of its turns.
Digests are prefix sums (turn digests times powers of a base, modulo a prime), so
blocks of sorted turns are summed by themselves and one row a block carries a
conversation over to the next: a conversation of any length is spread over tasks.
Each node then points to its parent; in each round it adds what it has gathered to
the node that it points to and takes over that node's pointer, so a path of n nodes
takes log2(n) rounds.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import answered, dropped, stored

#: Digests are below a prime of 127 bits and travel as two longs.
PRIME, BASE, HALF = (1 << 127) - 1, 0x1DEECE66D1234567_9E3779B97F4A7C15, 1 << 63
#: Conversation ids of a chunk of those that end at one node.
CHUNK = 4096
KEY = ["k1", "k2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of each turn, null role and text as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 30))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))


def own_turns(turns: DataFrame) -> DataFrame:
    """Conversations as they are, for ``prefixes``."""
    return _sequence(turns.select("conv_id").distinct(), None, turns)


def left_out(conv_id: int, heads: int = 4) -> int:
    """h of a conversation, as a task computes it."""
    return zlib.crc32(str(conv_id).encode()) % heads


def rebuilt_turns(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every (all if
    fewer, none if absent) in place of its own first h; h = crc32(decimal c) % heads.

    Of each conversation only its first turns are ranked and joined; the others are left
    where they are, and the scan leaves out the first h of them.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    first = stored(turns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") < heads), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    convs = first.where("rank = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    given = convs.join(first.withColumnRenamed("conv_id", "base"), "base").where("rank <= h").select("conv_id", F.col("rank").cast("long").alias("turn"), "digest", "words")
    return _sequence(convs, given, turns)


def _sequence(convs: DataFrame, given: DataFrame | None, turns: DataFrame) -> DataFrame:
    """Rows in the order (conv_id, part, turn, digest): part 0 is the root, 1 the given
    turns, 2 the own ones."""
    rows = convs.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    for part, more in ((1, given), (2, turns)):
        if more is not None:
            rows = rows.unionByName(more.withColumn("part", F.lit(part)))
    return rows


def _halves(x: int) -> tuple[int, int]:
    return x >> 64, (x & 2 * HALF - 1) - HALF


def _one(k1: int, k2: int) -> int:
    return k1 << 64 | k2 + HALF


def _carried(blocks: list, step) -> dict:
    """{block: (conv_id, what earlier blocks hold of it)} for blocks that begin amid a
    conversation.  ``blocks``: (block, first, last, ...) ascending; ``step`` adds a
    block's part of its last conversation to what came before (None: nothing)."""
    out, open_id, held = {}, None, None
    for block, first, last, *own in blocks:
        before = held if first == open_id else None
        if before is not None:
            out[block] = (first, before)
        held = step(before if first == last else None, *own)
        open_id = last
    return out


ORDER = ("conv_id", "part", "turn", "digest")


def prefixes(sequence: DataFrame, skip=lambda conv_id: 0) -> DataFrame:
    """A row for each conversation and depth: conv_id, depth, k1, k2 (the node), p1, p2
    (its parent, null for the root), words (of the last turn), last (whether the
    conversation ends there).  Of the own turns (part 2) of a conversation the first
    ``skip(conv_id)`` are left out.

    Turns are dealt by range, so a long conversation lies in several blocks; three
    numbers a block (as many as there are partitions) go through the driver.
    """
    ranged = stored(sequence.repartitionByRange(*ORDER).withColumn("block", F.spark_partition_id()), "turns")
    counted = ranged.groupBy("block", "conv_id").agg(F.sum((F.col("part") == 2).cast("long")).alias("own"))
    ends = counted.groupBy("block").agg(F.min("conv_id"), F.max("conv_id"), F.max_by("own", "conv_id")).orderBy("block").collect()
    skipped = _carried([tuple(r) for r in ends], lambda before, own: (before or 0) + own)

    def scan(batches):
        run, own, depth, total, power, left = None, 0, 0, 0, 1, 0
        held = []  # the last row, until it is known whether its run goes on
        for b in batches:
            rows = held
            for block, conv, part, digest, words in zip(*(b.column(i).to_pylist() for i in range(5))):
                if run != (block, conv):
                    run, depth, total, power, left = (block, conv), 0, 0, 1, skip(conv)
                    own = skipped[block][1] if block in skipped and skipped[block][0] == conv else 0
                if part == 2:
                    own += 1
                    if own <= left:
                        continue
                before = total
                if part:
                    depth, power = depth + 1, power * BASE % PRIME
                    total = (total + (int.from_bytes(digest, "big") + 1) * power) % PRIME
                if rows and rows[-1][0] == block and rows[-1][1] == conv:
                    rows[-1][-1] = False
                rows.append([block, conv, depth, *_halves(total), *_halves(before), words, part == 0, True])
            held = rows[-1:]
            if rows[:-1]:
                yield _batch(names, rows[:-1])
        if held:
            yield _batch(names, held)

    names = ["block", "conv_id", "depth", "k1", "k2", "p1", "p2", "words", "root", "last"]
    kinds = "block int, conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, root boolean, last boolean"
    placed = ranged.repartition("block").sortWithinPartitions("block", *ORDER).select("block", "conv_id", "part", "digest", "words")
    local = stored(placed.mapInArrow(scan, kinds), "prefixes")
    at = F.struct("conv_id", "depth")
    ends = local.groupBy("block").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by(F.struct("depth", "k1", "k2"), at).alias("end")).orderBy("block").collect()

    def joined(before, end):
        depth, total = before or (0, 0)
        return depth + end["depth"], (total + pow(BASE, depth, PRIME) * _one(end["k1"], end["k2"])) % PRIME

    carried = _carried([(r["block"], r["first"], r["last"], r["end"]) for r in ends], joined)
    goes_on = {a["block"]: a["last"] for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]}

    def whole(batches):
        for b in batches:
            rows = []
            for block, conv, depth, k1, k2, p1, p2, words, root, last in zip(*(b.column(i).to_pylist() for i in range(10))):
                if block in carried and carried[block][0] == conv:
                    d, total = carried[block][1]
                    by = pow(BASE, d, PRIME)
                    depth += d
                    (k1, k2), (p1, p2) = (_halves((total + by * _one(x, y)) % PRIME) for x, y in ((k1, k2), (p1, p2)))
                if root:
                    p1 = p2 = None
                rows.append([conv, depth, k1, k2, p1, p2, words, last and goes_on.get(block) != conv])
            if rows:
                yield _batch(out, rows)

    out = ["conv_id", "depth", "k1", "k2", "p1", "p2", "words", "last"]
    found = stored(local.mapInArrow(whole, "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, last boolean"), "members")
    dropped(ranged), dropped(local)
    return found


def _batch(names: list[str], rows: list[list]) -> pa.RecordBatch:
    kind = {"block": pa.int32(), "root": pa.bool_(), "last": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names)


def ends(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the ids that end at a node, ascending and
    joined by commas.  Ids are dealt by range and joined in chunks; a node's chunks are
    then read in order, one at a time."""

    def chunks(batches):
        node, ids, rows = None, [], []

        def shut():
            rows.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

        for b in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in b.columns)):
                if ids and ((k1, k2) != node or len(ids) == CHUNK):
                    shut()
                node = k1, k2
                ids.append(conv)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "first", "ids"])
                    rows.clear()
        if ids:
            shut()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "first", "ids"])

    def digests(batches):
        node, sha, rows = None, None, []
        for b in batches:
            for k1, k2, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (k1, k2) == node:
                    sha.update(b",")
                else:
                    if node:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "ends_sha256"])
                rows.clear()
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], ["k1", "k2", "ends_sha256"])

    at = members.where("last").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = at.mapInArrow(chunks, "k1 long, k2 long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str], deepest: int, total: int) -> DataFrame:
    """``nodes`` (k1, k2, p1, p2 of the parent, depth and ``sums``) with each of ``sums``
    added up over the node's subtree, the node included, in log2(deepest) rounds.

    After the round of step s a node holds its descendants at a distance below 2 s and
    points to its ancestor at 2 s; nodes above that depth point nowhere and rest.
    """
    state, step = nodes.select(*KEY, "p1", "p2", "depth", *sums), 1
    while step <= deepest:
        given = state.where(F.col("depth") >= step).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        asks = state.where(F.col("depth") >= 2 * step).select(*KEY, "p1", "p2")
        far = answered(asks, state.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2")), ["p1", "p2"], total).select(*KEY, "q1", "q2")
        more = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in sums]
        following = state.join(given, KEY, "left").join(far, KEY, "left").select(*KEY, F.col("q1").alias("p1"), F.col("q2").alias("p2"), "depth", *more)
        following = stored(following, "rollup")
        if step > 1:
            dropped(state)
        state, step = following, 2 * step
    return state.select(*KEY, *sums)


def prefix_trie(members: DataFrame) -> DataFrame:
    """The nodes of the trie of ``members`` (see ``prefixes``), a row each: conv_id (the
    smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members
    but one times words of the last turn) and ends_sha256.

    Conversations of no turns are members of the root; equal conversations are members
    of the same nodes.  An empty table has no nodes.
    """
    own = (F.col("n_convs") - 1) * F.col("words")
    nodes = members.groupBy(*KEY, "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = stored(nodes, "nodes")
    deepest, total = nodes.agg(F.max("depth"), F.count("*")).first()
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")).where("k1 is not null")
    nodes = nodes.join(children, KEY, "left").join(ends(members), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": own}), "nodes")
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], deepest or 0, total)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = answered(nodes.drop("n_leaves", "saved_tokens"), parents, ["p1", "p2"], total).join(sums, KEY)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations.

    Turns are ordered by turn, null first, equal ones by their digest; repeated rows are
    turns each; null role and text are empty; rows without a conv_id are left out; other
    columns are not read; an empty table gives no rows.
    """
    turns = stored(turn_digests(conversations), "digests")
    return prefix_trie(prefixes(rebuilt_turns(turns), left_out))
