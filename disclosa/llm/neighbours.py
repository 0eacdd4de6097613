"""Nearest neighbours by inner product: a forest of random-projection trees
searched through one shared priority queue, then exact reranking in the leaves.

Trees are fitted on a bounded sample, every vector is indexed.  A component
sqrt(M^2 - |x|^2) is added to vectors (0 to queries), so that the nearest by
angle are those of largest inner product.  How many leaves a query visits is
measured: a bounded set of queries is answered by brute force, and the least
number of leaves is taken with which they reach the target recall.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, stored

#: Bounds of the fit: numbers collected for it, and levels whose nodes have thresholds of
#: their own (a forest is broadcast with trees * 2 ** DEPTH of them for each deeper level).
FIT_VALUES, FIT_ROWS, DEPTH = 4_000_000, 50_000, 10
#: Vectors of a leaf at any size of the table, vectors of the subtree that a task holds,
#: and queries that meet it together.
LEAF, CELL, QUERIES = 512, 8192, 8192
#: Queries answered by brute force to choose the number of leaves visited, and leaves after
#: which that search gives up (then all leaves are visited).
MEASURED, MOST_VISITS = 128, 65_536


class Forest(NamedTuple):
    """``direction``: (dim + 1, trees * depth), one for each level of each tree;
    ``threshold``: (trees, 2 ** fitted), nodes in heap order from 1; ``below``:
    (trees, 2 ** fitted, depth - fitted), those of the levels below a fitted leaf,
    so a tree may be deeper than its sample can tell."""

    trees: int
    depth: int
    fitted: int
    direction: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    radius: float

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(n, trees, depth)"""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.radius**2 - (x**2).sum(1)))
        return (x @ self.direction[:-1] + more[:, None] * self.direction[-1]).reshape(len(x), self.trees, self.depth)

    def at(self, tree, node, level: int):
        """The threshold of a node (both may be arrays) of a level."""
        if level < self.fitted:
            return self.threshold[tree, node]
        return self.below[tree, (node >> (level - self.fitted)) - (1 << self.fitted), level - self.fitted]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(n, trees)"""
        p, node = self.project(x), np.ones((len(x), self.trees), np.int64)
        tree = np.arange(self.trees)
        for d in range(self.depth):
            node = 2 * node + (p[:, :, d] > self.at(tree, node, d))
        return node - (1 << self.depth)

    def search(self, projected: np.ndarray) -> Iterator[tuple[int, int]]:
        """All (tree, leaf) for a query, over all trees through one priority queue:
        by the farthest threshold on the other side of which a leaf lies."""
        heap, depth = [(0.0, t, 1, 0) for t in range(self.trees)], self.depth
        p, push = projected.tolist(), heapq.heappush
        while heap:
            worst, t, node, d = heapq.heappop(heap)
            while d < depth:
                gap = p[t][d] - self.at(t, node, d)
                d, node = d + 1, 2 * node + (gap > 0)
                push(heap, (max(worst, abs(gap)), t, node ^ 1, d))
            yield t, node - (1 << depth)


def fit(sample: np.ndarray, n: int, radius: float, trees: int, leaf: int, seed: int) -> Forest:
    """Trees of random directions, cut at the medians of the sample."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    fitted = min(depth, DEPTH)
    direction = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, trees * depth))
    direction /= np.maximum(np.linalg.norm(direction, axis=0), 1e-300)
    forest = Forest(trees, depth, fitted, direction, np.zeros((trees, 1 << fitted)), np.zeros((trees, 1 << fitted, depth - fitted)), radius)
    if not depth:
        return forest
    p = forest.project(sample)
    middle = lambda own, other: float(np.median(own)) if len(own) else other
    for t in range(trees):
        node, overall = np.ones(len(sample), np.int64), np.median(p[:, t], axis=0)
        for d in range(fitted):
            order = np.argsort(node, kind="stable")
            cut = np.searchsorted(node[order], np.arange(1 << d, (2 << d) + 1))
            for k in range(1 << d):
                forest.threshold[t, (1 << d) + k] = middle(p[order[cut[k] : cut[k + 1]], t, d], overall[d])
            node = 2 * node + (p[:, t, d] > forest.threshold[t, node])
        order = np.argsort(node, kind="stable")
        cut = np.searchsorted(node[order], np.arange(1 << fitted, (2 << fitted) + 1))
        for k in range(1 << fitted) if depth > fitted else ():
            own = p[order[cut[k] : cut[k + 1]], t, fitted:]
            forest.below[t, k] = np.median(own, axis=0) if len(own) else overall[fitted:]
    return forest


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Doubles, shorter vectors filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top(scores: np.ndarray, vectors: np.ndarray, query: np.ndarray, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, exact scores) of the k best, ties to the smaller id.

    ``scores`` comes from a matrix product; what may tie within its rounding is
    computed again in one fixed order of summation."""
    n = len(scores)
    at = np.arange(n)
    if n > k:
        least = np.partition(scores, n - k)[n - k]
        at = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    exact = (vectors[at] * query).sum(1)
    order = np.lexsort((first_id[at], -exact))[:k]
    return at[order], exact[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    e = F.col("vec")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & e.isNotNull())
    return kept.where(finite & F.exists(e, lambda x: x != 0))


class Cells:
    """Subtrees of about CELL vectors, keyed by tree and path; those of more vectors
    or queries are split into ``v`` by ``q`` blocks that all meet."""

    def __init__(self, forest: Forest, n: int):
        self.forest = forest
        self.drop = forest.depth - min(forest.depth, max(0, math.ceil(math.log2(max(1, n / CELL)))))
        self.many: dict[int, int] = {}
        self.asked: dict[int, int] = {}

    def key(self, tree, leaf):
        return (np.asarray(leaf, np.int64) >> self.drop) * self.forest.trees + tree

    def oversized(self, keys: DataFrame, most: int) -> dict[int, int]:
        """Blocks of the cells of more than ``most`` rows (cell, n): at most one row
        for each ``most`` rows."""
        n = keys.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most)
        return {r["cell"]: -(-r["n"] // most) for r in n.collect()}


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    at, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])


def _best(scores: np.ndarray, v: np.ndarray, q: np.ndarray, first: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, exact scores) of the k best of each row, ties to the smaller id; minus
    infinity is no candidate."""
    n, more = scores.shape[1], k + 8
    if n <= more:
        return [_finite(*top(s, v, x, first, k), s) for s, x in zip(scores, q)]
    at = np.argpartition(scores, n - more, axis=1)[:, n - more :]
    rough = np.take_along_axis(scores, at, 1)
    exact = (v[at] * q[:, None]).sum(2)
    out = []
    for i, (own, r, e) in enumerate(zip(at, rough, exact)):
        r_sorted = np.sort(r)
        least = r_sorted[more - k]
        if r_sorted[0] >= least - 1e-9 * max(1.0, abs(least)):  # ties may go on
            out.append(_finite(*top(scores[i], v, q[i], first, k), scores[i]))
            continue
        order = np.lexsort((first[own], -e))[:k]
        out.append(_finite(own[order], e[order], scores[i]))
    return out


def _finite(at: np.ndarray, exact: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = scores[at] > -np.inf
    return at[ok], exact[ok]


_FOUND = "query_id long, vec_ids array<long>, scores array<double>"


def _reranked(dim: int, k: int, forest: Forest | None):
    """Exact scores of a block's vectors (leaf, ids, vec) and queries (query_id, vec,
    leaves): of the leaves that a query visits, or (without a forest) of all."""

    def rerank(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = []
        if len(vs) and len(qs):
            leaf = np.asarray(vs["leaf"], np.int64)
            order = np.argsort(leaf, kind="stable")
            v, ids, leaf = matrix(vs["vec"], dim)[order], vs["ids"].take(pa.array(order)).to_pylist(), leaf[order]
            q, query, visited = matrix(qs["vec"], dim), np.asarray(qs["query_id"], np.int64), qs["leaves"].combine_chunks()
            first, names = np.array([x[0] for x in ids]), np.unique(leaf)
            cut = np.append(np.searchsorted(leaf, names), len(leaf))
            several = any(len(x) > 1 for x in ids)
            by_id = np.argsort(first, kind="stable")
            repeated = [x for x in np.split(by_id, np.flatnonzero(np.diff(first[by_id])) + 1) if len(x) > 1] if len(set(first.tolist())) < len(first) else []
            for i in range(0, len(q), 256):
                part = visited.slice(i, 256)
                of = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths(), np.int64))
                own = np.asarray(part.flatten(), np.int64)
                scores = np.full((len(part), len(v)), -np.inf)
                for name, a, b in zip(names, cut, cut[1:]):
                    asks = of[own == name] if forest else np.arange(len(part))
                    if len(asks):
                        scores[asks, a:b] = q[i + asks] @ v[a:b].T
                for x in repeated:  # of an id's several vectors the best one for each query
                    own = scores[:, x]
                    top = np.arange(len(own)), own.argmax(1)
                    scores[:, x] = -np.inf
                    scores[top[0], x[top[1]]] = own[top]
                for r, (at, score) in enumerate(_best(scores, v, q[i : i + 256], first, k + 1)):
                    me = query[i + r]
                    if several:
                        rows = sorted((-e, y) for j, e in zip(at.tolist(), score.tolist()) for y in ids[j] if y != me)[:k]
                        out.append((me, [y for _, y in rows], [-e for e, _ in rows]))
                    else:
                        ok = first[at] != me
                        out.append((me, first[at][ok][:k], score[ok][:k]))
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_ids": pa.array(b, pa.list_(pa.int64())), "scores": pa.array(c, pa.list_(pa.float64()))})

    return rerank


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the blocks' rows, each neighbour once."""

    def run(batches):
        held = None
        for b in batches:
            of = np.repeat(np.asarray(b.column(0), np.int64), np.asarray(b.column(1).value_lengths(), np.int64))
            rows = of, np.asarray(b.column(1).flatten(), np.int64), np.asarray(b.column(2).flatten(), np.float64)
            rows = rows if held is None else tuple(map(np.concatenate, zip(held, rows)))
            if not len(rows[0]):
                continue
            whole = rows[0] != rows[0][-1]  # the last query may go on in the next batch
            held = tuple(x[~whole] for x in rows)
            yield from ranks(*(x[whole] for x in rows))
        if held is not None:
            yield from ranks(*held)

    def ranks(query, vec, score):
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.ones(len(query), bool)  # the best of each neighbour, which blocks and an id's several vectors repeat
        new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        query, vec, score = query[new], vec[new], score[new]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first + 1
        ok = rank <= k
        yield pa.RecordBatch.from_arrays([pa.array(query[ok]), pa.array(rank[ok].astype(np.int32)), pa.array(vec[ok]), pa.array(score[ok])], ["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 3, leaf: int = LEAF, target: float = 0.95, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other vectors found for each whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (inner product in doubles of
    the vectors as given); best first, ties to the smaller id.  Vectors that are
    null, zero or hold null or non-finite components, and rows without an id,
    take no part; shorter vectors count as filled up with 0; equal rows count
    once, equal vectors of different ids each; an id with several vectors is one query and
    one neighbour, with the best of their products; with fewer candidates than k all
    are returned; an empty table gives no rows.

    Equal vectors are searched as one with its k + 1 smallest ids, so a group
    of copies of any size is one entry.  Leaves have ``leaf`` vectors at any size of
    the table; subtrees of about CELL vectors meet their queries in one task, and
    larger ones in blocks.  A query whose leaves hold too few candidates is answered
    by all blocks.
    """
    spark = vectors.sparkSession
    same = F.xxhash64("vec").alias("h"), F.hash("vec").alias("g")  # 96 bits tell vectors apart
    rows = usable(vectors, id_col, vec_col).select("id", "vec", *same)
    w = Window.partitionBy("h", "g").orderBy("id")
    alike = rows.select("id", "h", "g").distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    alike = alike.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    once = lambda df: df.dropDuplicates(["id", "h", "g"])
    items = stored(once(rows).join(alike.hint("merge"), ["id", "h", "g"]).select("vec", "ids"), "ann-items")
    queries = stored(once(rows.where(F.pmod("id", F.lit(every)) == 0)).select("id", "vec"), "ann-queries")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    about = items.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.size("vec")).alias("dim"), F.max(norm).alias("radius")).first()
    n, dim, radius = about["n"], about["dim"] or 1, about["radius"] or 1.0
    by_hash = F.xxhash64(F.col("ids")[0], F.lit(seed))
    sample = items.orderBy(by_hash, F.col("ids")[0]).limit(max(1, min(FIT_ROWS, FIT_VALUES // dim))).select("vec").toArrow()
    forest = fit(matrix(sample["vec"], dim), n, radius, trees, leaf, seed) if n else fit(np.zeros((1, dim)), 1, 1.0, trees, 1, seed)
    visits = _visits(items, queries, forest, dim, k, target)
    cells = Cells(forest, n)
    sent = spark.sparkContext.broadcast(forest)
    vec = rows.schema["vec"].dataType.simpleString()

    def probe(batches):
        for b in batches:
            p = sent.value.project(matrix(b.column(1), dim), query=True) if len(b) else ()
            found = [np.array([x for x, _ in zip(sent.value.search(x), range(visits))], np.int64) for x in p]
            at, key, leaves = [], [], []
            for i, x in enumerate(found):
                own = cells.key(x[:, 0], x[:, 1])
                for c in np.unique(own):
                    at.append(i), key.append(c), leaves.append(x[own == c, 1])
            for i in range(0, len(at), 2000):
                part = pa.array(at[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 2000], pa.int64()), b.column(0).take(part), b.column(1).take(part), pa.array(leaves[i : i + 2000], pa.list_(pa.int64()))], ["cell", "query_id", "vec", "leaves"])

    def count(batches):
        for b in batches:
            leaves = sent.value.leaves(matrix(b.column(0), dim)) if len(b) else np.zeros((0, trees), np.int64)
            yield _counted(cells.key(np.arange(trees), leaves).ravel())

    probes = stored(queries.mapInArrow(probe, f"cell long, query_id long, vec {vec}, leaves array<long>"), "ann-probes")
    cells.many = cells.oversized(items.select("vec").mapInArrow(count, "cell long, n long"), 2 * CELL)
    cells.asked = cells.oversized(probes.select("cell", F.lit(1).alias("n")), QUERIES)
    blocks = spark.sparkContext.broadcast((cells.many, cells.asked))
    parts = lambda own, name: np.array([blocks.value[name].get(c, 1) for c in own.tolist()], np.int64)
    copies = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    def post(batches):
        """A vector goes into one block of its cell in each tree, once for each of the
        cell's blocks of queries."""
        for b in batches:
            leaves = sent.value.leaves(matrix(b.column(0), dim)) if len(b) else np.zeros((0, trees), np.int64)
            for t in range(trees):
                cell = cells.key(t, leaves[:, t])
                at, q = copies(parts(cell, 1))
                first = np.array([x[0].as_py() for x in b.column(1)], np.int64)
                v = np.abs(first) % parts(cell, 0)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(v[at]), pa.array(q), pa.array(leaves[at, t]), b.column(1).take(take), b.column(0).take(take)], ["cell", "v", "q", "leaf", "ids", "vec"])

    def ask(batches):
        for b in batches:
            cell, query = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
            at, v = copies(parts(cell, 0))
            q = np.abs(query) // max(1, every) % parts(cell, 1)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(v), pa.array(q[at]), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take)], ["cell", "v", "q", "query_id", "vec", "leaves"])

    key = ["cell", "v", "q"]
    left = items.select("vec", "ids").mapInArrow(post, f"cell long, v long, q long, leaf long, ids array<long>, vec {vec}")
    right = probes.mapInArrow(ask, f"cell long, v long, q long, query_id long, vec {vec}, leaves array<long>")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_reranked(dim, k, forest), _FOUND)
    found = stored(_ranked(met, k), "ann-found")
    wanted = min(k, (about["ids"] or 0) - 1)
    few = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(few.where(F.col("n") >= wanted).hint("merge"), queries["id"] == few["query_id"], "left_anti")
    dropped(probes)
    if wanted < 1 or short.isEmpty():
        dropped(items), dropped(queries)
        return found
    short = stored(short.select("id", "vec"), "ann-short")
    more = _ranked(_everywhere(items, short, n, dim, k), k)
    return found.join(short.select(F.col("id").alias("query_id")).hint("merge"), "query_id", "left_anti").unionByName(more)


def _everywhere(items: DataFrame, queries: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """Queries (id, vec) against all items, in blocks of CELL by QUERIES."""
    v = max(1, -(-n // CELL))
    q = max(1, -(-queries.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(v)).cast("int").alias("v"), each(q).alias("q"), F.lit(0).cast("long").alias("leaf"), "ids", "vec")
    right = queries.select(each(v).alias("v"), F.pmod(F.xxhash64("id"), F.lit(q)).cast("int").alias("q"), F.col("id").alias("query_id"), "vec", F.array(F.lit(0).cast("long")).alias("leaves"))
    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_reranked(dim, k, None), _FOUND)


def _visits(items: DataFrame, queries: DataFrame, forest: Forest, dim: int, k: int, target: float) -> int:
    """The least number of leaves with which MEASURED queries find ``target`` of
    their true neighbours; these are found by brute force over all items."""
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED).toArrow()
    if not len(picked):
        return 1
    q = matrix(picked["vec"], dim)

    def brute(batches):
        for b in batches:
            if not len(b):
                continue
            v, ids = matrix(b.column(0), dim), b.column(1).to_pylist()
            first = np.array([x[0] for x in ids])
            found = _best(q @ v.T, v, q, first, k + 1)
            at = np.concatenate([x for x, _ in found])
            own = np.repeat(np.arange(len(q)), [len(x) for x, _ in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([e for _, e in found])), pa.array(first[at]), b.column(0).take(pa.array(at))], ["q", "score", "first", "vec"])

    vec = items.schema["vec"].dataType.simpleString()
    w = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    true = items.select("vec", "ids").mapInArrow(brute, f"q int, score double, first long, vec {vec}").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).toPandas()  # MEASURED * (k + 1) rows
    leaves = forest.leaves(matrix(pa.array(true["vec"].tolist(), pa.list_(pa.float64())), dim))
    everywhere, ranks = forest.trees << forest.depth, []
    mine = dict(zip(range(len(picked)), picked["id"].to_pylist()))
    projected = forest.project(q, query=True)
    for j, rows in true.groupby("q"):
        others = rows[rows["first"] != mine[j]].index[:k]
        open_ = {(t, int(x)): [] for i in others for t, x in enumerate(leaves[i])}
        for i in others:
            for t, x in enumerate(leaves[i]):
                open_[t, int(x)].append(i)
        left = set(others)
        for r, x in zip(range(1, min(everywhere, MOST_VISITS) + 1), forest.search(projected[j])):
            for i in open_.get(x, ()):
                if i in left:
                    left.discard(i)
                    ranks.append(r)
            if not left:
                break
        ranks += [everywhere] * len(left)
    return int(np.sort(ranks)[max(0, math.ceil(target * len(ranks)) - 1)]) if ranks else 1
