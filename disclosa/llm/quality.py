"""Quality classifier: naive Bayes support vectors.

Indicators of word and shape n-grams are scaled by the log ratio of their
smoothed counts in the two classes; a linear hinge-loss model over them is
fitted by dual coordinate descent; its margins become probabilities by a
logistic curve fitted on margins of held-out folds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Words, blocks, fold, id_text, mix, rows_where, utf8
from .labels import collected, fit_sample, released, remainder

#: Hashed n-grams; bounds of the fit: documents of each class, and their bytes together.
DIM, PER_CLASS, FIT_BYTES = 1 << 17, 2000, 20_000_000
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, their document): words, and runs of one to three shapes.

    A shape is a word's case, length class, marks at its end, and whether it
    repeats the word before.
    """
    w = Words(raw, offsets, SPACE)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.ptr))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    low = fold(raw)
    capital = total(low != raw)
    letter = total(_LETTER[raw] & (raw & 0xC0 != 0x80))
    n, upper, letters = w.ends - w.starts, capital[w.ends] - capital[w.starts], letter[w.ends] - letter[w.starts]
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where((upper == letters) & (letters > 1), 2, np.where(upper == 1, 3, 4))))
    length = np.digitize(n, [2, 4, 8, 16, 32])
    tail = np.zeros(len(n), np.int64)
    marked = np.ones(len(n), bool)
    for k in range(1, 4):
        at = w.ends - k
        marked &= at >= w.starts
        marked &= _MARK[raw[np.maximum(at, 0)]]
        tail = np.where(marked, tail * 256 + raw[np.maximum(at, 0)], tail)
    same = np.zeros(len(n), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = mix(((case * 8 + length) * 2 + same).astype(np.uint64) + (tail.astype(np.uint64) << U64(8)) + U64(1))
    parts, docs = [mix(w.hashes + U64(11))], [doc]
    for k in (1, 2, 3):
        grams, ptr = w.grams(k, shape)
        parts.append(mix(grams + U64(k)))
        docs.append(np.repeat(np.arange(len(offsets) - 1), np.diff(ptr)))
    return (np.concatenate(parts) & U64(DIM - 1)).astype(np.int64), np.concatenate(docs)


def indicators(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed n-grams of each document, ascending."""
    f, doc = features(raw, offsets)
    flag, out = np.zeros(DIM, bool), []
    order = np.argsort(doc, kind="stable")
    f, cut = f[order], np.searchsorted(doc[order], np.arange(len(offsets)))
    for a, b in zip(cut[:-1], cut[1:]):
        flag[f[a:b]] = True
        out.append(found := np.flatnonzero(flag))
        flag[found] = False
    return out


class Model(NamedTuple):
    """``weight`` holds the fitted weights times the ratios, ``ratio`` those alone."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt((self.ratio[found] ** 2).sum()) or 1.0
        return float(self.weight[found].sum() / norm + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(found) + self.shift))))


def train(rows: list[np.ndarray], y: np.ndarray, weights: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> Model:
    """Log-count ratios, then dual coordinate descent for
    ``|w|^2 / 2 + sum cost * weight * max(0, 1 - y (w.x + b))``; the intercept is
    a constant feature."""
    counts = np.ones((2, DIM))
    for r, k in zip(rows, y):
        counts[k, r] += 1
    few = counts.sum(0) < 2 + 3  # of one or two documents: no evidence
    share = counts / (counts.sum(1, keepdims=True))
    ratio = np.log(share[1] / share[0])
    ratio[few] = 0
    xs = [(r := row[ratio[row] != 0], ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) or 1.0)) for row in rows]
    w, b, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    sign, most = np.where(y == 1, 1.0, -1.0), cost * weights
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = xs[i]
            square = x @ x + 1.0
            gradient = sign[i] * (w[at] @ x + b) - 1
            new = min(max(alpha[i] - gradient / square, 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                b += step
                alpha[i] = new
    return Model(w * ratio, ratio, b, 1.0, 0.0)


def calibrate(margin: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps, with soft targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g, h = weights * (p - target), weights * p * (1 - p)
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * margin).sum() + 1e-3 * a, g.sum()])
        a, c = a - step[0], c - step[1]
    return max(float(a), 1e-3), float(c)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, label: str = "quality", per_class: int = PER_CLASS, class_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class whose
    crc32(doc_id) mod ``folds`` is not ``held_out``, of any length, until they have
    ``class_bytes`` together; their hashed n-grams (at most DIM for each) are
    collected.  With no documents of a class the share of labels is the score of
    every text.  Null labels and ids, contradicting labels, repeated rows and empty
    tables: as ``labels.fit_sample`` says; a null or empty text has no n-grams."""
    sample, counts = fit_sample(docs, labels, label, remainder(folds) != held_out, per_class, id_col, text_col)

    def extract(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off):
                rows = indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "y", "n_bytes", "f"])

    got = collected(sample.select("doc_id", "text", "y").mapInArrow(extract, "doc_id long, y int, n_bytes long, f array<int>"), class_bytes)
    y, rows = np.asarray(got["y"]), [np.asarray(x.values) for x in got["f"]]
    if not ((y == 0).any() and (y == 1).any()):
        known = sum(counts.values())
        p = min(max(counts.get(1, 0) / known if known else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 1.0, float(np.log(p / (1 - p))))
    share = np.array([counts[k] / (y == k).sum() for k in (0, 1)])[y]
    weights = share / share.mean()
    part, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        inner = np.flatnonzero(part != k)
        if (y[inner] == 0).any() and (y[inner] == 1).any():
            m = train([rows[i] for i in inner], y[inner], weights[inner])
            margin[part == k] = [m.margin(rows[i]) for i in np.flatnonzero(part == k)]
    slope, shift = calibrate(margin, y, weights)
    model = train(rows, y, weights)._replace(slope=slope, shift=shift)
    del got, rows
    released()
    return model


def score(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every whole text.

    A null or empty text has no n-grams and gets the curve's value at the
    intercept; repeated rows repeat; a null doc_id counts as '' for held_out; other
    columns are left out; an empty table gives no rows.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIM numbers

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off):
                found = indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([sent.value.score(f) for f in found], pa.float64())], ["doc_id", "held_out", "score"])

    rows = id_text(docs, id_col, text_col).withColumn("held_out", remainder(folds) == held_out)
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects; all columns stay.

    Rows are judged in place (no join): repeated rows and rows without an id are
    judged each, a null or empty text by the curve's value at the intercept, an empty
    table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def good(raw, offsets):
        return np.array([sent.value.score(f) >= 0.5 for f in indicators(raw, offsets)], bool)

    return rows_where(docs, text_col, good)
