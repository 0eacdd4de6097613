"""Toxicity by multiple-instance learning.

Only documents have labels.  A sentence's probability is a logistic model of
its words; a document's is the noisy-or of its sentences', and the model is
fitted through that, so it also tells which sentences offend.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, Words, blocks, fold, id_text, mix, rows_where, utf8
from .labels import collected, fit_sample, released, remainder

#: Hashed features; bounds of the fit: documents of each class, and their bytes together.
DIM, PER_CLASS, FIT_BYTES = 1 << 18, 1000, 20_000_000
#: Beginnings of words, in bytes, that count beside whole words.
HEADS = (4, 5, 6)
_END = np.zeros(256, bool)
_END[list(b".!?\n\r")] = True


class Sentences(NamedTuple):
    """``features``: (words, 1 + len(HEADS)); ``of_word``: sentence of each word;
    ``ptr``: document d owns sentences ptr[d]:ptr[d+1]; spans in bytes."""

    features: np.ndarray
    of_word: np.ndarray
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(raw: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Sentences end at . ! ? or a line's end and hold at least one word."""
    low = fold(raw)
    w = Words(low, offsets, PUNCT)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.ptr))
    ends = np.concatenate([[0], np.cumsum(_END[raw])])[w.starts]
    new = np.ones(len(w.starts), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    of_word = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1 if len(first) else first
    heads = [mix(w.hashes + U64(1))] + [mix(w.span_hash(w.starts, np.minimum(w.starts + k, w.ends)) + U64(k)) for k in HEADS]
    feats = (np.stack(heads, 1) & U64(DIM - 1)).astype(np.int32)
    ptr = np.searchsorted(doc[first], np.arange(len(offsets)))
    return Sentences(feats, of_word, ptr, w.starts[first], w.ends[last])


class Model(NamedTuple):
    weight: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        return np.bincount(s.of_word, self.weight[s.features].sum(1), len(s.start)) + self.bias


def noisy_or(logits: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) for each document; 0 without sentences."""
    total = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, logits))])
    return -np.expm1(-(total[ptr[1:]] - total[ptr[:-1]]))


def train(features: np.ndarray, of_feature: np.ndarray, ptr: np.ndarray, y: np.ndarray, weights: np.ndarray, base: float, epochs: int = 80, rate: float = 0.15, ridge: float = 2e-5) -> Model:
    """Adam on the documents' noisy-or likelihood; ``base`` is the intercept at first."""
    n, s = DIM, int(ptr[-1])
    w, b = np.zeros(n), base
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    owner = np.repeat(np.arange(len(y)), np.diff(ptr))
    scale = weights / weights.sum()
    for k in range(1, epochs + 1):
        z = np.bincount(of_feature, w[features], s) + b
        soft = np.logaddexp(0, z)
        total = np.concatenate([[0.0], np.cumsum(soft)])
        total = np.maximum(total[ptr[1:]] - total[ptr[:-1]], 1e-12)
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0) * scale
        dz = slope[owner] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.bincount(features, dz[of_feature], n) + ridge * w
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(w.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, label: str = "toxic", per_class: int = PER_CLASS, class_bytes: int = FIT_BYTES, least: int = 3, apart: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class whose
    crc32(doc_id) mod ``folds`` is not ``held_out``, of any length, until they have
    ``class_bytes`` together; features of fewer than
    ``least`` of them, or whose shares in the classes differ by under ``apart``
    standard errors, are left out.  Without toxic documents nothing is toxic.
    Null labels and ids, contradicting labels, repeated rows and empty tables: as
    ``labels.fit_sample`` says; a null or empty text has no sentences."""
    sample, counts = fit_sample(docs, labels, label, remainder(folds) != held_out, per_class, id_col, text_col)

    def extract(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off):
                s = sentences(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                first = np.searchsorted(s.of_word, s.ptr)
                part = lambda x: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.ascontiguousarray(x)))
                lists = [part(s.features[:, k]) for k in range(s.features.shape[1])]
                sent = part(s.of_word.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), sent, *lists], ["doc_id", "y", "n_bytes", "s", *(f"f{k}" for k in range(len(lists)))])

    wide = 1 + len(HEADS)
    schema = "doc_id long, y int, n_bytes long, s array<int>, " + ", ".join(f"f{k} array<int>" for k in range(wide))
    got = collected(sample.select("doc_id", "text", "y").mapInArrow(extract, schema), class_bytes)
    y = np.asarray(got["y"])
    if not (y == 1).any():
        return Model(np.zeros(DIM, np.float32), -30.0)
    flat_of = lambda c: np.asarray(got[c].combine_chunks().flatten())
    words = np.asarray(pa.compute.list_value_length(got["s"].combine_chunks()), np.int64)
    doc, old = np.repeat(np.arange(len(y), dtype=np.int32), words), flat_of("s")
    new = np.ones(len(old), bool)
    new[1:] = (old[1:] != old[:-1]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new, dtype=np.int32) - np.int32(1)
    ptr = np.searchsorted(doc[new], np.arange(len(y) + 1))
    planes = [flat_of(f"f{k}") for k in range(wide)]
    pairs = np.unique(np.concatenate([np.unique(doc.astype(np.int64) * DIM + f) for f in planes]))
    n = np.array([(y == k).sum() for k in (0, 1)])
    hits = np.stack([np.bincount(pairs[y[pairs // DIM] == k] % DIM, minlength=DIM) for k in (0, 1)])
    both = hits.sum(0) / n.sum()
    z = (hits[1] / n[1] - hits[0] / max(1, n[0])) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[1] + 1 / max(1, n[0])))
    use = (np.abs(z) >= apart) & (hits.sum(0) >= least)
    flat = np.concatenate([f[use[f]] for f in planes])
    of_feature = np.concatenate([sent[use[f]] for f in planes])
    share = np.array([counts.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y]
    rate = counts[1] / sum(counts.values())
    base = float(np.log(max(rate, 1e-4) / max(1.0, ptr[-1] / len(y))))
    del got, planes, pairs
    model = train(flat, of_feature, ptr, y, share, base)
    released()
    return model


def score(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", located: bool = True, offends: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every whole
    text and, with ``located``, offending: the sentences of probability
    ``offends`` or more, as (start, end, score, text), start and end in UTF-8 bytes.

    A null or empty text has no sentence and scores 0; repeated rows repeat; a
    null doc_id counts as '' for held_out.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in blocks(off):
                own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                s = sentences(own, at)
                z = sent.value.logits(s)
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(noisy_or(z, s.ptr))]
                if located:
                    p, whole, out = 1 / (1 + np.exp(-z)), own.tobytes(), []
                    for d in range(j - i):
                        hit = s.ptr[d] + np.flatnonzero(p[s.ptr[d] : s.ptr[d + 1]] >= offends)
                        out.append([{"start": int(s.start[k] - at[d]), "end": int(s.end[k] - at[d]), "score": float(p[k]), "text": whole[s.start[k] : s.end[k]].decode("utf-8", "replace")} for k in hit])
                    cols.append(pa.array(out, kind))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "offending"][: len(cols)])

    rows = id_text(docs, id_col, text_col).withColumn("held_out", remainder(folds) == held_out)
    more = ", offending array<struct<start: long, end: long, score: double, text: string>>" if located else ""
    scored = rows.mapInArrow(run, f"doc_id long, held_out boolean, score double{more}")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay.

    Rows are judged in place (no join): repeated rows and rows without an id are
    judged each, null and empty texts are not toxic, an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def civil(raw, offsets):
        s = sentences(raw, offsets)
        return noisy_or(sent.value.logits(s), s.ptr) < 0.5

    return rows_where(docs, text_col, civil)
