"""Classifiers on held-out rows, neighbours against brute force, the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_classes, brute_removed
from tokenizers import Tokenizer

import corpus_pipeline
from disclosa.llm import neighbours, quality, queries, substrings, toxicity

SMALL = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scored.where("held_out").join(truth, "doc_id").select("y", "predicted").toPandas()
    return (rows.y == rows.predicted).mean()


def test_quality_on_held_out_rows(spark):
    got = queries.op10_quality(spark, SMALL).cache()
    assert accuracy(spark, got, "quality") > 0.97 and got.count() == 1000
    r = got.where("held_out").first()
    assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark):
    got = queries.op4_toxicity(spark, SMALL).cache()
    assert accuracy(spark, got, "toxic") > 0.93 and got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_learns_from_long_texts(spark):
    r = random.Random(82)
    rows = [(d, " ".join(f"w{r.randint(0, 300)}{'.' * (r.random() < 0.1)}" for _ in range(6000)) + " vile insult." * (d % 2)) for d in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert min(len(t) for _, t in rows) > 20_000
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert [r.predicted for r in sorted(got)] == [d % 2 for d in range(120)]
    few = toxicity.fit(docs, labels, class_bytes=1)  # one of each class
    assert np.isfinite(few.weight).all() and np.isfinite(few.bias)


def test_scores_never_use_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.fit(docs, x)).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert (a.score == b.score).all()


def toy(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        s = [" ".join(f"w{r.randint(0, 300)}" for _ in range(8)) for _ in range(6)]
        if bad:
            s[r.randrange(6)] += " you vile oaf"
        docs.append((i, ". ".join(s) + ".", 1.0))
        labels.append((i, int(bad), int(bad)))
    docs += [(1000, None, 1.0), (1001, "", 1.0), (None, "you vile oaf. fine.", 1.0), (1002, "fine words " * 20000, 1.0), (1002, "fine words " * 20000, 1.0)]
    labels += [(None, 1, 1), (5, None, None), (7, 1 - labels[7][1], 1 - labels[7][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_offending_sentences_are_located(spark):
    docs, labels = toy(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == (r.doc_id % 3 == 0)
            if r.predicted:
                assert any("vile oaf" in s.text for s in r.offending)
                assert all(s.end > s.start >= 0 for s in r.offending)
        elif r.doc_id is None:
            assert r.predicted == 1 and len(r.offending) == 1
        else:
            assert r.predicted == 0


def sample_of(r, docs=12):
    """Features, the sentence of each, the sentences of each document, and labels."""
    per = [r.randint(1, 4) for _ in range(docs)]
    ptr = np.concatenate([[0], np.cumsum(per)])
    of = sorted(r.choices(range(int(ptr[-1])), k=80))
    f = np.array([r.choice([3, 5, 9, 11]) for _ in of])
    return f, np.array(of), ptr, np.array([k % 2 for k in range(docs)])


def test_noisy_or_equals_the_product():
    r = random.Random(6)
    z, ptr = np.array([r.uniform(-8, 8) for _ in range(30)]), np.array([0, 0, 4, 5, 30])
    want = [1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z[a:b]]) for a, b in zip(ptr, ptr[1:])]
    assert np.allclose(toxicity.noisy_or(z, ptr), want) and toxicity.noisy_or(z, ptr)[0] == 0


def test_toxicity_training_follows_the_plain_gradient():
    """A step of Adam goes against the sign of the numeric gradient of the
    weighted likelihood of the noisy-or, and many steps lower that loss."""
    f, of, ptr, y = sample_of(random.Random(7))
    weights, base, ridge = np.linspace(0.5, 1.5, len(y)), -1.0, 2e-5

    def loss(w, b):
        total = 0.0
        for d in range(len(y)):
            clean = 1.0
            for s in range(ptr[d], ptr[d + 1]):
                clean *= 1 - 1 / (1 + np.exp(-(sum(w[x] for x, k in zip(f, of) if k == s) + b)))
            total -= weights[d] / weights.sum() * np.log(1 - clean if y[d] else clean)
        return total + ridge / 2 * sum(x * x for x in w.values())

    zero = dict.fromkeys((3, 5, 9, 11), 0.0)
    one = toxicity.train(f, of, ptr, y, weights, base, epochs=1, rate=0.01, ridge=ridge)
    for x in zero:
        slope = (loss(zero | {x: 1e-6}, base) - loss(zero | {x: -1e-6}, base)) / 2e-6
        assert np.isclose(one.weight[x], -0.01 * np.sign(slope), rtol=1e-3)
    assert np.isclose(one.bias - base, -0.01 * np.sign(loss(zero, base + 1e-6) - loss(zero, base - 1e-6)), rtol=1e-3)
    many = toxicity.train(f, of, ptr, y, weights, base, epochs=60, ridge=ridge)
    assert loss({x: float(many.weight[x]) for x in zero}, many.bias) < loss(zero, base)
    assert not np.delete(many.weight, list(zero)).any()


def test_toxicity_scores_equal_a_plain_reading(spark):
    docs, labels = toy(spark)
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).where("doc_id < 40").collect():
        assert (r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 40").collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id < 40").collect()}
    for d, text in texts.items():
        clean = 1.0
        for sentence in filter(str.strip, text.split(".")):
            raw = np.frombuffer(sentence.encode(), np.uint8)
            s = toxicity.sentences(raw, np.array([0, len(raw)]))
            z = sum(float(model.weight[x]) for word in s.features for x in word) + model.bias
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert np.isclose(got[d], 1 - clean, atol=1e-5)


def plain_ratios(rows, y):
    counts = {}
    for row, k in zip(rows, y):
        for x in row:
            counts.setdefault(int(x), [1, 1])[k] += 1
    total = [quality.DIM + sum(len(row) for row, c in zip(rows, y) if c == k) for k in (0, 1)]
    return {x: np.log(n[1] / total[1]) - np.log(n[0] / total[0]) if sum(n) - 2 > 2 else 0.0 for x, n in counts.items()}


def test_quality_training_equals_plain_ratios_and_solves_the_dual():
    r = random.Random(8)
    y = np.array([k % 2 for k in range(60)])
    rows = [np.array(sorted({r.randint(0, 40) + 15 * k * (r.random() < 0.7) for _ in range(12)})) for k in y]
    weights = np.where(y == 1, 1.3, 0.8)
    model = quality.train(rows, y, weights, epochs=400)
    ratio = plain_ratios(rows, y)
    assert np.allclose(model.ratio[list(ratio)], list(ratio.values())) and np.count_nonzero(model.ratio) == sum(v != 0 for v in ratio.values())
    # the hinge objective is at its least: no small change of a weight lowers it
    used = [x for x in ratio if ratio[x]]
    x = np.array([[ratio[f] * (f in set(row.tolist())) for f in used] for row in rows])
    x = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(rows), 1))])
    sign = np.where(y == 1, 1, -1)
    objective = lambda w: w @ w / 2 + (weights * np.maximum(0, 1 - sign * (x @ w))).sum()
    own = np.array([model.weight[f] / ratio[f] for f in used] + [model.bias])
    rng = np.random.default_rng(1)
    assert all(objective(own) <= objective(own + step) + 1e-6 for step in rng.standard_normal((500, len(own))) * 0.01)
    # and equals the dual's: the gap between them closes
    assert np.allclose([model.margin(row) for row in rows], x @ own)


def test_ties_and_repeated_labels(spark):
    docs, labels = toy(spark)
    twice = labels.unionByName(labels)
    for op in (quality, toxicity):
        a, b = (op.score(docs, op.fit(docs, x)).orderBy("doc_id", "score").toPandas() for x in (labels, twice))
        assert (a.score == b.score).all()
    # of several texts of one id the least teaches, whatever the order
    more = docs.unionByName(docs.limit(3).selectExpr("doc_id", "concat(text, ' zz') as text", "score"))
    a, b = (quality.fit(x, labels) for x in (more, more.orderBy(F.desc("text"))))
    assert (a.weight == b.weight).all()


def test_labels_of_missing_documents_do_not_crowd_out(spark):
    docs, labels = toy(spark)
    gone = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10_000, 14_000)], labels.schema)
    a, b = (quality.fit(docs, x, per_class=50) for x in (labels, labels.unionByName(gone)))
    assert (a.weight == b.weight).all()


def test_degenerate_labels(spark):
    docs, labels = toy(spark)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, none)).where("score between 0 and 1").count() == docs.count()
        assert quality.score(docs, quality.fit(docs, none)).where("score between 0 and 1").count() == docs.count()
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert toxicity.keep_civil(docs, labels).columns == docs.columns == quality.keep_good(docs, labels).columns


def vectors(n, dim, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True) * np.random.default_rng(seed + 1).uniform(0.5, 2, (n, 1))).astype(np.float32)


def brute(rows, k, every):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    dim = max(map(len, usable.values()), default=0)
    pad = {i: np.concatenate([v, np.zeros(dim - len(v))]) for i, v in usable.items()}
    return {q: sorted(((-(pad[q] * v).sum(), i) for i, v in pad.items() if i != q))[:k] for q in pad if q % every == 0}


def test_neighbours_recall_and_exact_scores(spark):
    x = vectors(3000, 24)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(None, x[0].tolist(), "c"), (9000, None, "c"), (9020, [0.0] * 24, "c"), (9040, [float("nan")] * 24, "c"), (9060, [float("inf")] * 24, "c"), (9080, [None] + [1.0] * 23, "c"), (9100, [0.5] * 10, "c"), (0, x[0].tolist(), "c")]
    rows += [(10000 + i, x[5].tolist(), "c") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got, want, hit = {}, brute([r[:2] for r in rows], 10, 20), 0
    for r in neighbours.nearest(df, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r[0] for r in found] == list(range(1, 11)) and q not in {r[1] for r in found}
        assert [(-r[2], r[1]) for r in found] == sorted((-r[2], r[1]) for r in found)
        hit += len({r[1] for r in found} & {i for _, i in want[q]})
    assert hit / (10 * len(want)) > 0.9
    assert [r[1] for r in got[10000]] == [i for _, i in want[10000]]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_an_id_with_several_vectors_is_one_neighbour(spark):
    r = random.Random(12)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60) for _ in range(2 if i % 3 else 1)] + [(20, [5.0, 5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in neighbours.nearest(df, k=10, target=1.0).collect()]
    want = set()
    for q in (0, 20, 40):
        best = {}
        for a, v in rows:
            for b, w in rows:
                if a == q and b != q:
                    best[b] = max(best.get(b, -9e9), sum(x * y for x, y in zip(v, w)))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
        want |= {(q, k, i, round(e, 9)) for k, (i, e) in enumerate(top, 1)}
    assert {(q, k, i, round(e, 9)) for q, k, i, e in got} == want and len(got) == len(want)


def test_blocks_of_a_leaf_lose_nothing(spark, monkeypatch):
    for name in ("CELL", "QUERIES", "LEAF"):
        monkeypatch.setattr(neighbours, name, 8)
    x = vectors(300, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute([(i, v.tolist()) for i, v in enumerate(x)], 5, 20)
    got = neighbours.nearest(df, k=5, target=1.0, leaf=8)
    hit = sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in got.collect())
    assert hit >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("fitted", [1, 10])
def test_deep_trees_and_too_few_leaves(spark, monkeypatch, fitted):
    """Levels below the fitted ones; queries whose leaves hold fewer than k rows get them all the same."""
    monkeypatch.setattr(neighbours, "DEPTH", fitted), monkeypatch.setattr(neighbours, "CELL", 16)
    monkeypatch.setattr(neighbours, "_visits", lambda *_: 1)
    x = vectors(400, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    forest = neighbours.fit(x.astype(float), 400, 2.1, 2, 4, 1)
    assert (forest.depth, forest.fitted) == (7, min(7, fitted)) and np.bincount(forest.leaves(x.astype(float))[:, 0]).max() < (400 if fitted == 1 else 40)
    assert len(set(forest.search(forest.project(x[:1].astype(float), query=True)[0]))) == 2 * 128
    got = {}
    for r in neighbours.nearest(df, k=30, leaf=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute([(i, v.tolist()) for i, v in enumerate(x)], 30, 20)
    assert {q: sorted(r) for q, r in got.items()} == {q: [(k + 1, i) for k, (_, i) in enumerate(w)] for q, w in want.items()}


def test_many_equal_vectors(spark):
    x = vectors(200, 8)
    rows = [(i, x[0].tolist()) for i in range(0, 4000, 10)] + [(i * 10 + 1, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows, 20, 20), {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for _, i in w] for q, w in want.items()}


def test_pipeline_equals_brute_force(spark):
    """Every stage anew on 200 documents: scores of the fitted models for each text alone,
    all pairs for near copies, a dictionary of windows for passages, the tokenizer as it is."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    def raw(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return data, np.array([0, len(data)])

    good = quality.fit(docs, labels)
    kept = {d: t for d, t in rows.items() if good.score(quality.indicators(*raw(t))[0]) >= 0.5}
    toxic = toxicity.fit(docs.where(F.col("doc_id").isin(list(kept))), labels)

    def score(text):
        s = toxicity.sentences(*raw(text))
        return float(toxicity.noisy_or(toxic.logits(s), s.ptr)[0])

    kept = {d: t for d, t in kept.items() if score(t) < 0.5}
    classes = brute_classes(list(kept.items()))
    kept = {d: t for d, t in kept.items() if classes[d] == d}
    cut = {d: (n, gone, text) for d, n, gone, _, text in brute_removed(list(kept.items()))}
    kept = {d: t if not cut[d][1] else cut[d][2] for d, t in kept.items() if cut[d][1] < cut[d][0] or not cut[d][0]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in kept.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for r in pieces:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))
    places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    for (s, at, n), (t, after, _) in zip(places, places[1:]):
        assert after == (at + n if s == t else 0) and at + n <= 1024


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/toxicity").join(labels, "doc_id")
    # of about 40 toxic documents; 400 labels teach most of the words, not all
    assert left.where("quality = 0").count() <= 1 and left.where("toxic = 1").count() <= 6
    assert 1000 > seen["quality"] > seen["toxicity"] > seen["near_copies"] >= seen["substrings"] > 600
    packed, texts = docs, spark.read.parquet(f"{tmp_path}/substrings")
    assert packed.select("doc_id").distinct().count() == texts.count()
    assert texts.where("n_chars <> char_length(text)").count() == 0
    again = substrings.drop_repeats(texts, keep_text=False).agg(F.sum("n_removed")).first()[0]
    before = substrings.drop_repeats(spark.read.parquet(f"{tmp_path}/near_copies"), keep_text=False).agg(F.sum("n_removed")).first()[0]
    assert again < 0.02 * before


def test_one_id_with_different_texts_keeps_both(spark):
    rows = [(1, "one two three four five six seven"), (1, "a quite different text of seven words"), (1, "one two three four five six seven")]
    docs = spark.createDataFrame([(*r, "en", "s", k, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    got = sorted(tuple(r) for r in corpus_pipeline.near_copies_stage(spark, docs, SMALL).collect())
    assert got == sorted([(1, rows[0][1], "en", "s", 0, 0), (1, rows[1][1], "en", "s", 1, 1)])


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_bear_clashing_names_and_long_texts(spark, stage):
    rows = [(1, "a b c d e f " * 40_000, "en", 1, 7, True, 3.5), (2, "quite another text", None, 2, 8, False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_chars long, kept int, text_is_null boolean, `carried` double")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SMALL)
    rows = out.collect()
    if stage != "packing":
        assert out.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    else:
        assert {r.doc_id for r in rows} == {1, 2}


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_bear_odd_rows(spark, stage):
    rows = [(1, "a b c d e f", "en", None, 11, 7), (1, "a b c d e f", "en", "s", 11, 7), (None, "x y", None, "s", None, 7), (2, None, "en", "s", None, 7), (3, "", "en", "s", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, SMALL)
    assert out.count() >= 1
    if stage != "packing":
        assert out.columns == docs.columns
    run(spark, docs.limit(0), SMALL).count()
