"""Collocations against a plain count, word by word."""

import random
import re
from collections import Counter, defaultdict

import pytest

from disclosa.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, f double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1.0) for i, (t, g) in enumerate(rows)], SCHEMA)


def plain(rows, longest=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        found = []
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, " ".join(p), -a, counts[p[:k]], counts[p[k:]], n[lang], -score))
    return out


def got(spark, rows, **kw):
    found = phrases.collocations(table(spark, rows), **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def some(seed, n=120):
    r = random.Random(seed)
    vocab = ["a", "B", "c", "é", "É", "d\x0bd", "the", "New", "York", "\x1f", "x y"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", " \t "]
    text = lambda: "".join(r.choice(vocab) + r.choice(ends) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), (" \t ", "fr"), *[("New York city. new york City", "en")] * 30]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    rows = some(seed)
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, longest=4, least=4, percent=80, top=7) == plain(rows, 4, 4, 80, 7)


def test_no_rows(spark):
    assert got(spark, []) == set() and got(spark, [(None, None), ("", "en")]) == set()


def test_long_pieces_and_many_buckets(spark, monkeypatch):
    """A piece of many words is counted in windows; small chunks send to many buckets."""
    for name, value in (("CHUNK", 2000), ("WORDS", 101), ("BUCKET", 5000)):
        monkeypatch.setattr(phrases, name, value)
    r = random.Random(3)
    rows = [*some(3, 40), (" ".join(r.choice("abcdefgh") for _ in range(5000)), "en"), ("z " * 3000, "de")]
    assert got(spark, rows) == plain(rows)


def test_products_beyond_64_bits(spark):
    counts = [("en", "a b", 2, 3_000_000_000), ("en", "a", 1, 4_000_000_000), ("en", "b", 1, 3_000_000_001), ("en", None, 0, 9_000_000_000)]
    df = spark.createDataFrame(counts, "lang string, phrase string, n_words int, f long")
    old, phrases.phrase_counts = phrases.phrase_counts, lambda *a: df
    try:
        row = phrases.collocations(df).collect()[0]
    finally:
        phrases.phrase_counts = old
    assert row["score"] == 1000000 * 3_000_000_000**2 // (4_000_000_000 * 3_000_000_001)
