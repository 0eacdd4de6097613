"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from disclosa.llm import nearcopies, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], (p + 1 if x == y else max(d[j + 1], d[j]))
    return d[-1]


def test_alignment_equals_plain_lcs():
    random.seed(2)
    for _ in range(500):
        k = random.choice([3, 20, 1000])
        a = [random.randint(0, k) for _ in range(random.randint(1, 200))]
        b = list(a)
        for _ in range(random.randint(0, max(1, len(a) // 4))):
            i = random.randint(0, len(b) - 1) if b else 0
            match random.randint(0, 2):
                case 0 if len(b) > 1:
                    b.pop(i)
                case 1:
                    b.insert(i, random.randint(0, k))
                case _:
                    b[i] = random.randint(0, k)
        if random.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        want = (n := lcs(a, b)) / (len(a) + len(b) - n)
        got = nearcopies.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got - want) < 1e-12)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def edited(text, n, seed):
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randint(0, 10**6)}"
    return out


def corpus():
    docs = []
    for g in range(8):
        base = words(250, g)
        docs += [(g * 100, " ".join(base)), (g * 100 + 1, " ".join(base)), (g * 100 + 50, "  ".join(base).upper() + "!")]
        docs += [(g * 100 + 2 + k, " ".join(edited(base, k, 1000 + g * 10 + k))) for k in range(1, 12)]
        docs.append((g * 100 + 60, " ".join(base[125:] + base[:125])))
    docs += [(5000 + k, " ".join(words(300, 500 + k))) for k in range(60)]
    docs += [(6000, "a b"), (6001, "A, b"), (6002, "a c"), (6003, None), (6004, ""), (6005, "!!"), (6006, "!!"), (6007, "?"), (6008, "x " * 30000)]
    return docs


CAPITALS = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def plain_words(text):
    return re.findall("[0-9A-Za-z_\x80-\U0010ffff]+", (text or "").translate(CAPITALS))


def plain_shingles(text):
    """Five words each; a shorter text is one."""
    w = plain_words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_links(docs, least=0.8):
    """Pairs (i, j, similarity) of documents, all pairs looked at, by the definition alone."""
    seqs, out = [plain_shingles(t) for _, t in docs], []
    counts, ids = [Counter(s) for s in seqs], {}
    coded = [[ids.setdefault(x, len(ids)) for x in s] for s in seqs]
    for i in range(len(docs)):
        for j in range(i):
            n, m = len(seqs[i]), len(seqs[j])
            if not n or not m:
                if n == m and (docs[i][1] or "") == (docs[j][1] or ""):
                    out.append((j, i, 1.0))
                continue
            if min(n, m) < least * max(n, m):
                continue
            both = sum((counts[i] & counts[j]).values())  # no less than in order
            if both < least * (n + m - both) - 1e-9:
                continue
            both = n if seqs[i] == seqs[j] else lcs(coded[i], coded[j])
            if both >= least * (n + m - both) - 1e-9:
                out.append((j, i, both / (n + m - both)))
    return out


def brute_classes(docs, least=0.8):
    root = list(range(len(docs)))
    for i, j, _ in brute_links(docs, least):
        a, b = root[i], root[j]
        root = [a if x == b else x for x in root]
    first = {}
    for (d, _), r in zip(docs, root):
        first[r] = min(d, first.get(r, d))
    return {d: first[r] for (d, _), r in zip(docs, root)}


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, copy_of int, rep int")


@pytest.fixture(scope="module")
def classes(spark):
    docs = corpus()
    return docs, {r.doc_id: r for r in nearcopies.near_copies(frame(spark, docs)).collect()}


def test_classes_equal_brute_force(classes):
    docs, got = classes
    assert {d: r.class_id for d, r in got.items()} == brute_classes(docs)


def test_classes_of_test_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame(spark, docs)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) < len(got)


def test_copies_and_small_texts(classes):
    _, got = classes
    assert got[1].copy_of == 0 and got[50].copy_of == 0 and got[6001].class_id == 6000 and got[6002].class_id == 6002
    assert got[6004].class_id == 6003 and got[6006].class_id == 6005 and got[6007].class_id == 6007


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g h"), (1, "quite another text of some words here")]
    got = sorted((tuple(r) for r in nearcopies.near_copies(frame(spark, docs)).collect()), key=str)
    assert len(got) == 6 and [r for r in got if r[0] is None] == [(None, None, None)] * 2
    assert nearcopies.near_copies(frame(spark, [])).count() == 0


def test_chains_and_unlinked_kin(spark):
    base = words(200, 77)
    docs = [(k, " ".join(edited(base, 3 + k % 3, k))) for k in range(30)]
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame(spark, docs)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) > 1


@pytest.mark.parametrize("unit, block", [(2, 4), (64, 256)])
def test_a_family_loses_no_link(spark, monkeypatch, unit, block):
    monkeypatch.setattr(nearcopies, "UNIT", unit), monkeypatch.setattr(nearcopies, "BLOCK", block)
    base = words(200, 79)
    docs = [(k, " ".join(edited(base, 1 + k % 6, k))) for k in range(60)]
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame(spark, docs)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) > 1


@pytest.mark.parametrize("block", [8, 256])
def test_documents_with_a_common_passage_lose_no_link(spark, monkeypatch, block):
    """Most share sketches of the passage but are not near; some pairs are."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    passage, docs = words(60, 82), []
    for k in range(60):
        own = words(40, 3000 + k)
        docs.append((2 * k, " ".join(passage + own)))
        if k % 3 == 0:
            docs.append((2 * k + 1, " ".join(passage + edited(own, 1, k))))
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame(spark, docs)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) == 60


@pytest.mark.parametrize("two", [False, True])
def test_sharing_connects_what_all_pairs_connect(two):
    r = np.random.default_rng(9)
    sets = [np.unique(r.choice(60, r.integers(0, 50))).astype(np.uint32) for _ in range(40)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    root, block = r.integers(0, 30, 40), (np.arange(40) % 3 == 0) & two

    def connected(pairs):
        own = root.copy()
        for i, j in pairs:
            own[own == own[j]] = own[i]
        return own[:, None] == own

    got = nearcopies.sharing(np.concatenate(sets), ptr, root, block, 0.5)
    want = set()
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if root[i] != root[j] and (block[i] != block[j] or not two) and both >= 0.5 * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    assert {tuple(sorted(map(int, p))) for p in got} <= want and (connected(got) == connected(want)).all()


def test_one_row_of_each_class_stays(spark):
    base, other = words(100, 83), words(100, 84)
    rows = [(1, " ".join(base), "b", 1), (1, " ".join(base), "a", 2), (1, " ".join(other), "c", 3), (2, " ".join(edited(base, 1, 1)), "d", 4), (0, " ".join(edited(other, 1, 2)), "e", 5)]
    rows += [(None, " ".join(base), "f", 6), (None, None, "g", 7), (7, None, "h", 8), (8, "", "i", 9), (9, "x " * 50000, "j", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, mark int")
    got = sorted((tuple(r) for r in nearcopies.keep_first(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[4], rows[5], rows[6], rows[7], rows[9]], key=str)
    assert nearcopies.keep_first(docs.limit(0)).count() == 0


def small_pairs():
    """Texts of each two small lengths that share all but some words at an end or in the middle."""
    docs, r = [], random.Random(80)
    for n in range(5, 30):
        for more in range(1, 5):
            for where in ("end", "start", "middle"):
                base = words(n, r.random())
                extra = [f"x{r.randint(0, 10**9)}" for _ in range(more)]
                cut = {"end": n, "start": 0, "middle": n // 2}[where]
                docs += [" ".join(base), " ".join(base[:cut] + extra + base[cut:])]
    return list(enumerate(docs))


def test_small_texts_lose_no_pair(spark):
    docs = small_pairs()
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame(spark, docs)).collect()}
    assert got == brute_classes(docs)
    size = {d: len(t.split()) for d, t in docs}
    assert {(size[c], size[d]) for d, c in got.items()} >= {(8, 9), (9, 10), (12, 14)}


def test_keys_of_few_shingles_meet_from_the_similarity_on():
    r = np.random.default_rng(81)
    for n in range(1, 21):
        for m in range(n, 21):
            for both in range(1, n + 1):
                if both / (n + m - both) < 0.8 or (n == m == both):
                    continue
                for _ in range(20):
                    x = r.integers(1, 2**63, n + m - both, dtype=np.uint64)
                    keys = nearcopies.few(np.concatenate([x[:n], x[n - both :]]), np.array([0, n, n + m]))
                    if n < 20 and m < 20:
                        assert np.isin(*keys).any()


def brute_removed(docs, window=13):
    first, split = {}, [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def passages(n, seed):
    r = random.Random(seed)
    shared = [words(r.randint(5, 60), 900 + k) for k in range(6)]
    docs = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            w += words(r.randint(0, 40), r.random())
            w += r.choice(shared)[r.randint(0, 3) :]
        docs.append((d * 3 % n, "".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w)))
    return docs


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_repeats_equal_brute_force(spark, size):
    docs = passages(60, 3) + [(None, " ".join(words(40, 901))), (200, None), (201, ""), (202, "é x" + "y " * 13 + " z"), (203, "q " + "y " * 13), (204, "long " * 20000), (205, "long " * 20000)]
    docs += [docs[0], (docs[1][0], docs[2][1])]
    got = sorted((tuple(r)[:5] for r in substrings.drop_repeats(frame(spark, docs), chunk_bytes=size).collect()), key=str)
    assert got == brute_removed(docs)


def test_carried_columns_and_empty_tables(spark):
    docs = [(1, "a  b " * 20), (2, "a  b " * 20), (3, "x  y")]
    got = {r.doc_id: r for r in substrings.drop_repeats(frame(spark, docs), carry=["rep"], as_is=True).collect()}
    assert got[1].kept == docs[0][1] and got[2].kept == "" and got[3].kept == "x  y" and got[3].carried.rep == 2
    assert substrings.drop_repeats(frame(spark, [])).count() == 0


def test_other_window_lengths(spark):
    docs = passages(30, 9)
    for window in (1, 2, 5, 20):
        got = sorted((tuple(r) for r in substrings.drop_repeats(frame(spark, docs), window).collect()), key=str)
        assert got == brute_removed(docs, window)


def brute_spans(docs, window):
    out, n = set(), window
    while True:
        holders = {}
        for r, (d, t) in enumerate(docs):
            w = WORD.findall(t or "")
            for i in range(len(w) - n + 1) if d is not None else ():
                holders.setdefault(tuple(w[i : i + n]), []).append((d, r, i))
        alive = sorted((r, i, d) for hits in holders.values() if len({h[0] for h in hits}) > 1 for d, r, i in hits)
        if not alive:
            return sorted(out)
        run = None
        for r, i, d in [*alive, (-1, 0, 0)]:
            if run and run[0] == r and i - run[3] <= n:
                run[3] = i
                continue
            if run:
                out.add((run[1], n, run[2], run[3] + n))
            run = [r, d, i, i]
        n *= 2


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_doubling_goes_on_until_nothing_repeats(spark, size):
    docs = passages(40, 5) + [(300, " ".join(words(200, 1))), (301, "x " + " ".join(words(200, 1)) + " y"), (None, " ".join(words(200, 1))), (302, None)]
    got = sorted({tuple(r) for r in substrings.repeated_spans(frame(spark, docs), chunk_bytes=size).collect()})
    assert got == brute_spans(docs, 13) and max(r[1] for r in got) >= 104
    assert substrings.repeated_spans(frame(spark, [])).count() == 0
